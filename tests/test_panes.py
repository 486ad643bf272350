"""Triggered windows: golden panes, and the sequential part against brute force."""

import datetime
import random
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideloom.functions.times import millis
from tideloom.operators import panes as P
from tideloom.operators import windows as W
from tideloom.operators import chains
from tideloom.operators.chains import Limits, segment_starts
from tideloom.operators.ordered import Slicing, plan_slices

EPOCH = datetime.datetime(2024, 1, 1)
AGGS = {"n": ("count", None), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}


def stream(spark, rows):
    """rows: (id, key, ms, value)"""
    return spark.createDataFrame(
        [(i, k, EPOCH + datetime.timedelta(milliseconds=ms), v) for i, k, ms, v in rows],
        "id bigint, k bigint, ts timestamp_ntz, v bigint",
    )


def golden(spark):
    return stream(spark, [(i, k, i, k) for i, k in enumerate([1, 2, 1, 2, 1, 2, 1, 2, 3])])


def test_discarding_gives_five_panes(spark):
    got = P.panes(golden(spark), keys=["k"], ts="ts", tie="id", aggs=AGGS, early=P.Repeat(P.Count(2)), tumbling="1 second")
    panes = sorted((r["k"], r["pane_no"], r["firing_type"], r["n"]) for r in got.collect())
    assert panes == [(1, 0, "EARLY", 2), (1, 1, "EARLY", 2), (2, 0, "EARLY", 2), (2, 1, "EARLY", 2), (3, 0, "DEFAULT", 1)]


@pytest.mark.parametrize("slicing", [Slicing(), "cut"])
def test_accumulating_gives_seven_panes(spark, slicing):
    source = golden(spark)
    if slicing == "cut":
        slicing = plan_slices(source.select(millis("ts").alias("_ms")), "_ms", 2)
        assert slicing.cuts
    got = P.panes(
        source, keys=["k"], ts="ts", tie="id", aggs=AGGS, early=P.Repeat(P.Count(2)), tumbling="1 second",
        accumulating=True, slicing=slicing,
    )
    panes = sorted((r["k"], r["firing_type"], r["n"]) for r in got.collect())
    assert panes == [(1, "DEFAULT", 4), (1, "EARLY", 2), (1, "EARLY", 4), (2, "DEFAULT", 4), (2, "EARLY", 2), (2, "EARLY", 4), (3, "DEFAULT", 1)]


def test_once_fires_only_once(spark):
    got = P.panes(golden(spark), keys=["k"], ts="ts", tie="id", aggs=AGGS, early=P.Count(2), tumbling="1 second")
    panes = sorted((r["k"], r["firing_type"], r["n"]) for r in got.collect())
    assert panes == [(1, "DEFAULT", 2), (1, "EARLY", 2), (2, "DEFAULT", 2), (2, "EARLY", 2), (3, "DEFAULT", 1)]


def test_any_takes_the_first_child(spark):
    rows = [(0, 1, 0, 1), (1, 1, 10, 1), (2, 1, 200, 1), (3, 1, 300, 1), (4, 2, 0, 1), (5, 2, 10, 1), (6, 2, 20, 1)]
    early = P.AnyOf((P.Count(3), P.SinceFirst("100 milliseconds")))
    got = P.panes(stream(spark, rows), keys=["k"], ts="ts", tie="id", aggs=AGGS, early=early, tumbling="1 second")
    assert sorted((r["k"], r["firing_type"], r["n"]) for r in got.collect()) == [(1, "DEFAULT", 2), (1, "EARLY", 2), (2, "EARLY", 3)]


def test_session_with_null_key_and_timer(spark):
    rows = [(0, 1, 0, 1), (1, 1, 400, 1), (2, 1, 1500, 1), (3, None, 0, 1), (4, None, 100, 1)]
    got = P.panes(
        stream(spark, rows), keys=["k"], ts="ts", tie="id", aggs=AGGS, early=P.SinceFirst("300 milliseconds"), session="1 second"
    )
    start = 1704067200000
    assert sorted(((r["k"] or 0), r["pane_id"] - start, r["firing_type"], r["n"]) for r in got.collect()) == [
        (0, 0, "EARLY", 2), (1, 0, "DEFAULT", 1), (1, 0, "EARLY", 1), (1, 1500, "EARLY", 1),
    ]


def brute_segments(messages, lim):
    """messages: sorted clock values of one group -> segment per message"""
    out, seg, start, last, used = [], -1, None, None, 0
    for ms in messages:
        ended = (
            start is None
            or (lim.age is not None and ms >= start + lim.age)
            or (lim.count is not None and used >= lim.count)
            or (lim.silence is not None and ms - last >= lim.silence)
        )
        if ended:
            seg, start, used = seg + 1, ms, 0
        used, last = used + 1, ms
        out.append(seg)
    return out


@settings(max_examples=500, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=40), min_size=1, max_size=4),
    st.one_of(st.none(), st.integers(1, 5)), st.one_of(st.none(), st.integers(1, 25)), st.one_of(st.none(), st.integers(1, 12)),
    st.integers(1, 7),
)
def test_segment_starts(groups, count, age, silence, batch):
    lim = Limits(count, age, silence, True)
    ticks = []
    for g, messages in enumerate(groups):
        for ms in sorted(set(messages)):
            ticks.append((g, f"g{g}", ms, messages.count(ms)))
    frame = pd.DataFrame(ticks, columns=["k", "_group", "_ms", "_n"])
    pieces = [frame.iloc[i : i + batch].reset_index(drop=True) for i in range(0, len(frame), batch)]
    found = pd.concat(list(segment_starts(iter(pieces), ["k"], lim)))
    for g, messages in enumerate(groups):
        starts = found[found["k"] == g].sort_values("segment")
        got = [int((starts["_rn"] <= rn).sum()) - 1 for rn in range(1, len(messages) + 1)]
        assert got == brute_segments(sorted(messages), lim)
        assert starts["segment"].tolist() == list(range(len(starts)))


@pytest.mark.parametrize("trigger", [
    P.Repeat(P.SinceFirst("70 milliseconds")),
    P.Repeat(P.AnyOf((P.Count(3), P.SinceFirst("70 milliseconds"), P.SinceLast("20 milliseconds")))),
    P.Repeat(P.SinceLast("15 milliseconds")),
    P.Repeat(P.Count(4)),
])
def test_segments_on_a_hot_key_in_slices(spark, trigger):
    rng = random.Random(5)
    rows = [(i, 1 if rng.random() < 0.6 else rng.randrange(2, 5), rng.randrange(0, 900), 1) for i in range(400)]
    source = stream(spark, rows).withColumn("_ms", millis("ts"))
    got = P.segments(source, ["k"], "id", trigger, plan_slices(source, "_ms", 30)).collect()
    lim = P.limits(trigger)
    for key in range(1, 5):
        mine = sorted((r["_ms"], r["id"], r["segment"]) for r in got if r["k"] == key)
        assert [s for *_, s in mine] == brute_segments([ms for ms, *_ in mine], lim)


LIMITS = [
    Limits(age=7, repeat=True), Limits(age=400, repeat=True), Limits(count=3, age=50, repeat=True),
    Limits(count=40, age=300, silence=9, repeat=True), Limits(age=90, silence=6, repeat=True), Limits(count=70, repeat=True),
]


@pytest.mark.parametrize("lim", LIMITS, ids=str)
def test_chain_in_slices_equals_the_plain_chain(spark, lim):
    """Segments shorter and longer than a slice, ties, slices without a message of a group, a null group."""
    rng = random.Random(str(lim))
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(0, 1500)) for _ in range(700)]
    rows += [(3, 2), (3, 1490), (4, 700)] + [(1, 777)] * 30
    df = spark.createDataFrame(rows, "k bigint, _ms bigint")
    slicing = plan_slices(df, "_ms", 40)
    assert len(slicing.cuts) > 15
    got = chains.starts(df, ["k"], lim, slicing).collect()
    for key in (1, 2, 3, 4, None):
        mine = sorted(ms for k, ms in rows if k == key)
        segments = brute_segments(mine, lim)
        firsts = [(ms, i + 1, seg) for i, (ms, seg) in enumerate(zip(mine, segments)) if i == 0 or segments[i - 1] != seg]
        assert sorted((r["_ms"], r["_rn"], r["segment"]) for r in got if r["k"] == key) == firsts


def test_one_group_is_spread_over_the_slices(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("_ms"))
    slicing = plan_slices(df, "_ms", 1_000)
    got = chains.starts(df, ["k"], Limits(age=10, repeat=True), slicing)
    plan = got._jdf.queryExecution().executedPlan().toString()
    partitionings = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    keys = {tuple(re.sub(r"#\d+L?", "", p).split(", ")[:-1][:2]) for p in partitionings}
    assert "MapInArrow" in plan and ("_group", "_slice") in keys
    # ticks are dealt by slice, whole groups only meet as one row per slice
    assert ("_group",) not in keys
    # the slices hold about as many ticks each, and each puts out its own starts
    held = slicing.tag(df, "_ms", "s").groupBy("s").count().agg(F.max("count")).first()[0]
    assert held <= 1_500
    rows = [(r["_ms"], r["_rn"], r["segment"]) for r in got.orderBy("segment").collect()]
    assert rows == [(12 * i, 4 * i + 1, i) for i in range(5_000)]


def test_throttled_counts_in_slices(spark):
    from tideloom.operators.aggregates import throttled_counts

    rng = random.Random(8)
    source = stream(spark, [(i, rng.choice([1, 1, 2]), rng.randrange(0, 3000), 0) for i in range(500)])
    slicing = plan_slices(source.select(millis("ts").alias("_ms")), "_ms", 25)
    args = (source, "k", "ts", "1 second", "30 milliseconds")
    plain, cut = throttled_counts(*args, Slicing()), throttled_counts(*args, slicing)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_collected_pane_comes_in_chunks(spark):
    rows = [(i, 1, i, i * 10) for i in range(10)]
    tagged = W.tag_tumbling(stream(spark, rows), "ts", "1 second")
    got = W.collect_panes(tagged, "ts", ["k"], "id", ["v"], chunk=4, slicing=Slicing((1704067200003.0,)))
    chunks = {r["chunk_no"]: [m["v"] for m in r["messages"]] for r in got.collect()}
    assert chunks == {0: [0, 10, 20, 30], 1: [40, 50, 60, 70], 2: [80, 90]}


def test_ordered_fold_over_many_levels(spark):
    rows = [(i, i % 2, i, i % 7) for i in range(300)]
    source = stream(spark, rows).withColumn("_ms", millis("ts"))
    got = W.fold_ordered(
        source, ["k"], ["_ms", "id"], F.lit(""), lambda s, m: F.concat(s, m["v"].cast("string")),
        lambda a, b: F.concat(a, b), lambda s: s, "text", chunk=3,
    )
    want = {k: "".join(str(v) for _, kk, _, v in rows if kk == k) for k in (0, 1)}
    assert {r["k"]: r["text"] for r in got.collect()} == want


def test_throttled_counts_across_ties(spark):
    from tideloom.operators.aggregates import throttled_counts

    rows = [(0, 1, 0, 0), (1, 1, 0, 0), (2, 1, 100, 0), (3, 1, 101, 0), (4, 1, 101, 0), (5, 1, 400, 0), (6, 2, 50, 0)]
    got = throttled_counts(stream(spark, rows), "k", "ts", "1 second", "100 milliseconds")
    assert sorted((r["k"], r["emitted_ms"] % 1000, r["n"]) for r in got.collect()) == [(1, 0, 1), (1, 101, 4), (1, 400, 6), (2, 50, 1)]
