"""Folds and collected messages under triggers, against a plain walk over the messages."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_panes import stream
from tideloom.operators import pane_folds as PF
from tideloom.operators import panes as P
from tideloom.operators.ordered import Slicing, plan_slices
from tideloom.functions.times import millis

MOD = 1_000_003


def state(h, p):
    return F.struct(h.cast("bigint").alias("h"), p.cast("bigint").alias("p"))


def fold():
    return dict(
        zero=state(F.lit(0), F.lit(1)),
        step=lambda s, m: state((s["h"] * 31 + m["v"]) % MOD, (s["p"] * 31) % MOD),
        merge=lambda a, b: state((a["h"] * b["p"] + b["h"]) % MOD, (a["p"] * b["p"]) % MOD),
        finish=lambda s: s["h"], out="chain",
    )


def chained(values):
    h = 0
    for v in values:
        h = (h * 31 + v) % MOD
    return h


def messages(n=300):
    """A key with most rows, a null key, ties on the clock."""
    rnd = random.Random(5)
    return [(i, rnd.choice([1, 1, 1, 2, None]), rnd.randrange(4_000), rnd.randrange(1_000)) for i in range(n)]


def walked(rows, count, accumulating):
    """Panes of a tumbling second that fires with every ``count`` messages."""
    out, windows = {}, {}
    for i, k, ms, v in sorted(rows, key=lambda r: (r[2], r[0])):
        windows.setdefault((k, ms // 1000), []).append(v)
    for (k, w), values in windows.items():
        parts = [values[i : i + count] for i in range(0, len(values), count)]
        for no, part in enumerate(parts):
            fired = len(part) == count
            if fired or not accumulating:
                out[k, w, no, "EARLY" if fired else "DEFAULT"] = values[: no * count + len(part)] if accumulating else part
        if accumulating:
            out[k, w, len(values) // count, "DEFAULT"] = values
    return out


def sliced(df):
    return plan_slices(df.select(millis("ts").alias("_ms")), "_ms", 40)


@pytest.mark.parametrize("accumulating", [False, True])
@pytest.mark.parametrize("cut", [False, True])
def test_folds_equal_a_walk(spark, accumulating, cut):
    rows = messages()
    df = stream(spark, rows)
    got = PF.folded_panes(
        df, keys=["k"], ts="ts", tie="id", early=P.Repeat(P.Count(3)), tumbling="1 second", accumulating=accumulating,
        slicing=sliced(df) if cut else Slicing(), chunk=2, run=2, **fold(),
    )
    base = 1_704_067_200_000
    found = {(r["k"], (r["pane_id"] - base) // 1000, r["pane_no"], r["firing_type"]): r["chain"] for r in got.collect()}
    assert found == {k: chained(v) for k, v in walked(rows, 3, accumulating).items()}


@pytest.mark.parametrize("accumulating", [False, True])
@pytest.mark.parametrize("early", [P.Repeat(P.SinceFirst("90 milliseconds")), P.AnyOf((P.Count(4), P.SinceLast("200 milliseconds")))])
def test_session_folds_have_the_panes_of_aggregates(spark, accumulating, early):
    df = stream(spark, messages())
    more = dict(keys=["k"], ts="ts", tie="id", early=early, session="60 milliseconds", accumulating=accumulating)
    sums = dict(zero=F.lit(0).cast("bigint"), step=lambda s, m: s + m["v"], merge=lambda a, b: a + b, finish=lambda s: s, out="total")
    got = PF.folded_panes(df, **more, **sums)
    want = P.panes(df, aggs={"total": ("sum", "v")}, **more)
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect()), key=repr) == sorted(map(tuple, want.select(sorted(want.columns)).collect()), key=repr)


@pytest.mark.parametrize("accumulating", [False, True])
def test_collected_messages_are_whole(spark, accumulating):
    rows = messages()
    got = PF.collected_panes(
        stream(spark, rows), keys=["k"], ts="ts", tie="id", columns=["v"], early=P.Repeat(P.Count(7)), tumbling="1 second",
        accumulating=accumulating, chunk=4,
    ).collect()
    base = 1_704_067_200_000
    assert all(len(r["messages"]) == r["n_messages"] <= 4 for r in got)
    own = {}
    for r in sorted(got, key=lambda r: (r["pane_no"], r["chunk_no"])):
        place = r["k"], (r["pane_id"] - base) // 1000, r["pane_no"], r["firing_type"]
        own.setdefault(place, []).extend(m["v"] for m in r["messages"])
        if accumulating:
            assert r["n_so_far"] == sum(len(v) for p, v in own.items() if p[:2] == place[:2] and p[2] < place[2]) + sum(
                q["n_messages"] for q in got if (q["k"], q["pane_id"], q["pane_no"]) == (r["k"], r["pane_id"], r["pane_no"]))
    if accumulating:
        own = {p: [v for q in sorted(own, key=lambda q: q[2]) if q[:2] == p[:2] and q[2] <= p[2] for v in own[q]] for p in own}
    assert own == walked(rows, 7, accumulating)


def test_no_rows_give_no_panes(spark):
    empty = stream(spark, [])
    more = dict(keys=["k"], ts="ts", tie="id", early=P.Repeat(P.Count(3)), tumbling="1 second", accumulating=True)
    assert PF.folded_panes(empty, **more, **fold()).count() == 0
    assert PF.collected_panes(empty, columns=["v"], **more).count() == 0
