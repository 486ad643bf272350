"""Sliced running values against brute force, with a hot key, ties and null keys."""

import random

import pytest
from pyspark.sql import functions as F

from tideloom.operators.aggregates import percentiles
from tideloom.operators.ordered import Running, Slicing, gaps, islands, plan_slices, ranked, running


def rows(n=900, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        out.append((i, key, rng.randrange(0, 300), rng.choice([None, *range(20)])))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "id bigint, k string, t bigint, v bigint").cache()


OUTPUTS = {
    "n": Running("count"),
    "n_before": Running("count", before=True),
    "last_v": Running("last", "v"),
    "prev_v": Running("last", "v", before=True),
    "sum_v": Running("sum", "v"),
    "top": Running("max", "v", before=True),
    "low": Running("min", "v"),
}


def brute(data):
    state, out = {}, {}
    for i, k, t, v in sorted(data, key=lambda r: (r[2], r[0])):
        seen = state.setdefault(k, [])
        known = [x for x in seen if x is not None]
        now = known + ([v] if v is not None else [])
        out[i] = (
            len(seen) + 1, len(seen), now[-1] if now else None, known[-1] if known else None,
            sum(now) if now else None, max(known) if known else None, min(now) if now else None,
        )
        seen.append(v)
    return out


@pytest.mark.parametrize("slicing", [Slicing(), Slicing((50.0, 51.0, 120.0, 250.0)), None])
def test_running(frame, slicing):
    if slicing is None:
        slicing = plan_slices(frame, "t", 40)
        assert len(slicing.cuts) > 10
    got = running(frame, ["k"], ["t", "id"], OUTPUTS, slicing)
    assert {r["id"]: tuple(r[c] for c in OUTPUTS) for r in got.collect()} == brute(rows())
    assert got.columns == [*frame.columns, *OUTPUTS]


def test_slices_bound_every_group(frame):
    slicing = plan_slices(frame, "t", 100)
    largest = slicing.tag(frame, "t", "s").groupBy("k", "s").count().agg(F.max("count")).first()[0]
    assert largest <= 130  # the hot key alone has about 360 rows


def test_global_rank_without_key(frame):
    got = ranked(frame, [], ["t", "id"], "rn", plan_slices(frame, "t", 100))
    want = {r[0]: n for n, r in enumerate(sorted(rows(), key=lambda r: (r[2], r[0])), 1)}
    assert {r["id"]: r["rn"] for r in got.collect()} == want


@pytest.mark.parametrize("closed", [True, False])
def test_islands(frame, closed):
    got = islands(frame, ["k"], ["t", "id"], 5, closed=closed, slicing=plan_slices(frame, "t", 60))
    last, start, want = {}, {}, {}
    for i, k, t, _ in sorted(rows(), key=lambda r: (r[2], r[0])):
        silent = k in last and (t - last[k] > 5 if closed else t - last[k] >= 5)
        if k not in last or silent:
            start[k] = t
        last[k], want[i] = t, start[k]
    assert {r["id"]: r["island_start"] for r in got.collect()} == want


@pytest.mark.parametrize("cut", [False, True])
def test_gaps_with_extra_values_in_one_pass(frame, cut):
    slicing = plan_slices(frame, "t", 60) if cut else Slicing()
    extra = {"rn": Running("count"), "first": Running("min", "t")}
    got = gaps(frame, ["k"], ["t", "id"], 4, closed=False, start="s", number="n", extra=extra, slicing=slicing)
    state, want = {}, {}
    for i, k, t, _ in sorted(rows(), key=lambda r: (r[2], r[0])):
        last, s, n, rn, first = state.get(k, (None, t, 0, 0, t))
        if last is not None and t - last >= 4:
            s, n = t, n + 1
        state[k] = (t, s, n, rn + 1, first)
        want[i] = state[k][1:]
    assert {r["id"]: (r["s"], r["n"], r["rn"], r["first"]) for r in got.collect()} == want
    assert set(got.columns) == {*frame.columns, "s", "n", *extra}


def test_exact_percentiles_in_slices(frame):
    got = percentiles(frame, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p100": 1.0}, Slicing((4.0, 9.0, 15.0)))
    groups = {}
    for _, k, _, v in rows():
        if v is not None:
            groups.setdefault(k, []).append(v)
    import math

    want = {k: tuple(sorted(vs)[math.ceil(len(vs) * p) - 1] for p in (0.1, 0.5, 1.0)) for k, vs in groups.items()}
    assert {r["k"]: (r["p10"], r["p50"], r["p100"]) for r in got.collect()} == want
