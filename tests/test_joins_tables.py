"""Joins and keyed tables on small streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tideloom.functions.times import millis
from tideloom.operators import joins as J
from tideloom.operators import tables as TB
from tideloom.operators.ordered import Slicing, plan_slices

EPOCH = datetime.datetime(2024, 1, 1)


def side(spark, rows, name):
    """rows: (id, key, ms)"""
    return spark.createDataFrame(
        [(i, k, EPOCH + datetime.timedelta(milliseconds=ms)) for i, k, ms in rows], "id bigint, k bigint, ts timestamp_ntz"
    ).withColumn(name, F.col("id"))


def pairs(spark, left, right, ttl="10 milliseconds", slicing=None):
    got = J.ttl_join(
        side(spark, left, "l"), side(spark, right, "r"), key="k", ts="ts", tie="id", ttl=ttl,
        left_columns=["l"], right_columns=["r"], slicing=slicing,
    )
    return sorted((r["l"], r["r"]) for r in got.collect())


def test_matches_in_both_directions(spark):
    assert pairs(spark, [(1, 7, 0), (2, 8, 5)], [(10, 7, 3), (20, 8, 1)]) == [(1, 10), (2, 20)]


def test_no_match_for_other_or_null_key(spark):
    assert pairs(spark, [(1, 7, 0), (2, None, 0)], [(10, 9, 3), (20, None, 1)]) == []


def test_only_the_latest_is_kept(spark):
    assert pairs(spark, [(1, 7, 0), (2, 7, 1)], [(10, 7, 3)]) == [(2, 10)]


def test_a_kept_message_matches_again(spark):
    assert pairs(spark, [(1, 7, 0)], [(10, 7, 3), (11, 7, 4)]) == [(1, 10), (1, 11)]


def test_expiry_is_strict(spark):
    assert pairs(spark, [(1, 7, 0)], [(10, 7, 9)]) == [(1, 10)]
    assert pairs(spark, [(1, 7, 0)], [(10, 7, 10)]) == []


def test_hot_key_in_slices(spark):
    rng = random.Random(1)
    left = [(i, 1 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(2000)) for i in range(200)]
    right = [(1000 + i, 1 if rng.random() < 0.6 else rng.randrange(5), rng.randrange(2000)) for i in range(200)]
    clock = side(spark, left + right, "x").select(millis("ts").alias("_ms"))
    want, latest = [], {}
    for ms, s, i, k in sorted([(ms, 0, i, k) for i, k, ms in left] + [(ms, 1, i, k) for i, k, ms in right]):
        other = latest.get((k, 1 - s))
        if other and other[0] > ms - 50:
            want.append((i, other[1]) if s == 0 else (other[1], i))
        latest[k, s] = (ms, i)
    assert pairs(spark, left, right, "50 milliseconds", plan_slices(clock, "_ms", 30)) == sorted(want)


def test_asof_with_deletes_and_null_keys(spark):
    stream = side(spark, [(1, 7, 0), (2, 7, 5), (3, 7, 9), (4, None, 9)], "x").drop("x")
    changes = side(spark, [(10, 7, 5), (11, 7, 7), (12, None, 1)], "v")
    for slicing in (Slicing(), Slicing((1704067200005.0, 1704067200007.0))):
        got = J.asof_join(
            stream, changes, key="k", ts="ts", tie="id", columns=["v"], deleted=F.col("v") == 11, slicing=slicing
        )
        assert sorted((r["id"], r["v"]) for r in got.collect()) == [(1, None), (2, 10), (3, None), (4, None)]


def test_broadcast_only_below_the_bounds(spark):
    df = spark.range(100)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(J.broadcast_if_small(df))
    assert not hinted(J.broadcast_if_small(df, max_rows=99))
    assert not hinted(J.broadcast_if_small(df, max_bytes=50))


def test_interval_join_is_complete(spark):
    rng = random.Random(2)
    left = [(i, rng.randrange(2), rng.randrange(300)) for i in range(60)]
    right = [(i, rng.randrange(2), rng.randrange(300)) for i in range(60)]
    got = J.interval_join(
        side(spark, left, "l"), side(spark, right, "r"), key="k", ts="ts", before="7 milliseconds", after="3 milliseconds",
        left_columns=["l"], right_columns=["r"],
    )
    want = [(a, b) for a, k, t in left for b, j, u in right if k == j and u - 7 <= t <= u + 3]
    assert sorted((r["l"], r["r"]) for r in got.collect()) == sorted(want)


@pytest.fixture
def store(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k bigint, v string")


def content(df):
    return sorted(tuple(r) for r in df.collect())


def test_put_get_delete(spark, store):
    puts = spark.createDataFrame([(2, "B", False), (4, "D", False), (1, None, True)], "k bigint, v string, gone boolean")
    assert content(TB.put_all(store, puts, ["k"], F.col("gone"))) == [(2, "B"), (3, "c"), (4, "D")]
    wanted = spark.createDataFrame([(3,), (9,)], "k bigint")
    assert content(TB.get_all(store, wanted, ["k"])) == [(3, "c")]
    assert content(TB.delete_all(store, wanted, ["k"])) == [(1, "a"), (2, "b")]
    assert [r["k"] for r in TB.key_range(store, "k", 1, 3).collect()] == [1, 2]
    assert [r["k"] for r in TB.key_range(store, "k", 1, 4, descending=True).collect()] == [3, 2, 1]


def test_materialise(spark):
    log = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, None), (2, 1, "x"), (2, 3, "z"), (2, 2, "y"), (None, 9, "n")], "k bigint, seq bigint, v string"
    )
    assert content(TB.materialise(log, ["k"], ["seq"], F.col("v").isNull())) == [(2, 3, "z")]
    assert content(TB.materialise(log, ["k"], ["seq"])) == [(1, 2, None), (2, 3, "z")]


def test_compact_batch_keeps_first_query_and_last_update(spark):
    ops = spark.createDataFrame(
        [(1, 5, "get"), (2, 5, "put"), (3, 5, "get"), (4, 5, "delete"), (5, 6, "get"), (6, 5, "put")], "seq bigint, k bigint, op string"
    )
    batched = TB.batches(ops.withColumn("src", F.lit(0)), ["src"], ["seq"], 4)
    got = TB.compact(batched, ["src"], "k", ["seq"], F.col("op") == "get")
    assert sorted((r["batch_no"], r["seq"], r["op"]) for r in got.collect()) == [(0, 1, "get"), (0, 4, "delete"), (1, 5, "get"), (1, 6, "put")]
    assert sorted(r["seq"] for r in batched.collect()) == [1, 2, 3, 4, 5, 6]


def test_versioned_actions(spark):
    req = spark.createDataFrame([(1, "d", 5), (2, "d", 7), (3, "d", 6), (4, "d", 7), (5, "d", 8), (6, "e", 1)], "seq bigint, doc string, ver bigint")
    got = TB.versioned_actions(req, "doc", "ver", ["seq"], Slicing((3.0, 5.0)))
    assert [r["action"] for r in got.orderBy("seq").collect()] == ["insert", "update", "conflict", "conflict", "update", "insert"]


def test_band_join_takes_bands_of_any_length(spark):
    from tideloom.operators.joins import band_join

    values = spark.range(-500, 1500).select(F.col("id").alias("v"))
    rows = [(i, i * 7 - 300, i * 7 - 300 + n) for i, n in enumerate([0, 1, 2, 3, 8, 9, 100, 101, 1024, 1025, 5])]
    rows += [(90, -10**12, 10**12), (91, 1499, 10**9), (92, 5, 5), (93, 9, 3), (94, None, 3)]
    bands = spark.createDataFrame(rows, "band long, lo long, hi long")
    got = sorted(map(tuple, band_join(values, bands, "v", "lo", "hi", 4).select("band", "v").collect()))
    assert got == sorted((b, v) for b, lo, hi in rows if lo is not None for v in range(-500, 1500) if lo <= v < hi)
    assert band_join(values, bands.limit(0), "v", "lo", "hi", 4).collect() == []
