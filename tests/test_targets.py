"""Files rolled by bytes and versioned targets, against plain Python."""

import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideloom.operators import targets as TG
from tideloom.operators.ordered import Slicing
from tideloom.sources import sinks as SI


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), max_size=12), max_size=5), st.integers(1, 40))
def test_roll_files(batches, bound):
    given_batches = [pa.RecordBatch.from_pydict({"_bytes": pa.array(b, pa.int64())}) for b in batches]
    got = [f for out in SI.roll_files(iter(given_batches), bound, 3) for f in out.column("roll_file").to_pylist()]
    want, number, used = [], 0, 0
    for size in (x for b in batches for x in b):
        if used and used + size > bound:
            number, used = number + 1, 0
        used += size
        want.append(number)
    assert got == want


def test_one_large_record_leaves_the_other_files_full(spark, tmp_path):
    rows = [(i, "y" * 5_000 if i == 700 else "x" * (i % 7)) for i in range(2_000)]
    path = str(tmp_path / "out")
    SI.write_rolled(spark.createDataFrame(rows, "id bigint, s string").coalesce(1), path, size_bytes=1_000, fmt="json")
    files = spark.read.format("binaryFile").load(path).orderBy("roll_file").collect()
    lengths = [r["length"] for r in files]
    assert [n for n in lengths if n > 1_000] == [5_000 + len('{"id":700,"s":""}') + 1]
    longest = len(json.dumps({"id": 1999, "s": "x" * 6}, separators=(",", ":"))) + 1
    big = lengths.index(max(lengths))
    assert all(n + longest > 1_000 for k, n in enumerate(lengths[:-1]) if k not in (big - 1, big))
    assert [json.loads(x)["id"] for r in files for x in r["content"].decode().splitlines()] == list(range(2_000))
    assert sorted(map(tuple, spark.read.schema("id bigint, s string").json(path).select("id", "s").collect())) == sorted(rows)


def test_rolling_of_nothing_and_of_nulls(spark, tmp_path):
    df = spark.createDataFrame([(None, None), (1, None)], "a bigint, b string")
    SI.write_rolled(df, str(tmp_path / "nulls"), size_bytes=1)
    assert spark.read.parquet(str(tmp_path / "nulls")).filter("roll_file >= 0").count() == 2
    SI.write_rolled(df.limit(0), str(tmp_path / "none"), size_bytes=1, fmt="json")
    with pytest.raises(ValueError):
        SI.write_rolled(df, str(tmp_path / "both"), records=1, size_bytes=1)


def plain_upserts(requests):
    best, out = {}, {}
    for at, event, ident, version in sorted(requests, key=lambda r: r[:2]):
        if ident is None or version is None:
            out[event] = "failed"
        elif ident not in best:
            out[event], best[ident] = "insert", version
        elif version > best[ident]:
            out[event], best[ident] = "update", version
        else:
            out[event] = "conflict"
    return out, best


@pytest.mark.parametrize("slicing", [None, Slicing((20.0, 45.0, 70.0))])
def test_upserts_equal_the_plain_version(spark, tmp_path, slicing):
    rng = random.Random(4)
    requests = [
        (rng.randrange(90), i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.randrange(40), rng.randrange(40), None]))
        for i in range(400)
    ]
    df = spark.createDataFrame(requests, "at bigint, event bigint, ident bigint, version bigint")
    path = str(tmp_path / "table")
    outcomes = {}
    for batch, (lo, hi) in enumerate([(0, 30), (30, 60), (60, 90)]):
        part = df.filter((F.col("at") >= lo) & (F.col("at") < hi))
        for _ in range(2):  # a batch may be sent again
            done = TG.upsert_batch(part, path, batch, ident="ident", version="version", order=["at", "event"], slicing=slicing)
        outcomes |= {r["event"]: r["outcome"] for r in done.collect()}
    want, best = plain_upserts(requests)
    assert outcomes == want and set(want.values()) == {"insert", "update", "conflict", "failed"}
    assert {r["ident"]: r["version"] for r in TG.stored(spark, path, "ident", "version").collect()} == best
    # an earlier batch sent once more does not see the later ones
    again = TG.upsert_batch(df.filter("at < 30"), path, 0, ident="ident", version="version", order=["at", "event"])
    assert {r["event"]: r["outcome"] for r in again.collect()} == {r[1]: want[r[1]] for r in requests if r[0] < 30}
    assert TG.stored(spark, str(tmp_path / "nothing"), "ident", "version") is None
