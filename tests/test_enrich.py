"""Retry, rate limit, cache and lookups."""

import pytest

from tideloom.operators import enrich as EN


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_retry_waits():
    assert [EN.Retry(delay_ms=10, max_delay_ms=50).wait_s(n) for n in (1, 2, 3, 4)] == [0.01, 0.02, 0.04, 0.05]
    assert EN.Retry(backoff="none").wait_s(3) == 0 and EN.Retry(backoff="fixed", delay_ms=7).wait_s(3) == 0.007
    assert 0.01 <= EN.Retry(backoff="random", delay_ms=10, max_delay_ms=20).wait_s(1) <= 0.02
    with pytest.raises(ValueError):
        EN.Retry(backoff="hope").wait_s(1)


def test_retry_gives_up_and_respects_the_predicate():
    calls = []

    def fail(x):
        calls.append(x)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        EN.Retry(attempts=3, backoff="none").run(fail, 1)
    assert len(calls) == 3
    with pytest.raises(ConnectionError):
        EN.Retry(attempts=3, backoff="none", retriable=lambda e: False).run(fail, 1)
    assert len(calls) == 4


def test_token_bucket_keeps_the_rate():
    clock = Clock()
    bucket = EN.TokenBucket(10, clock, clock.sleep)
    for _ in range(50):
        bucket.take(2)
    assert clock.now == pytest.approx(10.0)


def test_cache_evicts_and_expires():
    clock = Clock()
    cache = EN.Cache(2, 5, clock)
    cache.put("a", 1), cache.put("b", 2)
    assert cache.get("a") == (True, 1)
    cache.put("c", 3)
    assert cache.get("b") == (False, None) and cache.get("a") == (True, 1)
    clock.now = 5
    assert cache.get("a") == (False, None)
    cache.put("n", None)
    assert cache.get("n") == (True, None)
    cache.drop("n")
    assert cache.get("n") == (False, None)


class Squares:
    def __call__(self, keys):
        assert len(keys) <= 3 and len(set(keys)) == len(keys)
        return {k: {"sq": k[0] ** 2} for k in keys if k[0] is not None and k[0] != 4}


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("in_place", [False, True])
def test_enrich(spark, how, in_place):
    df = spark.createDataFrame([(i, None if i % 6 == 5 else i % 6) for i in range(60)], "id bigint, k bigint")
    fn = EN.enrich_in_place if in_place else EN.enrich
    got = fn(df, ["k"], Squares, "sq bigint", how, access=EN.Access(batch_size=3, concurrency=2)).collect()
    want = {i: (i % 6) ** 2 if i % 6 < 4 else None for i in range(60)}
    if how == "inner":
        want = {i: v for i, v in want.items() if v is not None}
    assert {r["id"]: r["sq"] for r in got} == want


def test_failing_lookup_fails_the_query(spark):
    class Down:
        def __call__(self, keys):
            raise ConnectionError("down")

    with pytest.raises(Exception, match="down"):
        EN.enrich(spark.range(2), ["id"], Down, "x bigint").collect()


def test_bulk_upsert_counts_conflicts_and_raises_on_failures(spark):
    class Index:
        def __call__(self, requests):
            return ["failed" if r["id"] == 99 else "conflict" if r["id"] % 2 else "insert" for r in requests]

    got = EN.bulk_upsert(spark.range(10), Index, EN.Access(batch_size=4)).groupBy("outcome").sum("n").collect()
    assert {r[0]: r[1] for r in got} == {"insert": 5, "conflict": 5}
    with pytest.raises(Exception, match="1 requests failed"):
        EN.bulk_upsert(spark.range(100), Index).collect()


def test_kept_lookups_are_read_from_the_shared_folder(spark):
    df = EN.enrich(spark.range(9), ["id"], Squares, "sq bigint", access=EN.Access(batch_size=3), keep=True)
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["sq"] for r in df.collect()} == {i: None if i == 4 else i * i for i in range(9)}


# --- types, attempts, limits, caches


BIG = 2**53 + 1
ODD_KEYS = [(1, BIG), (2, None), (3, -BIG), (4, 5)]


def _odd(spark):
    return spark.createDataFrame(ODD_KEYS, "id bigint, k bigint")


class Echo:
    """Answers with the key itself, as it came."""

    def __call__(self, keys):
        assert all(type(k) is int for (k,) in keys), keys
        return {(k,): {"same": k, "text": str(k)} for (k,) in keys}


@pytest.mark.parametrize("fn", [EN.enrich, EN.enrich_in_place])
def test_lookup_keys_and_values_keep_their_type(spark, fn):
    got = fn(_odd(spark), ["k"], Echo, "same bigint, text string").select("id", "k", "same", "text")
    want = [(i, k, k, None if k is None else str(k)) for i, k in ODD_KEYS]
    assert sorted(map(tuple, got.collect())) == want


def test_written_records_keep_their_type(spark):
    class Writer:
        def __call__(self, records):
            assert {(r["id"], r["k"]) for r in records} <= set(ODD_KEYS), records
            return len(records)

    class Index:
        def __call__(self, records):
            return ["insert" if (r["id"], r["k"]) in ODD_KEYS else "failed" for r in records]

    assert EN.write_remote(_odd(spark), Writer).agg({"written": "sum"}).first()[0] == 4
    assert EN.bulk_upsert(_odd(spark), Index).agg({"n": "sum"}).first()[0] == 4


def test_each_attempt_takes_credits():
    clock = Clock()
    calls = []

    def flaky(items):
        calls.append(clock())
        if len(calls) < 5:
            raise ConnectionError
        return {}

    access = EN.Access(retry=EN.Retry(5, "none"), limit=EN.RateLimit(1.0), tasks=1)
    bucket = EN.TokenBucket
    try:
        EN.TokenBucket = lambda rate: bucket(rate, clock, clock.sleep)
        EN._caller(flaky, access)([1])
    finally:
        EN.TokenBucket = bucket
    assert calls == [1, 2, 3, 4, 5]


def test_threads_share_a_bucket_without_losing_credits():
    import threading

    slept = []
    bucket = EN.TokenBucket(1_000.0, lambda: 0.0, slept.append)
    threads = [threading.Thread(target=lambda: [bucket.take(1) for _ in range(2_000)]) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(slept) == 16_000 and max(slept) == pytest.approx(16.0)


def test_retry_stops_after_a_total_time_and_backs_off_by_its_factor():
    clock = Clock()
    calls = []

    def fail():
        calls.append(clock())
        raise ConnectionError

    policy = EN.Retry(100, "exponential", delay_ms=1_000, max_delay_ms=60_000, factor=3.0, stop_after_ms=20_000)
    with pytest.raises(ConnectionError):
        policy.run(fail, clock=clock, sleep=clock.sleep)
    assert calls == [0, 1, 4, 13]


def test_limited_calls_run_in_the_given_number_of_tasks(spark):
    access = EN.Access(limit=EN.RateLimit(1e9), tasks=2)
    rows = spark.range(0, 100, 1, 8).withColumnRenamed("id", "k")
    for df in (EN.enrich_in_place(rows, ["k"], Echo, "same bigint", access=access), EN.bulk_upsert(rows, lambda: lambda r: ["update"] * len(r), access)):
        assert df.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("through", [True, False])
def test_cached_table_writes_through_or_around(through):
    clock = Clock()
    remote, reads = {"a": 1}, []

    def read(keys):
        reads.append(list(keys))
        return {k: remote[k] for k in keys if k in remote}

    def write(entries):
        for k, v in entries.items():
            remote.pop(k, None) if v is None else remote.__setitem__(k, v * 10)

    t = EN.CachedTable(read, write, EN.Cache(10, 5, clock), through)
    assert t.get_all(["a", "b", "a"]) == {"a": 1, "b": None} and reads == [["a", "b"]]
    t.put_all({"a": 2, "b": 3})
    assert t.get_all(["a", "b"]) == ({"a": 2, "b": 3} if through else {"a": 20, "b": 30})
    assert len(reads) == (1 if through else 2)
    clock.sleep(5)  # the entries are too old since they were written
    assert t.get_all(["a"]) == {"a": 20}
    t.put_all({"a": None})
    assert t.get_all(["a"]) == {"a": None}


def test_idle_entries_end():
    clock = Clock()
    cache = EN.Cache(10, None, clock, idle_ttl_s=3)
    cache.put("a", 1)
    for _ in range(4):
        clock.sleep(2)
        assert cache.get("a") == (True, 1)
    clock.sleep(3)
    assert cache.get("a") == (False, None)


class _Recorded:
    """Writes get a mark; every read of the remote table is counted by the answer."""

    def __init__(self):
        self.entries, self.reads = {}, 0

    def read(self, keys):
        self.reads += 1
        return {k: f"{self.entries[k]}/{self.reads}" for k in keys if k in self.entries}

    def write(self, entries):
        self.entries.update({k: v for k, v in entries.items() if v is not None})
        for k in [k for k, v in entries.items() if v is None]:
            self.entries.pop(k, None)


def test_cached_access_through_around_and_small(spark):
    ops = [
        (0, 1, "read", None), (1, 1, "write", "a"), (2, 1, "read", None), (3, 1, "read", None), (4, 1, "delete", None),
        (5, 1, "read", None), (6, None, "write", "x"), (7, None, "read", None), (8, 2, "write", "b"), (9, 2, "write", "c"),
        (10, 2, "read", None), (11, 1, "read", None),
    ]
    df = spark.createDataFrame(ops, "at bigint, k bigint, op string, value string").repartition(1)

    def run(**options):
        got = EN.cached_access(df, ["k"], ["at"], _Recorded, access=EN.Access(limit=EN.RateLimit(10_000), tasks=1), **options)
        return {r["at"]: (r["answer"], r["hit"]) for r in got.collect() if r["op"] == "read"}

    nothing = {0: (None, False), 7: (None, None)}
    assert run(through=True) == nothing | {2: ("a", True), 3: ("a", True), 5: (None, True), 10: ("c", True), 11: (None, True)}
    assert run(through=False) == nothing | {2: ("a/2", False), 3: ("a/2", True), 5: (None, False), 10: ("c/4", False), 11: (None, True)}
    # one entry: what key 2 pushed out is fetched again
    assert run(through=True, cache_size=1)[11] == (None, False)
    assert EN.cached_access(df.limit(0), ["k"], ["at"], _Recorded).collect() == []


def test_a_limit_that_does_not_wait_is_seen(spark, data, monkeypatch):
    from tideloom.operators import enrich
    from tideloom.plans.flow_queries import limit_held

    assert limit_held(spark, data, 400).first()["held"]
    monkeypatch.setattr(enrich.TokenBucket, "take", lambda self, credits: None)
    assert not limit_held(spark, data, 400).first()["held"]
