"""Live results over many micro-batches equal one pass over the whole table."""

import pytest
from pyspark.sql import functions as F

import checking
from tideloom.plans import stream_queries as Q
from tideloom.session import table


@pytest.fixture(scope="module")
def split(spark, data, tmp_path_factory):
    """The events as a folder of files that arrive in time order."""
    folder = tmp_path_factory.mktemp("split")
    events = table(spark, data, "events")
    for i in range(4):
        part = events.filter(F.floor(F.col("event_id") / 250) == i).coalesce(1)
        part.write.mode("append").parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", [
    "stream_watermark_count", "stream_watermark_hook", "stream_timer", "stream_early_panes", "stream_ttl_join",
    "stream_session_count", "task_process", "eos_flush", "stream_table_live", "stream_table_join",
    "stream_interval_join", "stream_user_timers", "stream_watermark_function",
])
def test_many_batches_equal_one(spark, data, split, name, monkeypatch):
    one = checking.spark_rows(getattr(Q, name)(spark, data))
    original = Q.live
    monkeypatch.setattr(Q, "live", lambda s, folder, n, **limits: original(s, folder, n, max_files=1))
    assert checking.spark_rows(getattr(Q, name)(spark, split)) == one


def test_repeated_batch_replaces_itself(spark, tmp_path):
    from tideloom.sources.sinks import each_batch

    write = each_batch(str(tmp_path / "o"))
    for _ in range(2):
        write(spark.range(5), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 7


def test_a_second_run_goes_on_where_the_first_ended(spark, data, tmp_path):
    from tideloom.sources.streams import live
    from tideloom.streaming.runs import run_to_table

    events, source = table(spark, data, "events"), tmp_path / "in"
    events.filter("event_id < 300").write.parquet(str(source / "events.parquet"))
    state = str(tmp_path / "job")

    def again():
        return run_to_table(live(spark, str(source), "events").select("event_id"), "resume", folder=state)

    assert again().count() == 300
    events.filter("event_id >= 300 AND event_id < 450").write.mode("append").parquet(str(source / "events.parquet"))
    seen = again()
    assert seen.count() == 450 and seen.distinct().count() == 450


def test_state_tables_survive_a_restart(spark, data, split, tmp_path):
    from tideloom.streaming.runs import run_with_state

    def step(rows, state, before, after):
        total = rows.groupBy("k").count().unionByName(state).groupBy("k").agg(F.sum("count").alias("count"))
        return rows.select("event_id"), total

    def go():
        stream = Q.live(spark, split, "events", max_files=1).select("event_id", F.lit(1).alias("k"), F.col("event_id").alias("c"))
        return run_with_state(stream, "restart", step, "k int, count bigint", "c", 0, folder=str(tmp_path / "job"))

    n = go().count()
    assert n == table(spark, data, "events").count()
    assert go().count() == n  # nothing new: nothing is processed again
    states = [spark.read.parquet(str(tmp_path / "job" / f"state-{i}" / "rows")).first()["count"] for i in (0, 1)]
    assert max(states) == n


@pytest.fixture(scope="module")
def shuffled(spark, data, tmp_path_factory):
    """The same events in files that overlap on the clock: every third row comes a file later, within the delay."""
    folder = tmp_path_factory.mktemp("shuffled")
    events = table(spark, data, "events")
    late = F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    for i in range(5):
        part = events.filter(F.floor(F.col("event_id") / 250) + late == i).coalesce(1)
        part.write.mode("append").parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["stream_ttl_join", "stream_table_join", "stream_table_live"])
def test_files_out_of_order_give_the_results_of_files_in_order(spark, data, shuffled, name, monkeypatch):
    one = checking.spark_rows(getattr(Q, name)(spark, data))
    original = Q.live
    monkeypatch.setattr(Q, "DELAY", "30 days")
    monkeypatch.setattr(Q, "live", lambda s, folder, n, **limits: original(s, folder, n, max_files=1))
    assert checking.spark_rows(getattr(Q, name)(spark, shuffled)) == one


def _stream(spark, folder, files, schema):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


CHANGES = "id bigint, k bigint, ms bigint, kind string, v bigint"


def test_a_row_that_comes_late_finds_the_older_version(spark, tmp_path):
    from tideloom.streaming import tables as ST

    minute = 60  # a whole number is a clock in seconds
    files = [[(1, 7, 0, "change", 10), (2, 7, 5 * minute, "change", 20)], [(3, 7, 2 * minute, "row", None)], [(4, 7, 40 * minute, "row", None)]]
    source = _stream(spark, tmp_path / "in", files, CHANGES)
    got = ST.table_join(
        source.filter("kind = 'row'").select("id", "k", "ms"), source.filter("kind = 'change'"),
        key="k", ts="ms", tie="id", columns=["v"], delay="10 minutes", name="late",
    )
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(3, 10), (4, 20)]
    joined = ST.ttl_join(
        source.filter("kind = 'change'"), source.filter("kind = 'row'"), key="k", ts="ms", tie="id", delay="10 minutes",
        ttl="1 hour", left_id="id", right_id="v", name="late-ttl",
    )
    assert sorted(r["joined_ms"] // 60_000 for r in joined.collect()) == [2, 5, 40]


def test_only_touched_buckets_are_replaced(spark, tmp_path):
    from tideloom.streaming.buckets import BucketTable

    t = BucketTable(spark, str(tmp_path / "t"), "k bigint, v bigint", ["k"], buckets=8)
    everything = spark.range(100).selectExpr("id AS k", "0L AS v")
    t.write(0, everything, t.touched(everything))
    some = spark.createDataFrame([(3, 1), (4, 1)], "k bigint, v bigint")
    touched = t.touched(some)
    assert 0 < len(touched) <= 2
    kept = t.read(0, touched).filter("k not in (3, 4)").unionByName(some)
    for _ in range(2):  # a repeated batch gives the same
        t.write(1, kept, touched)
        assert t.read(1).count() == 100 and t.read(1).filter("v = 1").count() == 2
    changed = {k for k, v in t.versions(1).items() if v == 1}
    assert changed == set(touched)
    t.write(2, kept.limit(0), touched)
    assert t.read(2).count() == 100 - kept.count()


@pytest.mark.parametrize("name", ["stream_ttl_join", "stream_table_join", "stream_table_live", "stream_early_panes", "stream_timer", "stream_user_timers", "stream_watermark_function", "stream_watermark_count"])
def test_no_input_yet_gives_an_empty_table(spark, data, tmp_path, name, monkeypatch):
    schema = table(spark, data, "events").schema
    (tmp_path / "none").mkdir()
    monkeypatch.setattr(Q, "live", lambda s, *_, **__: s.readStream.schema(schema).parquet(str(tmp_path / "none")))
    assert getattr(Q, name)(spark, data).collect() == []


@pytest.mark.parametrize("trigger,accumulating,window", [
    (0, False, {"tumbling": "1 day"}), (1, True, {"session": "6 hours"}), (2, False, {"session": "6 hours"}), (3, True, {"tumbling": "1 day"}),
])
def test_live_panes_equal_batch_panes(spark, data, shuffled, window, accumulating, trigger):
    """Every trigger over files out of order: what fired by the watermark is what the batch form gives."""
    from tideloom.operators import panes as P
    from tideloom.operators.aggregates import cents
    from tideloom.streaming import tables as ST

    early = [
        P.Count(2), P.Repeat(P.SinceFirst("3 hours")), P.SinceLast("2 hours"),
        P.Repeat(P.AnyOf((P.Count(3), P.SinceFirst("5 hours"), P.SinceLast("1 hour")))),
    ][trigger]
    more = {"keys": ["user_id"], "ts": "ts", "tie": "event_id", "early": early, "accumulating": accumulating, **window}
    aggs = {"n": ("count", None), "top": ("max", "cents")}
    events = table(spark, data, "events").withColumn("cents", cents("value"))
    mark = events.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0] - 12 * 86_400_000
    want = P.panes(events, aggs=aggs, fired="fired_ms", **more).filter(F.col("fired_ms") <= mark)
    stream = Q.live(spark, shuffled, "events", max_files=1).withColumn("cents", cents("value"))
    got = ST.live_panes(stream, aggs=aggs, delay="12 days", name="any", **more)
    late = got.filter("firing_type = 'LATE'").count()
    assert late == 0
    assert checking.spark_rows(got) == checking.spark_rows(want)


def test_messages_of_closed_windows_come_out_late(spark, tmp_path):
    from tideloom.operators import panes as P
    from tideloom.streaming import tables as ST

    hour = 3600
    files = [[(1, 7, 0, "x", 1), (2, 7, 30 * hour, "x", 2)], [(3, 7, 5 * hour, "x", 4), (4, 7, 29 * hour, "x", 8)], [(5, 7, 90 * hour, "x", 16)]]
    for i, window in enumerate(({"tumbling": "1 day"}, {"session": "3 hours"})):
        source = _stream(spark, tmp_path / f"in{i}", files, CHANGES).withColumn("at", F.timestamp_seconds("ms"))
        got = ST.live_panes(
            source, keys=["k"], ts="at", tie="id", aggs={"s": ("sum", "v")}, early=P.Count(100), delay="2 hours", name="late", **window
        ).collect()
        found = sorted((r["firing_type"], r["s"]) for r in got)
        assert found == [("DEFAULT", 1), ("DEFAULT", 10), ("LATE", 4)]


def test_timers_are_rescheduled_deleted_and_fire_by_the_watermark(spark, tmp_path):
    import datetime as D

    from tideloom.streaming.runs import run_to_table
    from tideloom.streaming.timers import with_timers

    at = lambda s: D.datetime(2024, 1, 1) + D.timedelta(seconds=s)
    big = 2**60 + 1
    rows = [
        ("a", at(5), 2, "set", 20), ("a", at(1), big, "set", 9), ("a", at(2), None, "drop", None), ("a", at(6), 4, "set", 30),
        ("b", at(3), 5, "set", 4), ("b", at(7), 6, "note", None), ("b", at(50), 7, "set", 55), (None, at(2), 8, "set", 3),
        ("c", at(90), 9, "set", 1), ("d", None, 10, "set", 1), ("b", at(4), big, "note", None),
    ]
    schema = "k string, ts timestamp, id bigint, kind string, due bigint"
    for i, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    base = int(at(0).replace(tzinfo=D.timezone.utc).timestamp() * 1000)

    def message(context, row):
        context.state = (context.state or []) + [row["id"]]
        if row["kind"] == "set":
            context.schedule("t", base + row["due"] * 1000)
        elif row["kind"] == "drop":
            context.delete("t")

    def timer(context, name, due):
        context.emit(context.key, name, (due - base) // 1000, str(context.state))

    for limit in ({}, {"maxFilesPerTrigger": 1}):
        stream = spark.readStream.schema(schema).options(**limit).parquet(str(tmp_path / "in" / "*"))
        fired = with_timers(stream, "k", "ts", ["id"], "60 seconds", message, timer, "k string, name string, due bigint, seen string")
        got = sorted(map(tuple, run_to_table(fired, "timers").collect()))
        # the watermark ends at 90 - 60 s; a timer at 30 has not been passed, one at 4 comes before the message at 4
        assert got == [("b", "t", 4, "[5]")]


def test_an_output_watermark_never_goes_back(spark, tmp_path):
    from tideloom.streaming.runs import run_to_table
    from tideloom.streaming.timers import with_watermark

    schema = "k string, ts timestamp, id bigint"
    spark.sql("SELECT 'a' AS k, timestamp_seconds(id * 10) AS ts, id FROM range(30)").coalesce(1).write.parquet(str(tmp_path / "in"))
    told = []

    def watermark(context, mark):
        context.emit(context.key, mark)
        return mark - 5_000 if mark % 120_000 else mark - 100_000

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = with_watermark(stream, "k", "ts", ["id"], "10 seconds", "1 minute", lambda c, m: None, watermark, "k string, mark bigint")
    rows = run_to_table(out, "marks").collect()
    assert sorted(r["mark"] for r in rows if r["mark"] is not None) == [60_000, 120_000, 180_000, 240_000]
    told = sorted(r["_mark"].timestamp() for r in rows if r["mark"] is None)
    assert told == [55.0, 175.0]


@pytest.mark.parametrize("max_files", [None, 1])
def test_the_end_of_a_stream_reads_the_input_once(spark, data, split, max_files):
    from tideloom.sources.streams import live
    from tideloom.streaming import windows as SW

    count = [F.count(F.lit(1)).alias("n")]
    daily = lambda stream: SW.tumbling(stream, "ts", "10 minutes", "1 day", count, ["event_type"])
    out, taken = SW.run_to_end(live(spark, split, "events", max_files=max_files), "ts", "end", daily)
    rows = spark.read.parquet(f"{split}/events.parquet").count()
    assert taken == rows + 1 and out.agg(F.sum("n")).first()[0] == rows


def test_sessions_end_too(spark, data, split):
    from tideloom.sources.streams import live
    from tideloom.streaming import windows as SW

    count = [F.count(F.lit(1)).alias("n")]
    out, _ = SW.run_to_end(live(spark, split, "events"), "ts", "end", lambda s: SW.sessions(s, "ts", "10 minutes", "6 hours", count, ["user_id"]))
    assert out.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{split}/events.parquet").count()


@pytest.fixture
def one_partition(spark):
    """Few keys need one state store only."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_key_is_never_held_whole(spark, tmp_path, one_partition):
    """All messages of one key come at once: each is taken in order, and few of them are in memory at a time."""
    import gc

    from tideloom.streaming.runs import run_to_table
    from tideloom.streaming.timers import with_timers

    n = 12_000
    mixed = f"SELECT 'a' AS k, timestamp_seconds(1 + id * 7919 % {n}) AS ts, id * 7919 % {n} AS id FROM range({n})"
    spark.sql(mixed).coalesce(1).write.parquet(str(tmp_path / "in"))

    def message(context, row):
        nth = (context.state or 0) + 1
        context.state = nth
        if nth % 4_000 == 100:
            alive = sum(type(o) is dict and "id" in o and "ts" in o for o in gc.get_objects())
            context.emit(context.key, nth, row["id"], alive)

    stream = spark.readStream.schema("k string, ts timestamp, id bigint").parquet(str(tmp_path / "in"))
    out = with_timers(stream, "k", "ts", ["id"], "0 seconds", message, lambda *_: None, "k string, nth bigint, id bigint, alive bigint")
    rows = sorted(map(tuple, run_to_table(out, "hot").collect()))
    assert [r[:3] for r in rows] == [("a", i + 100, i + 99) for i in range(0, n, 4_000)]
    assert 0 < max(r[3] for r in rows) < 5_000


class _Parts(dict):
    getValue, removeKey = dict.__getitem__, dict.__delitem__

    def updateValue(self, place, value):
        assert place not in self
        self[place] = value


def test_waiting_messages_come_in_order_from_many_runs(monkeypatch):
    import json
    import random

    import pyarrow as pa

    from tideloom.streaming import timers as TM

    for name, value in {"RUN_BYTES": 3_000, "PART_ROWS": 7, "MAX_RUNS": 4, "TAIL_BYTES": 400}.items():
        monkeypatch.setattr(TM, name, value)
    chance, parts, runs, tail = random.Random(5), _Parts(), [], None
    big = 2**60
    given = [(chance.randrange(300), chance.choice([None, "x", "y", "z"]), chance.choice([None, big + i]), i) for i in range(3_000)]
    order = lambda r: (r[0], r[1] is None, r[1] or "", r[2] is None, r[2] or 0)
    got, most = [], 0
    for call, mark in enumerate([0, 0, 40, 40, 200, 120, 250, 999]):
        waiting = TM.Waiting(parts, json.loads(json.dumps(runs)), tail, ["s", "big"], ["big", "nth"])
        for at in range(call * 500, min(call * 500 + 500, len(given)), 50):
            block = list(zip(*given[at : at + 50]))
            schema = pa.schema([("_clock", pa.int64()), ("s", pa.string()), ("big", pa.int64()), ("nth", pa.int64())])
            waiting.add(pa.table([pa.array(c, t) for c, t in zip(block, schema.types)], schema=schema))
        taken = [tuple(m[c] for c in ("_clock", "s", "big", "nth")) for m in waiting.take(mark)]
        assert [order(r) for r in taken] == sorted(order(r) for r in taken) and all(r[0] < mark for r in taken)
        got += taken
        tail = waiting.kept()
        runs, most = waiting.runs, max(most, len(parts))
        left = [r[0] for r in given[: call * 500 + 500] if r[0] >= mark and r not in got]
        assert waiting.clock() == min(left, default=None) and len(runs) <= TM.MAX_RUNS
    assert sorted(got, key=lambda r: r[3]) == given
    assert most > 100 and not parts and not runs and tail is None


def test_small_runs_and_parts_give_the_same_rows(spark, data, split, monkeypatch, one_partition):
    from tideloom.streaming import timers as TM

    one = checking.spark_rows(Q.stream_user_timers(spark, data))
    for name, value in {"RUN_BYTES": 500, "PART_ROWS": 3, "MAX_RUNS": 2, "TAIL_BYTES": 100, "OUTPUT_ROWS": 2}.items():
        monkeypatch.setattr(TM, name, value)
    original = Q.live
    monkeypatch.setattr(Q, "live", lambda s, folder, n, **limits: original(s, folder, n, max_files=2))
    assert checking.spark_rows(Q.stream_user_timers(spark, split)) == one


@pytest.mark.parametrize("key", ["timestamp_seconds(1.5)", "CAST('2024-03-10 02:30:00' AS timestamp_ntz)", "named_struct('a', 1L)", "DATE '2024-01-01'"])
def test_a_timer_sees_the_key_that_a_message_sees(spark, tmp_path, key, one_partition):
    from tideloom.streaming.runs import run_to_table
    from tideloom.streaming.timers import with_timers

    spark.sql(f"SELECT {key} AS k, timestamp_seconds(id * 100) AS ts, id FROM range(4)").coalesce(1).write.parquet(str(tmp_path / "in"))

    def message(context, row):
        context.emit("message", repr(row["k"]))
        context.emit("message", repr(context.key))
        context.schedule("t", context.now + 50_000)

    def timer(context, name, due):
        context.emit("timer", repr(context.key))

    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    out = run_to_table(with_timers(stream, "k", "ts", ["id"], "0 seconds", message, timer, "what string, key string"), "keys")
    rows = [tuple(r) for r in out.collect()]
    assert {w for w, _ in rows} == {"message", "timer"} and len({k for _, k in rows}) == 1
