"""Queries that run as Structured Streaming over all available input."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.times import millis
from tideloom.operators.aggregates import cents
from tideloom.operators.panes import Count, Repeat, SinceFirst
from tideloom.plans import join_queries  # noqa: F401  (its SQL is used here)
from tideloom.plans.jobs import SqlJob
from tideloom.plans.registry import ORACLES, query
from tideloom.plans.window_queries import DAY, EV, HOUR, rows
from tideloom.session import shared_folder, table
from tideloom.sources.streams import live
from tideloom.streaming import stateful as SF
from tideloom.streaming import tables as ST
from tideloom.streaming import timers as TM
from tideloom.streaming import windows as SW
from tideloom.streaming.runs import hand_over, run_to_table

DELAY, DELAY_MS = "10 minutes", 600_000
MARK = f"(SELECT max(epoch_us(ts) // 1000) - {DELAY_MS} FROM events)"


def live_events(spark, sf, **limits):
    return live(spark, sf, "events", **limits).withColumn("cents", cents("value"))


@query("stream_watermark_count", f"""
SELECT event_type, pane_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents FROM (SELECT *, ms - ms % {HOUR} AS pane_id FROM {EV}) WHERE pane_id + {HOUR} <= {MARK} GROUP BY ALL""")
def stream_watermark_count(spark, sf):
    closed = SW.tumbling(live_events(spark, sf), "ts", DELAY, "1 hour", [rows("n"), F.sum("cents").alias("sum_cents")], ["event_type"])
    return run_to_table(closed, "watermark-count")


@query("stream_chained_windows", f"""
SELECT event_type, inner_id - inner_id % {6 * HOUR} AS pane_id, max(n) AS busiest, count(*) AS windows FROM (
  SELECT event_type, ms - ms % {HOUR} AS inner_id, count(*) AS n FROM {EV} GROUP BY ALL) WHERE inner_id - inner_id % {6 * HOUR} + {6 * HOUR} <= {MARK} GROUP BY ALL""")
def stream_chained_windows(spark, sf):
    chained = SW.chained(
        live_events(spark, sf), "ts", DELAY, "1 hour", "6 hours", rows("n"),
        [F.max("n").alias("busiest"), rows("windows")], ["event_type"],
    )
    return run_to_table(chained, "chained")


@query("stream_session_count", f"""
SELECT user_id, min(ms) AS pane_id, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS isl FROM (
  SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > {6 * HOUR}000 THEN 1 ELSE 0 END AS brk FROM {EV}))
GROUP BY user_id, isl HAVING max(epoch_us(ts)) + {6 * HOUR}000 <= {MARK} * 1000""")
def stream_session_count(spark, sf):
    return run_to_table(SW.sessions(live_events(spark, sf), "ts", DELAY, "6 hours", [rows("n")], ["user_id"]), "sessions")


@query("eos_flush", f"SELECT event_type, ms - ms % {DAY} AS pane_id, count(*) AS n FROM {EV} GROUP BY ALL")
def eos_flush(spark, sf):
    """At the end of a bounded stream every window comes out, also those still open."""
    daily = lambda stream: SW.tumbling(stream, "ts", DELAY, "1 day", [rows("n")], ["event_type"])
    return SW.run_to_end(live_events(spark, sf), "ts", "eos", daily)[0]


@query("stream_dedup", "SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf):
    """Every message arrives twice; one of each stays."""
    twice = live_events(spark, sf).unionByName(live_events(spark, sf)).select("event_id", "ts", "user_id")
    return run_to_table(SW.deduplicated(twice, "ts", DELAY, ["event_id"]).drop("ts"), "dedup")


@query("stream_watermark_hook", f"""
SELECT user_id, max(ms) + {6 * HOUR} AS reported_ms, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS isl FROM (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= {6 * HOUR} THEN 1 ELSE 0 END AS brk FROM {EV}))
GROUP BY user_id, isl HAVING max(ms) + {6 * HOUR} <= {MARK} OR isl < (SELECT max(i) FROM (SELECT user_id AS u, sum(b) AS i FROM (
  SELECT user_id, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= {6 * HOUR} THEN 1 ELSE 0 END AS b FROM {EV}) GROUP BY user_id) z WHERE z.u = user_id)""")
def stream_watermark_hook(spark, sf):
    return run_to_table(SF.idle_reports(live_events(spark, sf), "user_id", "ts", DELAY, "6 hours"), "hook")


@query("stream_timer", f"""
SELECT user_id, event_id AS armed_by, ms + {HOUR} AS due_ms FROM (
  SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next_ms FROM {EV} WHERE event_type IN ('view', 'purchase'))
WHERE event_type = 'view' AND (next_ms >= ms + {HOUR} OR (next_ms IS NULL AND ms + {HOUR} <= (SELECT max(ms) - {DELAY_MS} FROM {EV} WHERE event_type IN ('view', 'purchase'))))""")
def stream_timer(spark, sf):
    """A view that no purchase (or newer view) follows within an hour."""
    return ST.key_timers(
        live_events(spark, sf), "user_id", "ts", "event_id", DELAY, "1 hour", "view", "purchase", "event_type", "timer"
    )


def remind(context, message):
    """A view asks for a reminder in an hour, a purchase calls it off."""
    if message["event_type"] == "view":
        context.state = [message["event_id"], 0]
        context.schedule("reminder", context.now + HOUR)
    elif message["event_type"] == "purchase":
        context.delete("reminder")


def reminded(context, name, due):
    """Up to three reminders, an hour apart."""
    armed_by, before = context.state
    context.emit(context.key, armed_by, before + 1, due)
    context.state = [armed_by, before + 1]
    if before + 1 < 3:
        context.schedule(name, due + HOUR)


@query("stream_user_timers", f"""
SELECT user_id, event_id AS armed_by, nth, ms + nth * {HOUR} AS due_ms FROM (
  SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS next_ms FROM {EV} WHERE event_type IN ('view', 'purchase')) v,
  (SELECT unnest([1, 2, 3])::BIGINT AS nth) t
WHERE event_type = 'view' AND (next_ms IS NULL OR ms + nth * {HOUR} <= next_ms) AND ms + nth * {HOUR} < {MARK}""")
def stream_user_timers(spark, sf):
    """User functions schedule, reschedule and delete timers by key."""
    events = live_events(spark, sf).select("user_id", "ts", "event_id", "event_type")
    fired = TM.with_timers(
        events, "user_id", "ts", ["event_id"], DELAY, remind, reminded, "user_id bigint, armed_by bigint, nth bigint, due_ms bigint"
    )
    return run_to_table(fired, "user-timers")


def count_message(context, message):
    """Counts of open hours: {start: messages}."""
    hours = context.state or {}
    start = str(message["ms"] - message["ms"] % HOUR)
    context.state = hours | {start: hours.get(start, 0) + 1}


def close_hours(context, mark):
    """Hours that the watermark has passed come out; the next step may trust hours up to six before the open one."""
    hours = context.state or {}
    for start in sorted(h for h in hours if int(h) + HOUR <= mark):
        context.emit(context.key, int(start), hours[start])
    context.state = {h: n for h, n in hours.items() if int(h) + HOUR > mark}
    return mark - 6 * HOUR


def add_hour(context, row):
    day = row["hour_ms"] - row["hour_ms"] % DAY
    days = context.state or {}
    busiest, total = days.get(str(day), (0, 0))
    context.state = days | {str(day): (max(busiest, row["n"]), total + row["n"])}
    context.schedule(str(day), day + DAY)


def close_day(context, name, due):
    context.emit(context.key, int(name), *context.state[name])
    context.state = {day: v for day, v in context.state.items() if day != name}


@query("stream_watermark_function", f"""
WITH h AS (SELECT event_type, ms - ms % {HOUR} AS hour_ms, count(*) AS n FROM {EV} GROUP BY ALL),
w AS (SELECT ({MARK} - 1) // {HOUR} * {HOUR} - {6 * HOUR} AS mark)
SELECT event_type, hour_ms - hour_ms % {DAY} AS pane_id, max(n) AS busiest, CAST(sum(n) AS BIGINT) AS n FROM h
WHERE hour_ms - hour_ms % {DAY} + {DAY} < (SELECT mark FROM w) GROUP BY ALL""")
def stream_watermark_function(spark, sf):
    """Hours by a user function with a watermark of its own, six hours behind; days of them close by that one."""
    events = live_events(spark, sf).withColumn("ms", millis("ts")).select("event_type", "ts", "event_id", "ms")
    hours = TM.with_watermark(
        events, "event_type", "ts", ["event_id"], DELAY, "1 hour", count_message, close_hours, "event_type string, hour_ms bigint, n bigint"
    )
    days = TM.follow(
        hand_over(hours, "closed-hours").withColumn("hour", F.timestamp_millis("hour_ms")), "event_type", "hour", ["hour_ms"], add_hour, close_day,
        "event_type string, pane_id bigint, busiest bigint, n bigint",
    )
    return run_to_table(days, "watermark-function")


@query("stream_early_panes", f"""
WITH d AS (SELECT *, ms - ms % {DAY} AS pane_id, row_number() OVER (PARTITION BY user_id, ms - ms % {DAY} ORDER BY ms, event_id) AS rn FROM {EV}),
p AS (SELECT user_id, pane_id, CAST(floor((rn - 1) / 2) AS BIGINT) AS pane_no, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM d GROUP BY ALL)
SELECT user_id, pane_id, pane_no, CASE WHEN n = 2 THEN 'EARLY' ELSE 'DEFAULT' END AS firing_type, n, total FROM p WHERE n = 2 OR pane_id + {DAY} <= {MARK}""")
def stream_early_panes(spark, sf):
    return ST.count_panes(
        live_events(spark, sf), ["user_id"], "ts", "event_id", "cents", DELAY, "1 day", 2, "early-panes"
    )


@query("stream_panes_accumulating", f"""
WITH d AS (SELECT *, ms - ms % {DAY} AS pane_id, row_number() OVER (PARTITION BY user_id, ms - ms % {DAY} ORDER BY ms, event_id) AS rn FROM {EV}),
r AS (SELECT user_id, pane_id, ms, rn, CAST(sum(cents) OVER (PARTITION BY user_id, pane_id ORDER BY ms, event_id) AS BIGINT) AS total FROM d),
w AS (SELECT user_id, pane_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM d GROUP BY ALL)
SELECT user_id, pane_id, CAST(rn / 2 - 1 AS BIGINT) AS pane_no, 'EARLY' AS firing_type, 'ACCUMULATING' AS mode, rn AS n, total, ms AS fired_ms FROM r WHERE rn % 2 = 0 AND ms <= {MARK}
UNION ALL SELECT user_id, pane_id, n // 2, 'DEFAULT', 'ACCUMULATING', n, total, pane_id + {DAY} FROM w WHERE pane_id + {DAY} <= {MARK}""")
def stream_panes_accumulating(spark, sf):
    return ST.live_panes(
        live_events(spark, sf), keys=["user_id"], ts="ts", tie="event_id", aggs={"n": ("count", None), "total": ("sum", "cents")},
        early=Repeat(Count(2)), delay=DELAY, name="panes", tumbling="1 day", accumulating=True,
    )


@query("stream_panes_session", f"""
WITH s AS (SELECT user_id, min(ms) AS pane_id, max(ms) + {6 * HOUR} AS closed, count(*) AS all_n, isl FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS isl FROM (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > {6 * HOUR} THEN 1 ELSE 0 END AS brk FROM {EV})) GROUP BY user_id, isl),
m AS (SELECT e.user_id, s.pane_id, s.closed, e.ms, e.ms < s.pane_id + {HOUR} AS early FROM {EV} e JOIN s ON e.user_id = s.user_id AND e.ms BETWEEN s.pane_id AND s.closed - {6 * HOUR})
SELECT user_id, pane_id, CAST(0 AS BIGINT) AS pane_no, 'EARLY' AS firing_type, 'DISCARDING' AS mode, count(*) AS n, pane_id + {HOUR} AS fired_ms FROM m WHERE early AND pane_id + {HOUR} <= {MARK} GROUP BY ALL
UNION ALL SELECT user_id, pane_id, CAST(1 AS BIGINT), 'DEFAULT', 'DISCARDING', count(*), closed FROM m WHERE NOT early AND closed <= {MARK} GROUP BY user_id, pane_id, closed""")
def stream_panes_session(spark, sf):
    """Sessions with an early pane an hour after their first message."""
    return ST.live_panes(
        live_events(spark, sf), keys=["user_id"], ts="ts", tie="event_id", aggs={"n": ("count", None)},
        early=SinceFirst("1 hour"), delay=DELAY, name="session-panes", session="6 hours",
    )


STREAM_TTL_SQL = f"""
WITH u AS (SELECT user_id, ms, event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS side FROM {EV} WHERE event_type IN ('view', 'purchase')),
c AS (SELECT *, last_value(CASE WHEN side = 0 THEN event_id END IGNORE NULLS) OVER w AS l_id, last_value(CASE WHEN side = 0 THEN ms END IGNORE NULLS) OVER w AS l_ms,
  last_value(CASE WHEN side = 1 THEN event_id END IGNORE NULLS) OVER w AS r_id, last_value(CASE WHEN side = 1 THEN ms END IGNORE NULLS) OVER w AS r_ms FROM u
  WINDOW w AS (PARTITION BY user_id ORDER BY ms, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, ms AS joined_ms, CASE WHEN side = 0 THEN event_id ELSE l_id END AS view_id, CASE WHEN side = 0 THEN r_id ELSE event_id END AS purchase_id
FROM c WHERE CASE WHEN side = 0 THEN r_ms ELSE l_ms END > ms - {DAY}"""


@query("stream_ttl_join", STREAM_TTL_SQL)
def stream_ttl_join(spark, sf):
    views = live_events(spark, sf).filter("event_type = 'view'").withColumn("view_id", F.col("event_id"))
    buys = live_events(spark, sf).filter("event_type = 'purchase'").withColumn("purchase_id", F.col("event_id"))
    return ST.ttl_join(
        views, buys, key="user_id", ts="ts", tie="event_id", delay=DELAY, ttl="1 day", left_id="view_id",
        right_id="purchase_id", name="ttl-join",
    )


@query("stream_table_live", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'""")
def stream_table_live(spark, sf):
    """A table kept up to date by a change stream; an error deletes the entry."""
    changes = live(spark, sf, "events").select("user_id", "event_id", "event_type")
    return ST.live_table(changes, ["user_id"], ["event_id"], "table", F.col("event_type") == "error")


@query("stream_table_join", ORACLES["asof_table_join"])
def stream_table_join(spark, sf):
    """Live purchases see the user's latest signup record; an error deletes the record."""
    source = live_events(spark, sf).select("event_id", "ts", "user_id", "event_type", "cents")
    changes = source.filter(F.col("event_type").isin("signup", "error")).withColumnRenamed("cents", "plan_cents")
    buys = source.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    return ST.table_join(
        buys, changes, key="user_id", ts="ts", tie="event_id", columns=["plan_cents"], delay=DELAY, name="table-join",
        deleted=F.col("event_type") == "error",
    ).drop("ts")


@query("sql_stream_insert", """
SELECT event_id AS id, upper(event_type) AS kind, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS score FROM events JOIN customer ON user_id = c_custkey WHERE event_type IN ('view', 'click')""")
def sql_stream_insert(spark, sf):
    """An insert-select job over a live source, written to a sink with a schema of its own."""
    path = shared_folder(spark, "sql-sink")
    wanted = T.StructType.fromDDL("id bigint, kind string, segment string, score double")
    job = (
        SqlJob(spark)
        .source("tracking.live", live(spark, sf, "events"))
        .source("store.customer", table(spark, sf, "customer"))
        .sink("out.named", path, schema=wanted)
    )
    job.execute("""
      INSERT INTO picked SELECT event_id AS id, event_type, user_id FROM tracking.live WHERE event_type IN ('view', 'click')
      INSERT INTO out.named SELECT p.id, upper(p.event_type) AS kind, c.c_mktsegment AS segment, 1 AS dropped
        FROM picked p JOIN store.customer c ON p.user_id = c.c_custkey
    """)
    return spark.read.schema(wanted).parquet(path)


@query("stream_interval_join", f"""
SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase'
AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOUR""")
def stream_interval_join(spark, sf):
    """Spark's own stream-stream join with a time bound, spread over time buckets."""
    source = live_events(spark, sf)
    clicks = source.filter("event_type = 'click'").withColumnRenamed("event_id", "click_id")
    buys = live_events(spark, sf).filter("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")
    pairs = SW.interval_join(
        clicks, buys, key="user_id", ts="ts", delay=DELAY, within="2 hours", left_id="click_id", right_id="purchase_id"
    )
    return run_to_table(pairs.drop("user_id"), "interval")


def numbered(key: tuple, rows: pd.DataFrame, state: tuple | None):
    """A task that numbers the messages of its key and keeps a running total."""
    n, total = state or (0, 0)
    out = pd.DataFrame({
        "event_id": rows["event_id"], "user_id": key[0], "nth": range(n + 1, n + 1 + len(rows)),
        "running_cents": total + rows["cents"].cumsum(),
    })
    return out, (n + len(rows), int(total + rows["cents"].sum()))


@query("task_process", f"""
SELECT event_id, user_id, row_number() OVER w AS nth, CAST(sum(cents) OVER w AS BIGINT) AS running_cents FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def task_process(spark, sf):
    source = live_events(spark, sf, max_bytes=1024**3).select("event_id", "user_id", "cents")
    return run_to_table(
        SF.process_by_key(
            source, "user_id", ["event_id"], numbered,
            "event_id bigint, user_id bigint, nth bigint, running_cents bigint", "n bigint, total bigint",
        ), "task",
    )


@query("sink_foreach_batch", f"SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents FROM {EV} GROUP BY ALL")
def sink_foreach_batch(spark, sf):
    """A sink function per micro-batch writes partial sums; a repeated batch replaces its own."""

    def partial(batch):
        return batch.groupBy("event_type").agg(rows("n"), F.sum("cents").alias("s"))

    parts = run_to_table(live_events(spark, sf), "each-batch", transform=partial)
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("s").alias("sum_cents"))
