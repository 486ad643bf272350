"""Queries over windows, triggers and aggregations."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tideloom.functions.times import millis
from tideloom.operators import aggregates as agg
from tideloom.operators import pane_folds as PF
from tideloom.operators import panes as P
from tideloom.operators import windows as W
from tideloom.operators.aggregates import cents
from tideloom.operators.ordered import plan_slices
from tideloom.plans.registry import query
from tideloom.session import table

EV = """(SELECT event_id, user_id, event_type, ts, props, value, epoch_us(ts) // 1000 AS ms,
          CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events)"""
HOUR, DAY = 3_600_000, 86_400_000


def events(spark, sf, *columns):
    df = table(spark, sf, "events").withColumn("cents", cents("value"))
    return df.select(*columns) if columns else df


def rows(name="n"):
    return F.count(F.lit(1)).alias(name)


# --- folds and collected panes -------------------------------------------------------------------

@query("keyed_tumbling_fold", f"""
SELECT user_id, ms - ms % {DAY} AS pane_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents, max(cents) AS max_cents
FROM {EV} GROUP BY ALL""")
def keyed_tumbling_fold(spark, sf):
    return W.tumbling(
        events(spark, sf), "ts", "1 day",
        [rows("n"), F.sum("cents").alias("sum_cents"), F.max("cents").alias("max_cents")], ["user_id"],
    )


@query("keyed_tumbling_collect", f"""
SELECT user_id, pane_id, chunk_no, count(*) AS n_messages, string_agg(event_id || ':' || event_type, ',' ORDER BY rn) AS messages
FROM (SELECT *, CAST(floor((rn - 1) / 4) AS BIGINT) AS chunk_no FROM (
  SELECT *, ms - ms % {DAY} AS pane_id, row_number() OVER (PARTITION BY user_id, ms - ms % {DAY} ORDER BY ms, event_id) AS rn FROM {EV}))
GROUP BY ALL""")
def keyed_tumbling_collect(spark, sf):
    tagged = W.tag_tumbling(events(spark, sf, "event_id", "ts", "user_id", "event_type"), "ts", "1 day")
    got = W.collect_panes(tagged, "ts", ["user_id"], "event_id", ["event_id", "event_type"], chunk=4)
    return got.withColumn("messages", _joined())


def _joined():
    return F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["event_id"], m["event_type"])), ",")


@query("tumbling_fold", f"""
SELECT ms - ms % {HOUR} AS pane_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents, min(cents) AS min_cents
FROM {EV} GROUP BY ALL""")
def tumbling_fold(spark, sf):
    return W.tumbling(
        events(spark, sf), "ts", "1 hour",
        [rows("n"), F.sum("cents").alias("sum_cents"), F.min("cents").alias("min_cents")],
    )


@query("tumbling_percentile", f"""
SELECT ms - ms % {DAY} AS pane_id, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.9) AS p90, quantile_disc(cents, 0.99) AS p99
FROM {EV} GROUP BY ALL""")
def tumbling_percentile(spark, sf):
    tagged = W.tag_tumbling(events(spark, sf, "ts", "cents"), "ts", "1 day")
    return agg.percentiles(tagged, ["pane_id"], "cents", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("percentile_small_share", f"""
SELECT event_type, quantile_disc(event_id, 0.07) AS p7, quantile_disc(event_id, 0.28) AS p28, quantile_disc(event_id, 0.55) AS p55
FROM events GROUP BY ALL""")
def percentile_small_share(spark, sf):
    """Shares whose product with a count is no exact double."""
    df = table(spark, sf, "events").select("event_type", "event_id")
    return agg.percentiles(df, ["event_type"], "event_id", {"p7": 0.07, "p28": 0.28, "p55": 0.55})


def session_sql(gap, by="user_id"):
    return f"""(SELECT *, min(ms) OVER (PARTITION BY {by}, isl) AS pane_id FROM (
  SELECT *, sum(brk) OVER (PARTITION BY {by} ORDER BY ts, event_id) AS isl FROM (
    SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY {by} ORDER BY ts, event_id)) > {gap}000 THEN 1 ELSE 0 END AS brk FROM {EV})))"""


def session_ms_sql(gap, by="user_id"):
    return f"""(SELECT *, min(ms) OVER (PARTITION BY {by}, isl) AS pane_id, max(ms) OVER (PARTITION BY {by}, isl) + {gap} AS close_ms FROM (
  SELECT *, sum(brk) OVER (PARTITION BY {by} ORDER BY ms, event_id) AS isl FROM (
    SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY {by} ORDER BY ms, event_id) > {gap} THEN 1 ELSE 0 END AS brk FROM {EV})))"""


@query("keyed_session_fold", f"""
SELECT user_id, pane_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents FROM {session_sql(6 * HOUR)} GROUP BY ALL""")
def keyed_session_fold(spark, sf):
    return W.session(
        events(spark, sf), "ts", "6 hours", [rows("n"), F.sum("cents").alias("sum_cents")], ["user_id"]
    )


@query("keyed_session_collect", f"""
SELECT user_id, pane_id, chunk_no, count(*) AS n_messages, string_agg(event_id || ':' || event_type, ',' ORDER BY rn) AS messages
FROM (SELECT *, CAST(floor((rn - 1) / 4) AS BIGINT) AS chunk_no FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, pane_id ORDER BY ms, event_id) AS rn FROM {session_ms_sql(6 * HOUR)}))
GROUP BY ALL""")
def keyed_session_collect(spark, sf):
    source = events(spark, sf, "event_id", "ts", "user_id", "event_type")
    slicing = plan_slices(source.select(millis("ts").alias("_ms")), "_ms")
    tagged = W.tag_session(source, "ts", "6 hours", ["user_id"], "event_id", slicing, stored=True)
    got = W.collect_panes(
        tagged, "ts", ["user_id"], "event_id", ["event_id", "event_type"], chunk=4, slicing=slicing
    )
    return got.withColumn("messages", _joined())


@query("sliding_window", f"""
SELECT event_type, pane_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents FROM (
  SELECT event_type, cents, ms - ms % {HOUR} - k * {HOUR} AS pane_id FROM {EV}, range(0, 4) r(k)) GROUP BY ALL""")
def sliding_window(spark, sf):
    return W.sliding(
        events(spark, sf), "ts", "4 hours", "1 hour", [rows("n"), F.sum("cents").alias("sum_cents")], ["event_type"]
    )


MOD = 1_000_003


@query("window_fold_ordered", f"""
SELECT user_id, pane_id, CAST(list_reduce(list(cents ORDER BY ms, event_id), lambda h, c: (h * 31 + c) % {MOD}) AS BIGINT) AS chain
FROM (SELECT *, ms - ms % {7 * DAY} AS pane_id FROM {EV}) GROUP BY ALL""")
def window_fold_ordered(spark, sf):
    """An order-dependent fold: a hash chained over the amounts of a user's week."""
    source = W.tag_tumbling(events(spark, sf, "event_id", "ts", "user_id", "cents"), "ts", "7 days")
    source = source.withColumn("_ms", millis("ts"))

    def state(h, p):
        return F.struct(h.cast("bigint").alias("h"), p.cast("bigint").alias("p"))

    return W.fold_ordered(
        source, ["user_id", "pane_id"], ["_ms", "event_id"],
        zero=state(F.lit(0), F.lit(1)),
        step=lambda s, m: state((s["h"] * 31 + m["cents"]) % MOD, (s["p"] * 31) % MOD),
        merge=lambda a, b: state((a["h"] * b["p"] + b["h"]) % MOD, (a["p"] * b["p"]) % MOD),
        finish=lambda s: s["h"], out="chain",
    )


# --- triggers ------------------------------------------------------------------------------------

AGGS = {"n": ("count", None), "sum_cents": ("sum", "cents")}


def daily(spark, sf, early, **options):
    return P.panes(
        events(spark, sf, "event_id", "ts", "user_id", "cents"),
        keys=["user_id"], ts="ts", tie="event_id", aggs=AGGS, early=early, tumbling="1 day", **options,
    )


DAYS = f"""(SELECT *, ms - ms % {DAY} AS pane_id, ms - ms % {DAY} + {DAY} AS close_ms,
  row_number() OVER (PARTITION BY user_id, ms - ms % {DAY} ORDER BY ms, event_id) AS rn,
  min(ms) OVER (PARTITION BY user_id, ms - ms % {DAY}) AS first_ms FROM {EV})"""


def discarding(rows, segment, fired, group="user_id, pane_id"):
    return f"""
SELECT {group}, segment AS pane_no, CASE WHEN {fired} THEN 'EARLY' ELSE 'DEFAULT' END AS firing_type,
  'DISCARDING' AS mode, n, sum_cents FROM (
  SELECT {group}, CAST({segment} AS BIGINT) AS segment, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents,
    min(ms) AS from_ms, max(ms) AS to_ms, max(close_ms) AS close_ms FROM {rows} GROUP BY ALL)"""


@query("trigger_count_once", discarding(DAYS, "CASE WHEN rn <= 2 THEN 0 ELSE 1 END", "segment = 0 AND n >= 2"))
def trigger_count_once(spark, sf):
    return daily(spark, sf, P.Count(2))


@query("trigger_since_first", discarding(
    DAYS, f"CASE WHEN ms < first_ms + {6 * HOUR} THEN 0 ELSE 1 END", f"segment = 0 AND from_ms + {6 * HOUR} < close_ms"))
def trigger_since_first(spark, sf):
    return daily(spark, sf, P.SinceFirst("6 hours"))


IDLE = f"""(SELECT *, sum(brk) OVER (PARTITION BY user_id, pane_id ORDER BY ms, event_id) AS isl FROM (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id, pane_id ORDER BY ms, event_id) >= {4 * HOUR} THEN 1 ELSE 0 END AS brk FROM {DAYS}))"""


@query("trigger_since_last", discarding(
    IDLE, "CASE WHEN isl = 0 THEN 0 ELSE 1 END", f"segment = 0 AND to_ms + {4 * HOUR} < close_ms"))
def trigger_since_last(spark, sf):
    return daily(spark, sf, P.SinceLast("4 hours"))


@query("trigger_since_last_repeat", discarding(IDLE, "isl", f"to_ms + {4 * HOUR} < close_ms"))
def trigger_since_last_repeat(spark, sf):
    return daily(spark, sf, P.Repeat(P.SinceLast("4 hours")))


@query("trigger_any", discarding(
    DAYS, f"CASE WHEN rn <= 3 AND ms < first_ms + {6 * HOUR} THEN 0 ELSE 1 END",
    f"segment = 0 AND (n >= 3 OR from_ms + {6 * HOUR} < close_ms)"))
def trigger_any(spark, sf):
    return daily(spark, sf, P.AnyOf((P.Count(3), P.SinceFirst("6 hours"))))


@query("trigger_count_repeat", discarding(DAYS, "floor((rn - 1) / 2)", "n >= 2"))
def trigger_count_repeat(spark, sf):
    return daily(spark, sf, P.Repeat(P.Count(2)))


def greedy_sql(rows, age, count=1 << 40):
    """Segment starts chained by a recursive query: the next one is the first message after a firing."""
    return f"""(WITH RECURSIVE r AS (SELECT * FROM {rows}),
 s AS (SELECT user_id, pane_id, ms AS began, rn AS began_rn, 0 AS segment FROM r WHERE rn = 1
   UNION ALL
   SELECT user_id, pane_id, began, began_rn, segment FROM (
     SELECT s.user_id, s.pane_id, r.ms AS began, r.rn AS began_rn, s.segment + 1 AS segment,
       row_number() OVER (PARTITION BY s.user_id, s.pane_id ORDER BY r.rn) AS k
     FROM s JOIN r ON s.user_id = r.user_id AND s.pane_id = r.pane_id AND r.rn > s.began_rn
       AND (r.ms >= s.began + {age} OR r.rn >= s.began_rn + {count})) WHERE k = 1)
 SELECT r.*, (SELECT max(segment) FROM s WHERE s.user_id = r.user_id AND s.pane_id = r.pane_id AND s.began_rn <= r.rn) AS segment_no FROM r)"""


@query("trigger_since_first_repeat", discarding(
    greedy_sql(DAYS, 3 * HOUR), "segment_no", f"from_ms + {3 * HOUR} < close_ms"))
def trigger_since_first_repeat(spark, sf):
    return daily(spark, sf, P.Repeat(P.SinceFirst("3 hours")))


@query("trigger_any_repeat", discarding(
    greedy_sql(DAYS, 3 * HOUR, 2), "segment_no", f"n >= 2 OR from_ms + {3 * HOUR} < close_ms"))
def trigger_any_repeat(spark, sf):
    return daily(spark, sf, P.Repeat(P.AnyOf((P.Count(2), P.SinceFirst("3 hours")))))


@query("early_panes_discarding", discarding(
    f"(SELECT *, ms - ms % {HOUR} AS pane_id, ms - ms % {HOUR} + {HOUR} AS close_ms, row_number() OVER (PARTITION BY event_type, ms - ms % {HOUR} ORDER BY ms, event_id) AS rn FROM {EV})",
    "floor((rn - 1) / 2)", "n >= 2", "event_type, pane_id"))
def early_panes_discarding(spark, sf):
    return P.panes(
        events(spark, sf, "event_id", "ts", "event_type", "cents"),
        keys=["event_type"], ts="ts", tie="event_id", aggs=AGGS, early=P.Repeat(P.Count(2)), tumbling="1 hour",
    )


@query("early_panes_accumulating", f"""
WITH d AS (SELECT * FROM {DAYS}),
p AS (SELECT user_id, pane_id, CAST(floor((rn - 1) / 2) AS BIGINT) AS pane_no, count(*) AS k, sum(cents) AS c FROM d GROUP BY ALL),
a AS (SELECT user_id, pane_id, pane_no, k, sum(k) OVER w AS n, sum(c) OVER w AS sum_cents FROM p WINDOW w AS (PARTITION BY user_id, pane_id ORDER BY pane_no))
SELECT user_id, pane_id, pane_no, 'EARLY' AS firing_type, 'ACCUMULATING' AS mode, CAST(n AS BIGINT) AS n, CAST(sum_cents AS BIGINT) AS sum_cents FROM a WHERE k = 2
UNION ALL
SELECT user_id, pane_id, CAST(floor(count(*) / 2) AS BIGINT), 'DEFAULT', 'ACCUMULATING', count(*), CAST(sum(cents) AS BIGINT) FROM d GROUP BY user_id, pane_id""")
def early_panes_accumulating(spark, sf):
    return daily(spark, sf, P.Repeat(P.Count(2)), accumulating=True)


@query("session_early_panes", discarding(
    f"(SELECT *, row_number() OVER (PARTITION BY user_id, pane_id ORDER BY ms, event_id) AS rn FROM {session_ms_sql(12 * HOUR)})",
    "floor((rn - 1) / 3)", "n >= 3"))
def session_early_panes(spark, sf):
    return P.panes(
        events(spark, sf, "event_id", "ts", "user_id", "cents"),
        keys=["user_id"], ts="ts", tie="event_id", aggs=AGGS, early=P.Repeat(P.Count(3)), session="12 hours",
    )


ARRIVALS = f"(SELECT *, ms + CAST(json_extract(props, '$.k') AS BIGINT) * 60000 AS arrived FROM {EV})"


@query("late_panes", f"""
SELECT event_type, pane_id, firing_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents FROM (
  SELECT *, ms - ms % {HOUR} AS pane_id, CASE WHEN ms - ms % {HOUR} + {HOUR} <= seen - 600000 THEN 'LATE' ELSE 'DEFAULT' END AS firing_type
  FROM (SELECT *, max(ms) OVER (ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {ARRIVALS})) GROUP BY ALL""")
def late_panes(spark, sf):
    return P.late_panes(
        arrivals(spark, sf), keys=["event_type"], ts="ts", arrival="arrived", tie="event_id",
        size="1 hour", delay="10 minutes", aggs=AGGS,
    )


def arrivals(spark, sf):
    """Events with an arrival clock that runs up to 100 minutes behind the event clock."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events(spark, sf).withColumn("arrived", millis("ts") + k * 60_000)


# --- user folds and collected messages under triggers ---------------------------------------------

@query("trigger_fold_ordered", f"""
WITH d AS (SELECT *, CAST(floor((rn - 1) / 2) AS BIGINT) AS segment FROM {DAYS})
SELECT user_id, pane_id, segment AS pane_no, CASE WHEN count(*) = 2 THEN 'EARLY' ELSE 'DEFAULT' END AS firing_type, 'DISCARDING' AS mode,
  CAST(list_reduce(list(cents ORDER BY rn), lambda h, c: (h * 31 + c) % {MOD}, CAST(0 AS BIGINT)) AS BIGINT) AS chain FROM d GROUP BY user_id, pane_id, segment
UNION ALL
SELECT e.user_id, e.pane_id, e.segment, 'EARLY', 'ACCUMULATING', CAST(list_reduce(list(d.cents ORDER BY d.rn), lambda h, c: (h * 31 + c) % {MOD}, CAST(0 AS BIGINT)) AS BIGINT)
FROM d e JOIN d ON d.user_id IS NOT DISTINCT FROM e.user_id AND d.pane_id = e.pane_id AND d.rn <= e.rn WHERE e.rn % 2 = 0 GROUP BY e.user_id, e.pane_id, e.segment
UNION ALL
SELECT user_id, pane_id, CAST(floor(count(*) / 2) AS BIGINT), 'DEFAULT', 'ACCUMULATING', CAST(list_reduce(list(cents ORDER BY rn), lambda h, c: (h * 31 + c) % {MOD}, CAST(0 AS BIGINT)) AS BIGINT)
FROM d GROUP BY user_id, pane_id""")
def trigger_fold_ordered(spark, sf):
    """A hash chained over the amounts of a user's day, in every pane: of its own messages, and of all so far."""

    def state(h, p):
        return F.struct(h.cast("bigint").alias("h"), p.cast("bigint").alias("p"))

    def folded(accumulating):
        return PF.folded_panes(
            events(spark, sf, "event_id", "ts", "user_id", "cents"), keys=["user_id"], ts="ts", tie="event_id",
            zero=state(F.lit(0), F.lit(1)),
            step=lambda s, m: state((s["h"] * 31 + m["cents"]) % MOD, (s["p"] * 31) % MOD),
            merge=lambda a, b: state((a["h"] * b["p"] + b["h"]) % MOD, (a["p"] * b["p"]) % MOD),
            finish=lambda s: s["h"], out="chain", early=P.Repeat(P.Count(2)), tumbling="1 day", accumulating=accumulating,
        )

    return folded(False).unionByName(folded(True))


@query("trigger_collect", f"""
SELECT user_id, pane_id, CAST(floor((rn - 1) / 3) AS BIGINT) AS pane_no, CASE WHEN count(*) = 3 THEN 'EARLY' ELSE 'DEFAULT' END AS firing_type,
  string_agg(event_id || ':' || event_type, ',' ORDER BY rn) AS messages
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, pane_id ORDER BY ms, event_id) AS rn FROM {session_ms_sql(12 * HOUR)})
GROUP BY user_id, pane_id, floor((rn - 1) / 3)""")
def trigger_collect(spark, sf):
    """The messages of every pane of a user's sessions."""
    got = PF.collected_panes(
        events(spark, sf, "event_id", "ts", "user_id", "event_type"), keys=["user_id"], ts="ts", tie="event_id",
        columns=["event_id", "event_type"], early=P.Repeat(P.Count(3)), session="12 hours",
    )
    return got.select("user_id", "pane_id", "pane_no", "firing_type", _joined().alias("messages"))


# --- the same operators with the order axis cut into slices ---------------------------------------

SLICED_ROWS = 1_500


@query("early_panes_sliced", f"""
WITH d AS (SELECT * FROM {DAYS.replace("user_id", "event_type")}),
p AS (SELECT event_type, pane_id, CAST(floor((rn - 1) / 7) AS BIGINT) AS pane_no, count(*) AS k, sum(cents) AS c FROM d GROUP BY ALL),
a AS (SELECT event_type, pane_id, pane_no, k, sum(k) OVER w AS n, sum(c) OVER w AS sum_cents FROM p WINDOW w AS (PARTITION BY event_type, pane_id ORDER BY pane_no))
SELECT event_type, pane_id, pane_no, 'EARLY' AS firing_type, 'ACCUMULATING' AS mode, CAST(n AS BIGINT) AS n, CAST(sum_cents AS BIGINT) AS sum_cents FROM a WHERE k = 7
UNION ALL
SELECT event_type, pane_id, CAST(floor(count(*) / 7) AS BIGINT), 'DEFAULT', 'ACCUMULATING', count(*), CAST(sum(cents) AS BIGINT) FROM d GROUP BY event_type, pane_id"""
       .replace("event_id, event_type, event_type, ts", "event_id, user_id, event_type, ts"))
def early_panes_sliced(spark, sf):
    source = events(spark, sf, "event_id", "ts", "event_type", "cents")
    slicing = plan_slices(source.select(millis("ts").alias("_ms")), "_ms", SLICED_ROWS)
    return P.panes(
        source, keys=["event_type"], ts="ts", tie="event_id", aggs=AGGS, early=P.Repeat(P.Count(7)),
        tumbling="1 day", accumulating=True, slicing=slicing,
    )


@query("trigger_any_sliced", discarding(
    greedy_sql(DAYS, 3 * HOUR, 2), "segment_no", f"n >= 2 OR from_ms + {3 * HOUR} < close_ms"))
def trigger_any_sliced(spark, sf):
    """The chains of trigger_any_repeat, composed over slices."""
    source = events(spark, sf, "event_id", "ts", "user_id", "cents")
    slicing = plan_slices(source.select(millis("ts").alias("_ms")), "_ms", SLICED_ROWS)
    early = P.Repeat(P.AnyOf((P.Count(2), P.SinceFirst("3 hours"))))
    return P.panes(source, keys=["user_id"], ts="ts", tie="event_id", aggs=AGGS, early=early, tumbling="1 day", slicing=slicing)


@query("session_tag_sliced", f"""
SELECT event_id, user_id, pane_id FROM {session_ms_sql(6 * HOUR)}""")
def session_tag_sliced(spark, sf):
    source = events(spark, sf, "event_id", "ts", "user_id")
    slicing = plan_slices(source.select(millis("ts").alias("_ms")), "_ms", SLICED_ROWS)
    return W.tag_session(source, "ts", "6 hours", ["user_id"], "event_id", slicing).drop("ts")


# --- aggregations --------------------------------------------------------------------------------

@query("agg_multi", f"""
SELECT event_type, count(*) AS n, count(CASE WHEN cents > 1000 THEN 1 END) AS n_big, CAST(sum(cents) AS BIGINT) AS sum_cents,
 min(cents) AS min_cents, max(cents) AS max_cents, CAST(sum(cents) AS DOUBLE) / count(*) AS avg_cents FROM {EV} GROUP BY ALL""")
def agg_multi(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(
        rows("n"), F.count_if(F.col("cents") > 1000).alias("n_big"), F.sum("cents").alias("sum_cents"),
        F.min("cents").alias("min_cents"), F.max("cents").alias("max_cents"),
        (F.sum("cents").cast("double") / rows()).alias("avg_cents"),
    )


@query("agg_count_distinct", f"""
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT cents) AS amounts FROM {EV} GROUP BY ALL""")
def agg_count_distinct(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("cents").alias("amounts")
    )


@query("agg_sum", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ALL")
def agg_sum(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty")
    )


@query("agg_sum0", """
SELECT c_custkey, CAST(coalesce(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)), 0) AS BIGINT) AS spent_cents
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def agg_sum0(spark, sf):
    """A sum over nothing is 0. Orders are summed up per customer before they meet the customers."""
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("s"))
    customers = table(spark, sf, "customer").select("c_custkey")
    return customers.join(spent, customers.c_custkey == spent.o_custkey, "left").select(
        "c_custkey", F.coalesce("s", F.lit(0)).alias("spent_cents")
    )


@query("tumble_start_end", f"""
SELECT event_type, ms - ms % {DAY} AS tumble_start, ms - ms % {DAY} + {DAY} AS tumble_end, count(*) AS n FROM {EV} GROUP BY ALL""")
def tumble_start_end(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql("""
      SELECT event_type, unix_millis(CAST(w.start AS TIMESTAMP)) AS tumble_start,
             unix_millis(CAST(w.end AS TIMESTAMP)) AS tumble_end, count(*) AS n
      FROM (SELECT event_type, window(ts, '1 day') AS w FROM events) GROUP BY event_type, w""")


@query("event_window_throttled_count", f"""
WITH RECURSIVE r AS (SELECT user_id, ms - ms % {DAY} AS pane_id, ms, row_number() OVER (PARTITION BY user_id, ms - ms % {DAY} ORDER BY ms, event_id) AS n FROM {EV}),
 s AS (SELECT * FROM r WHERE n = 1 UNION ALL
   SELECT user_id, pane_id, ms, n FROM (SELECT r.*, row_number() OVER (PARTITION BY r.user_id, r.pane_id ORDER BY r.n) AS k
     FROM s JOIN r ON s.user_id = r.user_id AND s.pane_id = r.pane_id AND r.ms > s.ms + {2 * HOUR}) WHERE k = 1)
SELECT user_id, pane_id, ms AS emitted_ms, n FROM s""")
def event_window_throttled_count(spark, sf):
    return agg.throttled_counts(events(spark, sf), "user_id", "ts", "1 day", "2 hours")


@query("latency_snapshot", f"""
SELECT pane_id, min(cents) AS min_v, max(cents) AS max_v, CAST(sum(cents) AS BIGINT) AS sum_v, count(*) AS size_v,
  CAST(sum(cents) AS DOUBLE) / count(*) AS avg_v, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.95) AS p95
FROM (SELECT cents, ms - ms % {HOUR} - k * {HOUR} AS pane_id FROM {EV}, range(0, 6) r(k)) GROUP BY ALL""")
def latency_snapshot(spark, sf):
    return agg.snapshot(events(spark, sf, "ts", "cents"), "ts", "6 hours", "1 hour", "cents", {"p50": 0.5, "p95": 0.95})


@query("latency_metrics", f"""
SELECT event_type, CAST(sum(cents % 50) AS BIGINT) AS queueing_ms, CAST(sum(5 + cents % 7) AS BIGINT) AS query_ms,
 CAST(sum(arrived - ms + cents % 50 + 5 + cents % 7) AS BIGINT) AS total_ms, max(arrived - ms + cents % 50 + 5 + cents % 7) AS max_total_ms, count(*) AS n
FROM {ARRIVALS} GROUP BY ALL""")
def latency_metrics(spark, sf):
    stamped = (
        arrivals(spark, sf)
        .withColumn("event_ms", millis("ts"))
        .withColumn("scan_ms", F.col("arrived") + F.col("cents") % 50)
        .withColumn("output_ms", F.col("scan_ms") + 5 + F.col("cents") % 7)
    )
    return agg.latencies(stamped, "event_ms", "arrived", "scan_ms", "output_ms", ["event_type"])


@query("filter_counters", f"""
SELECT count(*) AS n_in, count(*) FILTER (WHERE cents > 500 AND event_type <> 'error') AS n_out,
 count(*) - count(*) FILTER (WHERE cents > 500 AND event_type <> 'error') AS n_filtered FROM {EV}""")
def filter_counters(spark, sf):
    return agg.counters(events(spark, sf), (F.col("cents") > 500) & (F.col("event_type") != "error"))


@query("filter_counters_observed", f"""
SELECT count(*) AS n_in, count(*) FILTER (WHERE cents > 500 AND event_type <> 'error') AS n_out FROM {EV}""")
def filter_counters_observed(spark, sf):
    """The counters of a filter in a job that does something else: they are read once its own action has run."""
    watch = Observation("filter")
    passed = agg.observed_filter(events(spark, sf), (F.col("cents") > 500) & (F.col("event_type") != "error"), watch)
    passed.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(watch.get["n_in"], watch.get["n_out"])], "n_in bigint, n_out bigint")
