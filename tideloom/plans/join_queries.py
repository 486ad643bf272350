"""Queries over joins and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.times import millis
from tideloom.operators import joins as J
from tideloom.operators import tables as TB
from tideloom.operators.ordered import plan_slices
from tideloom.plans.registry import query
from tideloom.plans.window_queries import DAY, EV, HOUR, SLICED_ROWS, events
from tideloom.session import table


def kind(spark, sf, name, *renamed):
    """Events of one type as a stream of their own."""
    df = events(spark, sf, "event_id", "ts", "user_id", "event_type", "cents").filter(F.col("event_type") == name)
    return df.drop("event_type").withColumnsRenamed(dict(renamed))


TTL_SQL = """
WITH u AS (SELECT user_id, ms, event_id, cents, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS side FROM {ev} WHERE event_type IN ('view', '{other}')),
c AS (SELECT *, last_value(CASE WHEN side = 0 THEN event_id END IGNORE NULLS) OVER w AS l_id, last_value(CASE WHEN side = 0 THEN ms END IGNORE NULLS) OVER w AS l_ms,
  last_value(CASE WHEN side = 1 THEN event_id END IGNORE NULLS) OVER w AS r_id, last_value(CASE WHEN side = 1 THEN ms END IGNORE NULLS) OVER w AS r_ms,
  last_value(CASE WHEN side = 1 THEN cents END IGNORE NULLS) OVER w AS r_cents FROM u
  WINDOW w AS (PARTITION BY user_id ORDER BY ms, side, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, ms AS joined_ms, CASE WHEN side = 0 THEN event_id ELSE l_id END AS view_id,
  CASE WHEN side = 0 THEN r_id ELSE event_id END AS other_id, CASE WHEN side = 0 THEN r_cents ELSE cents END AS other_cents
FROM c WHERE CASE WHEN side = 0 THEN r_ms ELSE l_ms END > ms - {ttl}"""


def ttl(spark, sf, other, duration, slicing=None):
    return J.ttl_join(
        kind(spark, sf, "view", ("event_id", "view_id")).withColumn("event_id", F.col("view_id")),
        kind(spark, sf, other, ("cents", "other_cents")).withColumn("other_id", F.col("event_id")),
        key="user_id", ts="ts", tie="event_id", ttl=duration,
        left_columns=["view_id"], right_columns=["other_id", "other_cents"], slicing=slicing,
    )


@query("ttl_latest_join", TTL_SQL.format(ev=EV, other="purchase", ttl=DAY))
def ttl_latest_join(spark, sf):
    return ttl(spark, sf, "purchase", "1 day")


@query("ttl_latest_join_sliced", TTL_SQL.format(ev=EV, other="click", ttl=6 * HOUR))
def ttl_latest_join_sliced(spark, sf):
    clock = events(spark, sf, "ts").select(millis("ts").alias("_ms"))
    return ttl(spark, sf, "click", "6 hours", plan_slices(clock, "_ms", SLICED_ROWS))


@query("interval_join", f"""
SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM {EV} c JOIN {EV} p
ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND c.ms BETWEEN p.ms - {2 * HOUR} AND p.ms + {HOUR}""")
def interval_join(spark, sf):
    return J.interval_join(
        kind(spark, sf, "click", ("event_id", "click_id")), kind(spark, sf, "purchase", ("event_id", "purchase_id")),
        key="user_id", ts="ts", before="2 hours", after="1 hour",
        left_columns=["click_id"], right_columns=["purchase_id"],
    )


@query("self_join", """
SELECT a.conv_id, a.turn, a.role AS asked_by, b.role AS answered_by, length(b.text) AS answer_chars
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def self_join(spark, sf):
    """Each message with the one after it; (conv_id, turn) is a key, so a row has one partner."""
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("role").alias("asked_by"))
    b = c.select(
        F.col("conv_id").alias("b_conv"), (F.col("turn") - 1).alias("b_turn"), F.col("role").alias("answered_by"),
        F.length("text").cast("bigint").alias("answer_chars"),
    )
    return a.join(b, (a.conv_id == b.b_conv) & (a.turn == b.b_turn)).drop("b_conv", "b_turn")


KEYED = "(SELECT *, CASE WHEN event_id % 10 = 3 THEN NULL ELSE user_id + event_id % 2 * 100000000 END AS member FROM {ev})".format(ev=EV)


def members(spark, sf):
    """Events whose key is sometimes null and sometimes unknown to the customer table."""
    key = F.when(F.col("event_id") % 10 != 3, F.col("user_id") + F.col("event_id") % 2 * 100_000_000)
    return events(spark, sf, "event_id", "user_id", "cents").withColumn("member", key)


@query("stream_table_inner", f"SELECT event_id, cents, c_name, c_mktsegment FROM {KEYED} JOIN customer ON member = c_custkey")
def stream_table_inner(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return J.table_join(members(spark, sf), c, F.col("member") == F.col("c_custkey")).select(
        "event_id", "cents", "c_name", "c_mktsegment"
    )


@query("stream_table_left", f"SELECT event_id, cents, c_name, c_mktsegment FROM {KEYED} LEFT JOIN customer ON member = c_custkey")
def stream_table_left(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return J.table_join(members(spark, sf), c, F.col("member") == F.col("c_custkey"), "left").select(
        "event_id", "cents", "c_name", "c_mktsegment"
    )


def _views(spark, sf, *names):
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(n)


def sql_query(name, text, *names, oracle=None):
    """Register a query whose Spark SQL text is the user's own statement."""

    def run(spark, sf):
        _views(spark, sf, *names)
        return spark.sql(text)

    run.__module__ = __name__
    query(name, oracle or text)(run)


sql_query("sql_join_inner", "SELECT o.o_orderkey, c.c_name, c.c_mktsegment FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey", "orders", "customer")
sql_query("sql_join_left", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o.o_custkey = c.c_custkey", "orders", "customer")
sql_query("sql_join_right", "SELECT o.o_orderkey, c.c_name FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c RIGHT JOIN orders o ON o.o_custkey = c.c_custkey", "orders", "customer")
sql_query("sql_join_composite", """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, t.n AS pair_lines FROM lineitem l
JOIN (SELECT l_partkey AS pk, l_suppkey AS sk, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey, l_suppkey) t
ON l.l_partkey = t.pk AND l.l_suppkey = t.sk""", "lineitem")
sql_query("sql_join_udf_key", """
SELECT e.event_id, c.c_name FROM events e JOIN customer c ON concat('u', CAST(e.user_id AS VARCHAR(20))) = lower(concat('U', CAST(c.c_custkey AS VARCHAR(20))))""", "events", "customer")
sql_query("sql_join_chain", """
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""", "orders", "customer", "nation", "region")
sql_query("sql_join_using", """
SELECT k, o.o_orderstatus, c.c_mktsegment FROM (SELECT o_custkey AS k, o_orderstatus FROM orders) o JOIN (SELECT c_custkey AS k, c_mktsegment FROM customer) c USING (k)""", "orders", "customer")
sql_query("sql_join_natural", """
SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name, n_nationkey FROM nation) n NATURAL JOIN region""", "nation", "region")
sql_query("join_full", """
SELECT c_custkey, user_id, n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c
FULL OUTER JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON c.c_custkey = e.user_id""", "customer", "events")
sql_query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "customer", "orders")
sql_query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "customer", "orders")


@query("join_theta", """
SELECT s_suppkey, s_name, p_partkey FROM (SELECT *, CAST(floor(s_acctbal) AS BIGINT) AS bal FROM supplier)
JOIN (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) * 3 AS lo, CAST(floor(p_retailprice) AS BIGINT) * 3 + p_size % 20 AS hi FROM part)
ON bal >= lo AND bal < hi""")
def join_theta(spark, sf):
    price = F.floor("p_retailprice") * 3
    bands = table(spark, sf, "part").select("p_partkey", price.alias("lo"), (price + F.col("p_size") % 20).alias("hi"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.floor("s_acctbal").alias("bal"))
    return J.band_join(suppliers, bands, "bal", "lo", "hi", 20).select("s_suppkey", "s_name", "p_partkey")


@query("asof_table_join", f"""
WITH u AS (SELECT user_id, ms, event_id, event_type, cents FROM {EV}),
c AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ms, CASE WHEN event_type IN ('signup', 'error') THEN 0 ELSE 1 END, event_id) AS change_id FROM u)
SELECT c.event_id, c.user_id, s.cents AS plan_cents FROM c LEFT JOIN u s ON s.event_id = c.change_id AND s.event_type = 'signup' WHERE c.event_type = 'purchase'""")
def asof_table_join(spark, sf):
    """Purchases see the user's latest signup record at that moment; an error deletes the record."""
    source = events(spark, sf, "event_id", "ts", "user_id", "event_type", "cents")
    changes = source.filter(F.col("event_type").isin("signup", "error")).withColumn("plan_cents", F.col("cents"))
    return J.asof_join(
        source.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts"), changes,
        key="user_id", ts="ts", tie="event_id", columns=["plan_cents"], deleted=F.col("event_type") == "error",
    ).drop("ts")


# --- tables --------------------------------------------------------------------------------------


def changes(spark, sf):
    return events(spark, sf, "event_id", "ts", "user_id", "event_type", "cents")


def gone():
    return F.col("event_type") == "error"


@query("table_upsert_latest", f"SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(cents, event_id) AS cents FROM {EV} GROUP BY ALL")
def table_upsert_latest(spark, sf):
    return TB.materialise(changes(spark, sf).drop("ts"), ["user_id"], ["event_id"])


STATE = f"(SELECT user_id, max(event_id) AS event_id, max(ms) AS ms, arg_max(event_type, event_id) AS event_type, arg_max(cents, event_id) AS cents FROM {EV} GROUP BY ALL)"


@query("table_tombstone", f"SELECT user_id, event_id, event_type, cents FROM {STATE} WHERE event_type <> 'error'")
def table_tombstone(spark, sf):
    return TB.materialise(changes(spark, sf).drop("ts"), ["user_id"], ["event_id"], gone())


@query("table_restore", f"""
SELECT user_id, event_type, event_id, cents FROM (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(cents, event_id) AS cents FROM {EV} GROUP BY ALL) WHERE cents % 9 <> 0""")
def table_restore(spark, sf):
    """A table with a composite key, rebuilt from its change log: amounts divisible by 9 delete."""
    return TB.materialise(changes(spark, sf).drop("ts"), ["user_id", "event_type"], ["event_id"], F.col("cents") % 9 == 0)


def state(spark, sf, columns=("user_id", "event_id", "event_type", "cents")):
    return TB.materialise(changes(spark, sf), ["user_id"], ["event_id"], gone()).select(*columns)


@query("table_get_all", f"SELECT user_id, event_id, event_type, cents FROM {STATE} WHERE event_type <> 'error' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def table_get_all(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return TB.get_all(state(spark, sf), wanted, ["user_id"])


PUTS = f"SELECT user_id, max(event_id) AS event_id, 'put' AS event_type, CAST(sum(cents) AS BIGINT) AS cents FROM {EV} WHERE event_type = 'purchase' GROUP BY user_id"


@query("table_put_all", f"""
WITH s AS (SELECT user_id, event_id, event_type, cents FROM {STATE} WHERE event_type <> 'error'), p AS ({PUTS})
SELECT * FROM p UNION ALL SELECT * FROM s WHERE user_id NOT IN (SELECT user_id FROM p)""")
def table_put_all(spark, sf):
    puts = kind(spark, sf, "purchase").groupBy("user_id").agg(
        F.max("event_id").alias("event_id"), F.lit("put").alias("event_type"), F.sum("cents").alias("cents")
    )
    return TB.put_all(state(spark, sf), puts, ["user_id"])


@query("table_delete_all", f"SELECT user_id, event_id, event_type, cents FROM {STATE} WHERE event_type <> 'error' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def table_delete_all(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return TB.delete_all(state(spark, sf), gone, ["user_id"])


@query("table_range", "SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1997-03-01' ORDER BY o_orderdate")
def table_range(spark, sf):
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("1995-03-01", "1997-03-01"))
    return TB.key_range(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", lo, hi)


@query("table_all_sorted", f"SELECT user_id, event_id, event_type, cents FROM {STATE} WHERE event_type <> 'error' ORDER BY user_id")
def table_all_sorted(spark, sf):
    return TB.all_sorted(state(spark, sf), "user_id")


@query("table_ttl", f"SELECT user_id, event_id, event_type FROM {STATE} WHERE event_type <> 'error' AND ms > (SELECT max(ms) FROM {EV}) - {DAY}")
def table_ttl(spark, sf):
    """Entries alive at the end of the stream: the clock is a scalar subquery."""
    now = events(spark, sf, "ts").agg(F.max(millis("ts")))
    entries = state(spark, sf, ("user_id", "event_id", "event_type", "ts"))
    return TB.alive(entries, "ts", "1 day", now.scalar()).drop("ts")


@query("timeseries_range", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
 FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12') WHERE rn <= 3""")
def timeseries_range(spark, sf):
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10", "2024-01-12"))
    return TB.series_range(changes(spark, sf), ["user_id"], "ts", "event_id", lo, hi, 3).select(
        "user_id", "event_id", "event_type"
    )


@query("timeseries_remove", "SELECT user_id, event_id FROM events WHERE NOT (event_type = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25')")
def timeseries_remove(spark, sf):
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05", "2024-01-25"))
    return TB.series_remove(changes(spark, sf), "event_type", "ts", lo, hi, F.col("event_type") == "view").select("user_id", "event_id")


@query("side_input_join", f"""
WITH t AS (SELECT user_id AS k, arg_max(cents, event_id) AS v, arg_max(event_type, event_id) AS et FROM {EV} WHERE event_type IN ('signup', 'error') GROUP BY ALL),
e AS (SELECT k, 'raw' AS name, v AS value FROM t WHERE et <> 'error' UNION ALL SELECT k, 'tax', v // 5 FROM t WHERE et <> 'error')
SELECT p.event_id, e.name, e.value FROM {EV} p JOIN e ON p.user_id = e.k WHERE p.event_type = 'purchase'""")
def side_input_join(spark, sf):
    """Signups fill a table with two entries each; an error deletes both. Purchases look them up."""

    def process(messages):
        alive = F.col("event_type") == "signup"
        entries = F.array(
            F.struct(F.lit("raw").alias("name"), F.when(alive, F.col("cents")).alias("value")),
            F.struct(F.lit("tax").alias("name"), F.when(alive, F.floor(F.col("cents") / 5)).alias("value")),
        )
        return messages.select(F.col("user_id").alias("k"), "event_id", F.explode(entries).alias("e")).select(
            "k", "event_id", "e.name", "e.value"
        )

    feed = changes(spark, sf).filter(F.col("event_type").isin("signup", "error"))
    side = TB.side_input(feed, process, ["k", "name"], ["event_id"]).drop("event_id")
    buys = kind(spark, sf, "purchase").select("event_id", "user_id")
    return J.table_join(buys, side, F.col("user_id") == F.col("k")).select("event_id", "name", "value")


BATCHED = f"(SELECT *, user_id % 4 AS source, CAST(floor((row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) / 100) AS BIGINT) AS batch_no FROM {EV})"


def operations(spark, sf):
    return changes(spark, sf).drop("ts").withColumn("source", F.col("user_id") % 4)


@query("batch_complete", f"SELECT source, batch_no, event_id, user_id, event_type, cents FROM {BATCHED}")
def batch_complete(spark, sf):
    return TB.batches(operations(spark, sf), ["source"], ["event_id"], 100)


@query("batch_compact", f"""
SELECT source, batch_no, user_id, min(event_id) AS event_id, 'view' AS event_type, arg_min(cents, event_id) AS cents FROM {BATCHED} WHERE event_type = 'view' GROUP BY ALL
UNION ALL SELECT source, batch_no, user_id, max(event_id), arg_max(event_type, event_id), arg_max(cents, event_id) FROM {BATCHED} WHERE event_type <> 'view' GROUP BY source, batch_no, user_id""")
def batch_compact(spark, sf):
    """Views are queries, all else are updates. The order axis is cut into slices here."""
    ops = operations(spark, sf)
    batched = TB.batches(ops, ["source"], ["event_id"], 100, plan_slices(ops, "event_id", SLICED_ROWS))
    return TB.compact(batched, ["source"], "user_id", ["event_id"], F.col("event_type") == "view")


@query("bulk_upsert_actions", f"""
SELECT event_id, user_id AS doc_id, cents AS version, user_id % 5 AS routing, CASE WHEN best IS NULL THEN 'insert' WHEN cents > best THEN 'update' ELSE 'conflict' END AS action FROM (
 SELECT *, max(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM {EV})""")
def bulk_upsert_actions(spark, sf):
    requests = events(spark, sf, "event_id", "user_id", "cents").select(
        "event_id", F.col("user_id").alias("doc_id"), F.col("cents").alias("version"),
        (F.col("user_id") % 5).alias("routing"),
    )
    return TB.versioned_actions(requests, "doc_id", "version", ["event_id"])


@query("batch_timed", f"""
WITH RECURSIVE d AS (SELECT event_id, user_id % 4 AS source, ms // {HOUR} AS flush_no, ms, row_number() OVER (PARTITION BY user_id % 4, ms // {HOUR} ORDER BY ms, event_id) AS rn FROM {EV}),
 s AS (SELECT source, flush_no, ms AS began, rn AS began_rn, 0 AS batch_no FROM d WHERE rn = 1 UNION ALL
   SELECT source, flush_no, began, began_rn, batch_no FROM (
     SELECT s.source, s.flush_no, d.ms AS began, d.rn AS began_rn, s.batch_no + 1 AS batch_no, row_number() OVER (PARTITION BY s.source, s.flush_no ORDER BY d.rn) AS k
     FROM s JOIN d ON s.source = d.source AND s.flush_no = d.flush_no AND d.rn > s.began_rn AND (d.ms >= s.began + 600000 OR d.rn >= s.began_rn + 3)) WHERE k = 1)
SELECT d.event_id, d.source, d.flush_no, CAST((SELECT max(batch_no) FROM s WHERE s.source = d.source AND s.flush_no = d.flush_no AND s.began_rn <= d.rn) AS BIGINT) AS batch_no FROM d""")
def batch_timed(spark, sf):
    """Batches of at most 3 operations or 10 minutes, flushed every hour."""
    ops = events(spark, sf, "event_id", "ts", "user_id").withColumn("source", F.col("user_id") % 4)
    return TB.timed_batches(ops, ["source"], "ts", "event_id", 3, "10 minutes", "1 hour").drop("ts", "user_id")
