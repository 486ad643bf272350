"""Queries written as SQL statements: insert-select jobs, subqueries, flatten, grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideloom.functions.scalar import flatten_rows
from tideloom.operators import tables as TB
from tideloom.plans.function_queries import profiles
from tideloom.plans.jobs import SqlJob, apply_to_table
from tideloom.plans.join_queries import STATE, sql_query
from tideloom.plans.registry import query
from tideloom.plans.window_queries import EV, events
from tideloom.session import table


def job(spark, sf):
    """Sources as a user of streaming SQL names them: system.stream."""
    return (
        SqlJob(spark)
        .source("tracking.events", events(spark, sf), keys=["user_id"], order=["event_id"])
        .source("tracking.orders", table(spark, sf, "orders"))
        .source("store.customer", table(spark, sf, "customer"))
        .source("store.nation", table(spark, sf, "nation"))
    )


@query("sql_count_group_window", f"""
SELECT w.event_type, w.window_start, w.n, r.r_name FROM (
  SELECT event_type, ms - ms % 3600000 AS window_start, count(*) AS n FROM {EV} GROUP BY ALL) w JOIN region r ON w.n % 5 = r.r_regionkey""")
def sql_count_group_window(spark, sf):
    """Hourly counts per event type, joined to a small table."""
    return (
        job(spark, sf)
        .source("store.region", table(spark, sf, "region"))
        .run("""
        -- counts first, then a lookup by the count
        INSERT INTO counts SELECT event_type, window(ts, '1 hour') AS w, count(*) AS n
          FROM tracking.events GROUP BY event_type, window(ts, '1 hour')
        INSERT INTO named SELECT c.event_type, unix_millis(CAST(c.w.start AS TIMESTAMP)) AS window_start, c.n, r.r_name
          FROM counts c JOIN store.region r ON c.n % 5 = r.r_regionkey
        """)["named"]
    )


@query("sql_insert_select", "SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_totalprice > 100000")
def sql_insert_select(spark, sf):
    return job(spark, sf).run(
        "INSERT INTO out.big (id, state) SELECT o_orderkey, o_orderstatus FROM tracking.orders WHERE o_totalprice > 100000"
    )["out.big"]


@query("sql_script", """
SELECT 'clicks' AS sink, event_id FROM events WHERE event_type = 'click' UNION ALL SELECT 'views', event_id FROM events WHERE event_type = 'view'""")
def sql_script(spark, sf):
    sinks = job(spark, sf).run("""
      -- two statements, one source
      insert into clicks
        select event_id from tracking.events -- the stream
        where event_type = 'click'

      insert into views select event_id
        from tracking.events where event_type = 'view'
    """)
    return sinks["clicks"].select(F.lit("clicks").alias("sink"), "event_id").unionByName(
        sinks["views"].select(F.lit("views").alias("sink"), "event_id")
    )


@query("sql_fan_in", "SELECT event_id AS id, 'event' AS origin FROM events UNION ALL SELECT o_orderkey, 'order' FROM orders")
def sql_fan_in(spark, sf):
    return job(spark, sf).run([
        "INSERT INTO merged (id, origin) SELECT event_id, 'event' FROM tracking.events",
        "INSERT INTO merged (id, origin) SELECT o_orderkey, 'order' FROM tracking.orders",
    ])["merged"]


@query("sql_fan_out", """
SELECT 'rich' AS sink, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_totalprice >= 200000 UNION ALL
SELECT 'poor', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders WHERE o_totalprice < 200000""")
def sql_fan_out(spark, sf):
    sinks = job(spark, sf).run([
        "INSERT INTO rich SELECT o_custkey FROM tracking.orders WHERE o_totalprice >= 200000",
        "INSERT INTO poor SELECT o_custkey FROM tracking.orders WHERE o_totalprice < 200000",
    ])
    parts = [
        sinks[s].agg(F.lit(s).alias("sink"), F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))
        for s in ("rich", "poor")
    ]
    return parts[0].unionByName(parts[1])


@query("sql_chain", """
SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def sql_chain(spark, sf):
    """The reader of a sink may stand before its writer."""
    return job(spark, sf).run([
        "INSERT INTO per_nation SELECT n_name, count(*) AS n FROM located GROUP BY n_name",
        "INSERT INTO located SELECT n.n_name FROM closed o JOIN store.customer c ON o.o_custkey = c.c_custkey"
        " JOIN store.nation n ON c.c_nationkey = n.n_nationkey",
        "INSERT INTO closed SELECT o_custkey FROM tracking.orders WHERE o_orderstatus = 'F'",
    ])["per_nation"]


@query("sql_table_suffix", f"SELECT o.o_orderkey, s.event_type FROM orders o JOIN {STATE} s ON o.o_custkey = s.user_id")
def sql_table_suffix(spark, sf):
    """``stream.$table`` is the keyed table that the stream forms: latest event per user."""
    return job(spark, sf).run(
        "INSERT INTO x SELECT o.o_orderkey, s.event_type FROM tracking.orders o JOIN tracking.events.$table s ON o.o_custkey = s.user_id"
    )["x"]


sql_query("sql_project", "SELECT e.event_id AS id, 'const' AS label, 7 AS seven, e.event_type, c.* FROM events AS e JOIN customer c ON e.user_id = c.c_custkey", "events", "customer")
sql_query("sql_filter", """
SELECT event_id, event_type, value FROM events
WHERE (event_type IN ('view', 'click') AND NOT (value < 20)) OR (event_type LIKE 'sig%' AND (value > 30) IS TRUE) OR NULLIF(value, value) > 1""", "events")
sql_query("sql_subquery", """
SELECT b.o_custkey, b.n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS b WHERE b.n > (SELECT count(*) * 1.0 / count(DISTINCT o_custkey) FROM orders)""", "orders")
sql_query("sql_case_cast", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_totalprice > 200000 THEN 'large' ELSE 'other' END AS label,
 CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(o_custkey AS DOUBLE) AS cust, COALESCE(NULLIF(o_orderstatus, 'P'), 'pending') AS state FROM orders""", "orders")
sql_query("sql_having", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60", "events")
sql_query("sql_explicit_table", "TABLE nation", "nation", oracle="SELECT * FROM nation")
sql_query("sql_values", """
SELECT e.event_id, v.weight FROM events e JOIN (VALUES ('view', 1), ('click', 3), ('purchase', 10)) AS v(kind, weight) ON e.event_type = v.kind""", "events")


@query("sql_flatten", """
SELECT doc_id, count(*) AS n_rows, count(word) AS n_words, CAST(coalesce(sum(length(word)), 0) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, unnest(CASE WHEN lang = 'de' THEN [NULL] WHEN lang = 'fr' THEN [] ELSE string_split(text, ' ') END) AS word FROM documents) GROUP BY ALL""")
def sql_flatten(spark, sf):
    """A list gives one row per element, an empty list none, a null list one row that stays null."""
    words = F.when(F.col("lang") == "fr", F.array().cast("array<string>")).when(
        F.col("lang") != "de", F.split("text", " ")
    )
    flat = table(spark, sf, "documents").select("doc_id", flatten_rows(words).alias("word"))
    return flat.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("word").alias("n_words"),
        F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("n_chars"),
    )


sql_query("sql_unnest", """
SELECT label, pos % 8 AS slot, count(*) AS n, max(x) AS top FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x GROUP BY label, pos % 8""",
          "embeddings", oracle="""
SELECT label, (pos - 1) % 8 AS slot, count(*) AS n, max(x) AS top FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL""")


@query("sql_insert_table", f"SELECT user_id AS __key__, event_type, cents FROM {STATE}")
def sql_insert_table(spark, sf):
    """Output to a table: ``__key__`` names the key, the last row per key stays."""
    out = job(spark, sf).run(
        "INSERT INTO store.last_event SELECT user_id AS __key__, event_id, event_type, cents FROM tracking.events"
    )["store.last_event"]
    return TB.materialise(out, ["__key__"], ["event_id"]).drop("event_id")


@query("sql_upsert", """
SELECT c_custkey AS __key__, coalesce(n, c_custkey % 100) AS score FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
UNION ALL SELECT o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey""")
def sql_upsert(spark, sf):
    out = job(spark, sf).run(
        "UPSERT INTO scores SELECT o_custkey AS __key__, count(*) AS score FROM tracking.orders GROUP BY o_custkey"
    )["scores"]
    before = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("__key__"), (F.col("c_custkey") % 100).alias("score")
    )
    return apply_to_table(before, out)


@query("sql_table_delete", "SELECT c_custkey AS __key__, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sql_table_delete(spark, sf):
    out = job(spark, sf).run(
        "INSERT INTO store.names SELECT DISTINCT o_custkey AS __key__, 'DELETE' AS __op__ FROM tracking.orders WHERE o_orderstatus = 'P'"
    )["store.names"]
    before = table(spark, sf, "customer").select(F.col("c_custkey").alias("__key__"), "c_name")
    return apply_to_table(before, out)


@query("sql_function_names", """
SELECT c_custkey AS id, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS street, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) END AS street_text,
 CASE WHEN c_nationkey <> 3 THEN 'Cell' END AS third, regexp_full_match(CAST(c_custkey AS VARCHAR), '1.*') AS ones, CAST(c_custkey AS VARCHAR) AS id_text,
 CAST(trunc(CAST(c_custkey AS DECIMAL(18,4)) / 7 * 10) / 10 AS DOUBLE) AS cut, c_custkey || '!' AS packed
FROM customer WHERE c_nationkey <> 3 AND c_mktsegment SIMILAR TO '(BUILD|MACH).*'""")
def sql_function_names(spark, sf):
    """The function names of streaming SQL, in one statement."""
    people = profiles(spark, sf).withColumns(
        {"id_text": F.col("id").cast("string"), "segment": F.col("p.attrs")["segment"]}
    )
    return SqlJob(spark).source("store.profile", people).run("""
      INSERT INTO o SELECT id, GetNestedField(p, 'address.street.number') AS street, GetSqlField(p, 'address.street.number') AS street_text,
        GetNestedField(p, 'phones.any[2].kind') AS third, RegexMatch('1.*', id_text) AS ones, convertToString(id) AS id_text,
        TRUNCATE(id / 7, 1) AS cut, BuildOutputRecord('a', id, 'b', '!') AS r
      FROM store.profile WHERE segment SIMILAR TO '(BUILD|MACH)%'
    """)["o"].withColumn("packed", F.concat(F.col("r.a").cast("string"), "r.b")).drop("r")


@query("sql_flatten_call", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def sql_flatten_call(spark, sf):
    return SqlJob(spark).source("store.part", table(spark, sf, "part")).run(
        "INSERT INTO words SELECT p_partkey, Flatten(split(p_name, ' ')) AS word FROM store.part"
    )["words"]


@query("sql_flatten_nested", "SELECT p_partkey, unnest(list_filter(string_split(upper(p_name), ' '), lambda w: length(w) > 4)) AS word FROM part")
def sql_flatten_nested(spark, sf):
    """Calls within calls inside Flatten, beside a literal that looks like one."""
    return SqlJob(spark).source("store.part", table(spark, sf, "part")).run(
        "INSERT INTO words SELECT p_partkey, Flatten(filter(split(upper(p_name), ' '), w -> length(w) > 4)) AS word"
        " FROM store.part WHERE p_name <> 'Flatten(' -- all of them"
    )["words"]
