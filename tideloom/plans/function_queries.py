"""Queries over scalar functions, codecs and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions import codecs as C
from tideloom.functions import scalar as S
from tideloom.functions.registry import FunctionSet
from tideloom.plans.join_queries import sql_query
from tideloom.plans.registry import query
from tideloom.plans.window_queries import events
from tideloom.session import table

sql_query("fn_predicates", """
SELECT o_orderkey, o_totalprice > 200000 AND o_orderstatus <> 'F' AS a, o_totalprice >= 100000 OR o_orderstatus = 'P' AS b, NOT (o_custkey < 50) AS c,
 o_custkey <= 20 AS d, o_orderpriority IN ('1-URGENT', '2-HIGH') AS e, o_orderpriority NOT IN ('5-LOW') AS f, o_totalprice BETWEEN 1000 AND 90000 AS g FROM orders""", "orders")
sql_query("fn_truth_tests", """
SELECT event_id, v IS NULL AS a, v IS NOT NULL AS b, (v > 20) IS TRUE AS c, (v > 20) IS NOT TRUE AS d, (v > 20) IS FALSE AS e, (v > 20) IS NOT FALSE AS f
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) t""", "events")
sql_query("fn_arith", """
SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS b, l_partkey * l_linenumber AS c, l_partkey div 7 AS d, - l_suppkey AS e, + l_suppkey AS f,
 mod(l_partkey, 11) AS g, -l_partkey % 11 AS h, l_quantity / 4 AS i FROM lineitem""", "lineitem", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey + l_suppkey AS a, l_partkey - l_suppkey AS b, l_partkey * l_linenumber AS c, l_partkey // 7 AS d, - l_suppkey AS e, + l_suppkey AS f,
 mod(l_partkey, 11) AS g, -l_partkey % 11 AS h, l_quantity / 4 AS i FROM lineitem""")


@query("fn_math", """
SELECT event_id, round(power(value, 2), 4) AS a, round(value) AS b, round(sqrt(value), 6) AS c, CAST(floor(value) AS BIGINT) AS d, CAST(ceil(value) AS BIGINT) AS e,
 CAST(trunc(CAST(value AS DECIMAL(18,4)) * 10) / 10 AS DOUBLE) AS f, CAST(trunc(CAST(-value AS DECIMAL(18,4)) * 10) / 10 AS DOUBLE) AS g FROM events""")
def fn_math(spark, sf):
    S.register_sql(spark)
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql("""
      SELECT event_id, round(power(value, 2), 4) AS a, round(value) AS b, round(sqrt(value), 6) AS c, floor(value) AS d, ceil(value) AS e,
        TRUNCATE(value, 1) AS f, value AS raw FROM events""").withColumn("g", S.truncate(-F.col("raw"), 1)).drop("raw")


sql_query("fn_string", """
SELECT p_partkey, p_name || '-' || p_brand AS a, p_name LIKE '%ed%' AS b, p_name NOT LIKE 's_all%' AS c, upper(p_name) AS d, lower(p_type) AS e, trim(concat('  ', p_name, ' ')) AS f,
 substring(p_name FROM 2 FOR 4) AS g, replace(p_name, 'e', 'EE') AS h, overlay(p_name PLACING 'XY' FROM 2 FOR 3) AS i, position('r' IN p_name) AS j, char_length(p_name) AS k,
 character_length(p_type) AS l, initcap(p_name) AS m, coalesce(NULLIF(p_brand, 'Brand#2'), 'none') AS n FROM part""", "part", oracle="""
SELECT p_partkey, p_name || '-' || p_brand AS a, p_name LIKE '%ed%' AS b, p_name NOT LIKE 's_all%' AS c, upper(p_name) AS d, lower(p_type) AS e, trim(concat('  ', p_name, ' ')) AS f,
 substring(p_name FROM 2 FOR 4) AS g, replace(p_name, 'e', 'EE') AS h, left(p_name, 1) || 'XY' || substring(p_name, 5) AS i, position('r' IN p_name) AS j, length(p_name) AS k,
 length(p_type) AS l, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS m, coalesce(NULLIF(p_brand, 'Brand#2'), 'none') AS n FROM part""")


@query("fn_similar", """
SELECT p_partkey, p_name SIMILAR TO '(small|red).*' AS a, NOT (p_name SIMILAR TO '.*(ring|widget)') AS b, p_brand SIMILAR TO 'Brand#[0-9].?' AS c, p_type SIMILAR TO 'E.*Y' AS d FROM part""")
def fn_similar(spark, sf):
    S.register_sql(spark)
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT *, SimilarTo(p_type, 'E%Y') AS d FROM part").select(
        "p_partkey", S.similar_to("p_name", "(small|red)%").alias("a"),
        (~S.similar_to("p_name", "%(ring|widget)")).alias("b"), S.similar_to("p_brand", "Brand#[0-9]_?").alias("c"), "d",
    )


def words(spark, sf):
    """Documents with their words as a list; German texts have none, French ones a null list."""
    w = F.when(F.col("lang") == "de", F.array().cast("array<string>")).when(F.col("lang") != "fr", F.split("text", " "))
    return table(spark, sf, "documents").select("doc_id", "lang", w.alias("words"))


WORDS = "(SELECT doc_id, lang, CASE WHEN lang = 'de' THEN [] WHEN lang = 'fr' THEN NULL ELSE string_split(text, ' ') END AS words FROM documents)"


@query("fn_empty", f"SELECT doc_id, len(words) = 0 AS empty, len(words) > 0 AS filled FROM {WORDS}")
def fn_empty(spark, sf):
    return words(spark, sf).select("doc_id", S.is_empty("words").alias("empty"), S.is_not_empty("words").alias("filled"))


@query("fn_collections", f"""
SELECT doc_id, words[1] AS first_word, CAST(len(words) AS INTEGER) AS card, list_contains(words, 'the') AS has_the, words[1] || '/' || lang AS row_text, 'lang' AS only_key, lang AS only_value,
 CAST(len([lang, 'x']) AS INTEGER) AS two FROM {WORDS}""")
def fn_collections(spark, sf):
    words(spark, sf).createOrReplaceTempView("words")
    got = spark.sql("""
      SELECT doc_id, get(words, 0) AS first_word, CASE WHEN words IS NOT NULL THEN cardinality(words) END AS card, array_contains(words, 'the') AS has_the,
        named_struct('w', get(words, 0), 'l', lang) AS r, map('lang', lang) AS m, array(lang, 'x') AS pair FROM words""")
    return got.select(
        "doc_id", "first_word", "card", "has_the", F.expr("r.w || '/' || r.l").alias("row_text"),
        S.element(F.map_keys("m")).alias("only_key"), F.expr("m['lang']").alias("only_value"),
        F.size("pair").alias("two"),
    )


sql_query("fn_collection_subquery", """
SELECT r_regionkey, r_name, (SELECT array_join(array_sort(collect_list(n_name)), ',') FROM nation WHERE n_regionkey = r_regionkey) AS names,
 (SELECT cardinality(map_from_entries(collect_list(named_struct('k', n_nationkey, 'v', n_name)))) FROM nation WHERE n_regionkey = r_regionkey) AS n,
 EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9000) AS rich FROM region""",
          "region", "nation", "customer", oracle="""
SELECT r_regionkey, r_name, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) AS names,
 (SELECT CAST(count(*) AS INTEGER) FROM nation WHERE n_regionkey = r_regionkey) AS n,
 EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND c_acctbal > 9000) AS rich FROM region""")
sql_query("fn_date_parts", """
SELECT event_id, extract(YEAR FROM ts) AS y, quarter(ts) AS q, month(ts) AS mo, weekofyear(ts) AS w, dayofyear(ts) AS doy, dayofmonth(ts) AS dom, dayofweek(ts) AS dow, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events""",
          "events", oracle="""
SELECT event_id, extract(YEAR FROM ts) AS y, quarter(ts) AS q, month(ts) AS mo, weekofyear(ts) AS w, dayofyear(ts) AS doy, day(ts) AS dom, dayofweek(ts) + 1 AS dow, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events""")
sql_query("fn_timestamp_arith", """
SELECT o_orderkey, timestampadd(MONTH, 1, o_orderdate) AS next_month, timestampadd(HOUR, -5, o_orderdate) AS earlier, timestampdiff(DAY, TIMESTAMP_NTZ '1992-01-01', o_orderdate) AS days,
 timestampdiff(HOUR, TIMESTAMP_NTZ '1992-01-01', o_orderdate) AS hours FROM orders""", "orders", oracle="""
SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS next_month, o_orderdate - INTERVAL 5 HOUR AS earlier, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days,
 date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate) AS hours FROM orders""")
sql_query("fn_clock", """
SELECT event_id, ts < localtimestamp() AS a, CAST(ts AS DATE) < current_date() AS b, CAST(ts AS TIMESTAMP) < current_timestamp() AS c, current_time() IS NOT NULL AS d FROM events""",
          "events", oracle="""
SELECT event_id, ts < localtimestamp AS a, CAST(ts AS DATE) < current_date AS b, ts < localtimestamp AS c, true AS d FROM events""")
sql_query("fn_cast", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_partkey AS VARCHAR(20)) AS b, CAST(CAST(l_partkey AS VARCHAR(20)) AS BIGINT) AS c, CAST(l_shipdate AS DATE) AS d,
 CAST(l_linenumber AS DOUBLE) AS e, CAST(l_linenumber > 3 AS INT) AS f FROM lineitem""", "lineitem")

# --- shipped functions -----------------------------------------------------------------------------


@query("udf_regex_match", "SELECT page_id, regexp_full_match(url, 'https?://[a-z.]*example.*') AS a, regexp_full_match(url, '.*page=[0-9]+.*') AS b FROM pages")
def udf_regex_match(spark, sf):
    S.register_sql(spark)
    table(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql("SELECT page_id, url, RegexMatch('https?://[a-z.]*example.*', url) AS a FROM pages").select(
        "page_id", "a", S.regex_match(".*page=[0-9]+.*", "url").alias("b")
    )


def profiles(spark, sf):
    """Customers as nested records: struct, map, list of structs."""
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.struct(F.col("c_nationkey").alias("number")).alias("street")).alias("address"),
            F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("attrs"),
            F.array(
                *[F.struct(F.lit(k).alias("kind"), (F.col("c_custkey") * 10 + i).alias("number"))
                  for i, k in enumerate(("Home", "Work", "Cell"))]
            ).alias("phones"),
        ).alias("p"),
    )
    return c.withColumn("p", F.when(F.col("p.address.street.number") != 3, F.col("p")))


NULLED = "CASE WHEN c_nationkey <> 3 THEN {} END"


@query("udf_nested_field", f"""
SELECT c_custkey AS id, {NULLED.format('c_nationkey')} AS street, {NULLED.format('c_mktsegment')} AS segment, {NULLED.format("'Work'")} AS kind, {NULLED.format('c_custkey * 10 + 2')} AS cell FROM customer""")
def udf_nested_field(spark, sf):
    df = profiles(spark, sf)
    kind = df.schema["p"].dataType
    path = lambda p: S.nested_field("p", kind, p)
    return df.select(
        "id", path("address.street.number").alias("street"), path("attrs.segment").alias("segment"),
        path("phones.any[1].kind").alias("kind"), path("phones.any[2].number").alias("cell"),
    )


@query("udf_get_sql_field", f"SELECT c_custkey AS id, {NULLED.format('CAST(c_nationkey AS VARCHAR)')} AS street FROM customer")
def udf_get_sql_field(spark, sf):
    df = profiles(spark, sf)
    return df.select("id", S.nested_field("p", df.schema["p"].dataType, "address.street.number").cast("string").alias("street"))


@query("udf_build_record", """
SELECT o_orderkey, o_custkey AS cust, o_orderstatus AS state, 'v1' AS version, CAST(o_orderkey AS VARCHAR) || o_orderstatus AS label FROM orders""")
def udf_build_record(spark, sf):
    record = S.build_record(
        "cust", F.col("o_custkey"), "inner", S.build_record("state", F.col("o_orderstatus"), "version", "v1"),
    )
    df = table(spark, sf, "orders").select("o_orderkey", record.alias("r"))
    return df.select(
        "o_orderkey", "r.cust", "r.inner.state", "r.inner.version",
        F.concat(F.col("o_orderkey").cast("string"), F.col("r.inner.state")).alias("label"),
    )


@query("udf_to_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey % 2 = 0 AS VARCHAR) AS b FROM orders")
def udf_to_string(spark, sf):
    S.register_sql(spark)
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    df = spark.sql("SELECT o_orderkey, convertToString(o_custkey) AS a FROM orders")
    return df.withColumn("b", S.to_text(F.col("o_orderkey") % 2 == 0))


# --- user functions --------------------------------------------------------------------------------


def functions():
    fs = FunctionSet()
    fs.define("Scaled", config={"factor": 3})

    @fs.method("Scaled", ("bigint",), "bigint", arrow=True)
    def scaled(config):
        factor = config["factor"]
        return lambda x: x * factor

    @fs.method("Sized", ("bigint",), "bigint")
    def doubled(config):
        return lambda x: x * 2

    @fs.method("Sized", ("string",), "bigint")
    def measured(config):
        return lambda s: F.length(s).cast("bigint")

    @fs.method("Parts", ("string",), "array<string>")
    def parts(config):
        return lambda s: F.split(s, " ")

    @fs.method("Entry", None, "struct")
    def entry(config):
        return lambda *cols: F.struct(*[c.alias(f"f{i}") for i, c in enumerate(cols)])

    fs.define("Hidden", enabled=False)
    return fs


@query("udf_scalar", "SELECT event_id, event_id * 3 AS tripled FROM events")
def udf_scalar(spark, sf):
    """A configured Python function, called from SQL text and run on Arrow batches."""
    functions().register(spark)
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT event_id, Scaled(event_id) AS tripled FROM events")


@query("udf_polymorphic", "SELECT event_id, event_id * 2 AS a, CAST(length(event_type) AS BIGINT) AS b FROM events")
def udf_polymorphic(spark, sf):
    fs, df = functions(), table(spark, sf, "events")
    return df.select(
        "event_id", fs.call(df, "Sized", F.col("event_id")).alias("a"), fs.call(df, "sized", F.col("event_type")).alias("b")
    )


@query("sql_udf_polymorphic", "SELECT event_id, event_id * 2 AS a, CAST(length(event_type) AS BIGINT) AS b, CAST(event_id % 7 AS BIGINT) * 2 AS c FROM events")
def sql_udf_polymorphic(spark, sf):
    """One function name in SQL text, its body picked by the argument's type; an INT goes to the BIGINT body."""
    fs = FunctionSet()
    fs.method("Measure", ("bigint",), "bigint", arrow=True)(lambda config: lambda x: x * 2)
    fs.method("Measure", ("string",), "bigint", arrow=True)(lambda config: lambda x: x.str.len())
    fs.register(spark)
    events = table(spark, sf, "events")
    return spark.sql(
        "SELECT event_id, Measure(event_id) AS a, Measure(event_type) AS b, Measure(CAST(event_id % 7 AS INT)) AS c FROM {events}", events=events
    )


@query("udf_array_flatten", """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_brand || '|' || p_type AS entry FROM part""")
def udf_array_flatten(spark, sf):
    fs, df = functions(), table(spark, sf, "part")
    flat = df.select(
        "p_partkey", S.flatten_rows(fs.call(df, "Parts", F.col("p_name"))).alias("word"),
        fs.call(df, "Entry", F.col("p_brand"), F.col("p_type")).alias("e"),
    )
    return flat.select("p_partkey", "word", F.concat_ws("|", "e.f0", "e.f1").alias("entry"))


# --- codecs ----------------------------------------------------------------------------------------


@query("decode_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"e\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS packed FROM events")
def decode_json_props(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", C.decode_json("props", "k bigint").getField("k").alias("k"),
        C.encode_json(F.col("event_id").alias("e"), F.col("event_type").alias("t")).alias("packed"),
    )


@query("codec_roundtrip", """
SELECT event_id, lower(lpad(hex(event_id), 16, '0')) AS long_hex, event_id - 5000 AS long_back, CAST(3 - event_id AS INTEGER) AS int_back, value AS double_back, event_type AS text_back,
 substr(md5(event_type), 1, 8) || '-' || substr(md5(event_type), 9, 4) || '-' || substr(md5(event_type), 13, 4) || '-' || substr(md5(event_type), 17, 4) || '-' || substr(md5(event_type), 21, 12) AS uuid_back,
 8 + length(event_type) AS kv_bytes FROM events""")
def codec_roundtrip(spark, sf):
    df = table(spark, sf, "events")
    uuid = F.regexp_replace(F.md5("event_type"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    packed = df.select(
        "event_id", C.encode_long("event_id").alias("l0"), C.encode_long(F.col("event_id") - 5000).alias("l"),
        C.encode_int(3 - F.col("event_id")).alias("i"), C.encode_double("value").alias("d"),
        C.encode_string("event_type").alias("s"), C.encode_uuid(uuid).alias("u"),
        C.key_value(C.encode_long("user_id"), C.encode_string("event_type")).alias("kv"),
    )
    return packed.select(
        "event_id", F.lower(F.hex("l0")).alias("long_hex"), C.decode_long("l").alias("long_back"),
        C.decode_int("i").alias("int_back"), C.decode_double("d").alias("double_back"),
        C.decode_string("s").alias("text_back"), C.decode_uuid("u").alias("uuid_back"),
        (F.octet_length("kv.key") + F.octet_length("kv.value")).alias("kv_bytes"),
    )


@query("project_to_schema", """
SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS score, CASE WHEN c_nationkey <> 3 THEN 'x' || c_mktsegment END AS seg,
 CASE WHEN c_nationkey <> 3 THEN c_custkey * 10 + 2 END AS cell FROM customer""")
def project_to_schema(spark, sf):
    df = profiles(spark, sf).withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")))
    schema = T.StructType.fromDDL(
        "id bigint, name string, score double, p struct<attrs: map<string, string>, nick: string, phones: array<struct<number: bigint, ext: int>>>"
    )
    got = C.project_to_schema(df.withColumn("unknown", F.lit(1)), schema)
    return got.select(
        "id", "name", "score", F.concat(F.lit("x"), F.col("p.attrs")["segment"]).alias("seg"),
        F.col("p.phones")[2]["number"].alias("cell"),
    )


@query("float_via_text", """
SELECT vec_id, CAST(place - 1 AS INTEGER) AS place, CAST(CAST(embedding[place] AS VARCHAR) AS DOUBLE) AS value, CAST(len(embedding) AS INTEGER) AS n
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings)""")
def float_via_text(spark, sf):
    """Every element at full precision: the double has the decimal text of the float."""
    schema = T.StructType.fromDDL("vec_id bigint, embedding array<double>")
    got = C.project_to_schema(table(spark, sf, "embeddings"), schema, float_as_text=True)
    return got.select("vec_id", F.posexplode("embedding").alias("place", "value"), F.size("embedding").alias("n"))


