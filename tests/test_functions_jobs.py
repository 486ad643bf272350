"""Scalar functions, codecs, user functions and SQL jobs."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions import codecs as C
from tideloom.functions import scalar as S
from tideloom.functions.registry import FunctionSet
from tideloom.functions.times import duration_ms
from tideloom.operators import aggregates as A
from tideloom.operators import stateless as ST
from tideloom.plans.jobs import SqlJob, apply_to_table, read_insert, split_script


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.col("id")])
    return df.select(column.alias("x")).first()["x"]


def test_durations():
    assert duration_ms("5 minutes") == 300_000 and duration_ms("1 day") == 86_400_000 and duration_ms(7) == 7
    with pytest.raises(ValueError):
        duration_ms("soon")


@pytest.mark.parametrize("x,n,want", [(1.15, 2, 1.15), (-1.159, 2, -1.15), (29.99, 0, 29.0), (0.07, 1, 0.0), (None, 1, None)])
def test_truncate(spark, x, n, want):
    assert one(spark, S.truncate(F.lit(x).cast("double"), n)) == want


@pytest.mark.parametrize("s,p,want", [
    ("abc", "a%", True), ("abc", "(a|b)_c", True), ("abc", "b%", False), ("a%c", "a\\%c", True), ("abc", "a\\%c", False),
])
def test_similar(spark, s, p, want):
    assert one(spark, S.similar_to(F.lit(s), p)) is want


def test_element_and_emptiness(spark):
    one_value = F.array(F.lit(4))
    assert one(spark, S.element(one_value)) == 4
    assert one(spark, S.element(F.array().cast("array<int>"))) is None
    with pytest.raises(Exception, match="more than one"):
        one(spark, S.element(F.array(F.lit(1), F.lit(2))))
    assert one(spark, S.is_empty(F.lit(None).cast("array<int>"))) is None
    assert one(spark, S.is_empty(F.array())) is True and one(spark, S.is_not_empty(one_value)) is True


BAF = T.ArrayType(T.StructType().add("foo", T.IntegerType()))
BAR = T.StructType().add("baz", T.ArrayType(T.StructType().add("baf", BAF))).add("tags", T.MapType(T.StringType(), T.StringType()))
NESTED = T.StructType().add("bar", BAR).add("n", T.IntegerType())


def nested(spark, value, path, strict=True):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("r", NESTED)]))
    return df.select(S.nested_field("r", NESTED, path, strict).alias("x")).first()["x"]


def test_nested_field(spark):
    record = ((([([(1,), (2,)],), ([(3,)],)]), {"a": "x"}), 5)
    assert nested(spark, record, "n") == 5
    assert nested(spark, record, "bar.baz.any[1].baf.any[0].foo".replace("baz.any", "baz.el").replace("baf.any", "baf.el")) == 3
    assert nested(spark, record, "bar.tags.a") == "x"
    assert nested(spark, None, "bar.tags.a") is None
    assert nested(spark, (None, 5), "bar.baz.any[0].baf") is None
    assert nested(spark, record, "bar.tags.zz", strict=False) is None
    with pytest.raises(Exception, match="no key zz"):
        nested(spark, record, "bar.tags.zz")
    with pytest.raises(Exception, match="no element 9"):
        nested(spark, record, "bar.baz.any[9].baf")
    for bad in ("nope", "bar.baz.foo", "n.x", "bar.baz[0]"):
        with pytest.raises(ValueError):
            S.nested_field("r", NESTED, bad)


def test_build_record(spark):
    got = one(spark, S.build_record("a", F.lit(1), "b", S.build_record("c", "x")))
    assert got["a"] == 1 and got["b"]["c"] == "x"
    with pytest.raises(ValueError):
        S.build_record("a")
    with pytest.raises(Exception, match="null has no text"):
        one(spark, S.to_text(F.lit(None).cast("int")))


def test_flatten_rows(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None), (4, [None])], "id int, a array<int>")
    got = df.select("id", S.flatten_rows("a").alias("x")).collect()
    assert sorted((r["id"], r["x"] if r["x"] is not None else -1) for r in got) == [(1, 1), (1, 2), (3, -1), (4, -1)]


@pytest.mark.parametrize("value", [0, 1, -1, 2**63 - 1, -(2**63), 255])
def test_long_codec(spark, value):
    assert bytes(one(spark, C.encode_long(F.lit(value)))) == value.to_bytes(8, "big", signed=True)
    assert one(spark, C.decode_long(C.encode_long(F.lit(value)))) == value


def test_other_codecs(spark):
    import struct

    for v in (0, -7, 2**31 - 1, -(2**31)):
        assert bytes(one(spark, C.encode_int(F.lit(v)))) == v.to_bytes(4, "big", signed=True)
        assert one(spark, C.decode_int(C.encode_int(F.lit(v)))) == v
    for v in (0.1, -3.5, 1e300):
        assert bytes(one(spark, C.encode_double(F.lit(v)))) == struct.pack(">d", v)
        assert one(spark, C.decode_double(C.encode_double(F.lit(v)))) == v
    assert one(spark, C.encode_double(F.lit(None).cast("double"))) is None
    u = uuid.uuid4()
    assert bytes(one(spark, C.encode_uuid(F.lit(str(u))))) == u.bytes
    assert one(spark, C.decode_uuid(C.encode_uuid(F.lit(str(u))))) == str(u)


def test_project_to_schema(spark):
    df = spark.createDataFrame(
        [(1, (0.1, [("a", 1)]), "x"), (2, None, "y")], "id int, r struct<f: float, l: array<struct<n: string, dropped: int>>>, extra string"
    )
    schema = T.StructType.fromDDL("id bigint, r struct<f: double, l: array<struct<n: string, more: int>>, missing: string>, absent double")
    got = C.project_to_schema(df, schema, float_as_text=True).orderBy("id").collect()
    assert got[0].asDict(True) == {"id": 1, "r": {"f": 0.1, "l": [{"n": "a", "more": None}], "missing": None}, "absent": None}
    assert got[1]["r"] is None


def test_function_set(spark):
    fs = FunctionSet()
    fs.define("off", enabled=False)
    fs.method("twice", ("bigint",), "bigint")(lambda config: lambda x: x * 2)
    fs.method("twice", ("string",), "string")(lambda config: lambda x: F.concat(x, x))
    df = spark.createDataFrame([(3, "ab", 1.5)], "a bigint, b string, c double")
    row = df.select(fs.call(df, "TWICE", F.col("a")).alias("a"), fs.call(df, "twice", F.col("b")).alias("b")).first()
    assert tuple(row) == (6, "abab")
    with pytest.raises(TypeError):
        fs.call(df, "twice", F.col("c"))
    for name in ("off", "unknown"):
        with pytest.raises(LookupError):
            fs.call(df, name, F.col("a"))


def test_script_and_statements():
    script = "-- note\nInsert into a.b select x\n  -- inner\n from c\n\nINSERT INTO d (p, q) select y, z from a.b;\n"
    first, second = split_script(script)
    assert first == "Insert into a.b select x from c"
    insert = read_insert(second)
    assert (insert.sink, insert.columns, insert.select, insert.upsert) == ("d", ("p", "q"), "select y, z from a.b", False)
    assert read_insert("upsert into t select 1").upsert
    for bad in ("select 1", "insert into t", "delete from t"):
        with pytest.raises(ValueError):
            read_insert(bad)


def test_job_names_chains_and_cycles(spark):
    job = SqlJob(spark).source("s.t", spark.createDataFrame([(1, "s.t"), (2, "b")], "id bigint, name string"), keys=["id"], order=["name"])
    got = job.run([
        "insert into late select id from early",
        "insert into early select x.id from s.t x where x.name = 's.t'",
        "insert into early select id from s.t.$table where id = 2",
    ])
    assert sorted(r["id"] for r in got["late"].collect()) == [1, 2]
    with pytest.raises(ValueError):
        job.run(["insert into p select id from q", "insert into q select id from p"])


def test_apply_to_table(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "__key__ bigint, v string")
    out = spark.createDataFrame([(1, "DELETE", None), (2, None, "B"), (3, "UPDATE", "C")], "__key__ bigint, __op__ string, v string")
    assert sorted(tuple(r) for r in apply_to_table(table, out).collect()) == [(2, "B"), (3, "C")]


def test_partition_layout(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(200)], "id bigint, k bigint")
    placed = ST.partition_by(df, 4, "k", "key", spread=3).withColumn("here", F.spark_partition_id()).collect()
    for r in placed:
        assert r["here"] // 3 == r["partition"] == (0 if r["k"] is None else r["k"] % 4)
    assert len({r["here"] for r in placed if r["partition"] == 0}) == 3


def test_observed_filter_counts(spark):
    from pyspark.sql import Observation

    seen = Observation()
    df = spark.createDataFrame([(1,), (None,), (5,)], "x bigint")
    assert A.observed_filter(df, F.col("x") > 2, seen).count() == 1
    assert seen.get == {"n_in": 3, "n_out": 1}


def test_async_flat_map_fails_on_error_and_timeout(spark):
    import time

    def broken():
        def call(record):
            raise KeyError("boom")
        return call

    def slow():
        def call(record):
            time.sleep(1.5)
            return []
        return call

    df = spark.range(3)
    with pytest.raises(Exception, match="boom"):
        ST.flat_map_async(df, broken, "id bigint").collect()
    with pytest.raises(Exception, match="Timeout"):
        ST.flat_map_async(df, slow, "id bigint", timeout_s=0.1, records_per_turn=1).collect()


def test_broker_startpoints():
    from tideloom.sources.streams import broker_start

    assert broker_start("oldest") == {"startingOffsets": "earliest"}
    assert broker_start("upcoming") == {"startingOffsets": "latest"}
    assert broker_start("offset", {"t": {0: 5}}) == {"startingOffsets": '{"t": {"0": 5}}'}
    assert broker_start("timestamp", timestamp_ms=7)["startingTimestamp"] == "7"
    with pytest.raises(ValueError):
        broker_start("later")


def test_file_groups(spark):
    from tideloom.sources.files import file_groups

    paths = ["/d/run_2016-part-3.avro", "/d/run_2017-part-3.avro", "/d/run_2016-part-12.avro", "/d/other.txt"]
    got = file_groups(spark.createDataFrame([(p,) for p in paths], "file_path string"), r".*part-[id]\.avro").collect()
    assert {r["file_path"]: (r["group_id"], r["file_no"]) for r in got} == {
        paths[0]: ("3", 1), paths[1]: ("3", 2), paths[2]: ("12", 1), paths[3]: (paths[3], 1),
    }


def test_streaming_sql_forms():
    from tideloom.plans.jobs import in_spark_words as words

    assert words("select GetNestedField(a.b, 'c.any[3].d') x") == "select a.b.`c`[3].`d` x"
    assert words("select getsqlfield(a, 'b')") == "select CAST(a.`b` AS STRING)"
    assert words("where t.n not similar to 'a''b%'") == "where NOT SimilarTo(t.n, 'a''b%')"
    assert words("select Flatten(a) x") == "select explode(CASE WHEN a IS NULL THEN array(NULL) ELSE a END) x"
    assert words("select flatten(split(a, ' ')) x").startswith("select explode(CASE WHEN split(a, ' ') IS NULL")


def test_working_folder():
    from types import SimpleNamespace as N

    from tideloom.session import shared_folder

    def session(master, configured=None):
        context = N(master=master, getCheckpointDir=lambda: None)
        return N(conf=N(get=lambda name, default: configured), sparkContext=context)

    assert shared_folder(session("spark://x", "hdfs://shared/"), "p").startswith("hdfs://shared/tideloom-p-")
    assert "tideloom-" in shared_folder(session("local[2]"), "p")
    with pytest.raises(ValueError):
        shared_folder(session("spark://x"), "p")


def test_async_calls_get_plain_values(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(1, big), (2, None)], "id bigint, k bigint")

    def make():
        return lambda r: [{"id": r["id"], "k": r["k"], "kind": type(r["k"]).__name__}]

    got = ST.flat_map_async(df, make, "id bigint, k bigint, kind string")
    assert sorted(map(tuple, got.collect())) == [(1, big, "int"), (2, None, "NoneType")]


def test_a_call_that_hangs_fails_its_task_at_once(spark):
    import time

    def make():
        return lambda r: time.sleep(600) or []

    begun = time.time()
    with pytest.raises(Exception, match="TimeoutError"):
        ST.flat_map_async(spark.range(1), make, "id bigint", timeout_s=0.1, records_per_turn=1).collect()
    assert time.time() - begun < 60


def test_doubles_keep_nan_and_null_apart(spark):
    from tideloom.functions import codecs

    df = spark.sql("SELECT * FROM VALUES (1, CAST('NaN' AS DOUBLE)), (2, NULL), (3, -0.5D), (4, CAST('-Infinity' AS DOUBLE)) t(i, x)")
    got = df.select("i", codecs.encode_double("x").alias("b")).select("i", F.hex("b").alias("h"), codecs.decode_double("b").alias("x")).orderBy("i").collect()
    assert [r["h"] for r in got] == ["7FF8000000000000", None, "BFE0000000000000", "FFF0000000000000"]
    assert str(got[0]["x"]) == "nan" and [r["x"] for r in got[1:]] == [None, -0.5, float("-inf")]


def test_truncate_before_the_point_and_exactly(spark):
    from tideloom.functions import scalar

    scalar.register_sql(spark)
    row = spark.sql("SELECT TRUNCATE(1234.5, -2), TRUNCATE(-1.239D, 2), TRUNCATE(1e300D, 1), TRUNCATE_WHOLE(9007199254740993L, 0), TRUNCATE_WHOLE(-1299, -2)").first()
    assert tuple(row) == (1200.0, -1.23, 1e300, 9007199254740993, -1200)
    x = spark.sql("SELECT 9007199254740993L AS x, CAST(-129.55 AS DECIMAL(10,2)) AS d")
    got = x.select(scalar.truncate("x", 0, whole=True), scalar.truncate("x", -1, whole=True), scalar.truncate("d", -1, whole=True)).first()
    assert got[0] == 9007199254740993 and got[1] == 9007199254740990 and float(got[2]) == -120


@pytest.mark.parametrize("text,pattern,want", [("a%c", r"a\%c", True), ("abc", r"a\%c", False), ("abc", "a%", True), ("a.c", r"a\.c", True), ("xdx", r"x\dx", True), ("a\nb", "a_b", False)])
def test_both_forms_of_similar_to_agree(spark, text, pattern, want):
    from tideloom.functions import scalar

    scalar.register_sql(spark)
    df = spark.createDataFrame([(text, pattern)], "s string, p string")
    assert df.select(scalar.similar_to("s", pattern)).first()[0] == want
    assert df.selectExpr("SimilarTo(s, p)").first()[0] == want


def _job(spark):
    from tideloom.plans.jobs import SqlJob

    rows = spark.createDataFrame([(i, "click" if i % 3 == 0 else "view", [i, None]) for i in range(10)], "id bigint, kind string, xs array<bigint>")
    return SqlJob(spark).source("t.ev", rows)


def test_comments_end_with_their_line(spark):
    out = _job(spark).run("""
      insert into o -- the sink
        SELECT id, '-- no comment' AS c FROM t.ev -- the stream
        /* a filter
           over two lines */ WHERE kind = 'click'""")["o"]
    assert out.count() == 4 and out.first()["c"] == "-- no comment"


def test_names_keep_apart(spark):
    from tideloom.plans.jobs import SqlJob

    spark.range(7).createOrReplaceTempView("a__b")
    job = SqlJob(spark).source("a.b", spark.range(10)).source("a__b", spark.range(1)).source("a_.b", spark.range(3))
    got = job.run(["INSERT INTO x SELECT a.b.id FROM a.b", "INSERT INTO y SELECT * FROM a__b", "INSERT INTO z SELECT q.id FROM a_.b q, a.b r WHERE q.id = r.id"])
    assert [got[n].count() for n in "xyz"] == [10, 1, 3]
    assert spark.table("a__b").count() == 7


def test_a_sink_may_have_the_name_of_a_column(spark):
    got = _job(spark).run(["INSERT INTO id SELECT id FROM t.ev WHERE id < 3", "INSERT INTO kind SELECT id FROM id WHERE id > 0"])
    assert got["id"].count() == 3 and got["kind"].count() == 2


def test_literals_and_nested_calls(spark):
    got = _job(spark).run("""
      INSERT INTO o SELECT 'BuildOutputRecord(' AS a, 'x SIMILAR TO y' AS b, 'from t.ev' AS c, upper(lower(kind)) SIMILAR TO 'C%' AS d,
        Flatten(filter(xs, x -> coalesce(x, abs(-1)) > 4)) AS e, BuildOutputRecord('k', id) AS r FROM t.ev""")["o"]
    rows = got.collect()
    assert {(r["a"], r["b"], r["c"]) for r in rows} == {("BuildOutputRecord(", "x SIMILAR TO y", "from t.ev")}
    assert sorted((r["e"], r["d"], r["r"]["k"]) for r in rows) == [(i, i % 3 == 0, i) for i in range(5, 10)]
