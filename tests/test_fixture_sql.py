"""SQL jobs over small records made of the given tables, against results worked out in Python."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions import scalar as S
from tideloom.functions.codecs import project_to_schema
from tideloom.plans.jobs import SqlJob

LIMIT = 40


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Records:
    """Views (kind, customer), customers with nested fields, and nations; ``holes`` leaves out every third key."""

    def __init__(self, spark, folder):
        read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
        self.views = [
            (r["event_type"], i % 25 + 1) for i, r in enumerate(read("events").orderBy("event_id").limit(LIMIT).collect())
        ]
        self.nations = {r["n_nationkey"]: r["n_name"] for r in read("nation").collect()}
        self.customers = {
            r["c_custkey"]: (r["c_mktsegment"], r["c_nationkey"])
            for r in read("customer").filter("c_custkey BETWEEN 1 AND 25").collect()
        }
        self.spark = spark

    @staticmethod
    def hole(key):
        return key % 3 == 0

    def view_rows(self, holes=False):
        data = [(kind, None if holes and self.hole(key) else key) for kind, key in self.views]
        return self.spark.createDataFrame(data, "kind string, customer bigint")

    def customer_rows(self, holes=False):
        data = [
            (key, segment, None if holes and self.hole(key) else nation, ((nation, self.nations[nation]), [f"{key}-a", f"{key}-b"]), {"main": (key, segment)})
            for key, (segment, nation) in self.customers.items()
        ]
        return self.spark.createDataFrame(
            data,
            "id bigint, segment string, nation bigint, place struct<land: struct<code: bigint, name: string>, lines: array<string>>, "
            "accounts map<string, struct<number: bigint, segment: string>>",
        )

    def nation_rows(self):
        return self.spark.createDataFrame(list(self.nations.items()), "id bigint, name string")


@pytest.fixture(scope="module")
def made(spark, data):
    return Records(spark, data)


@pytest.fixture
def job(spark, made):
    return (
        SqlJob(spark)
        .source("in.views", made.view_rows())
        .source("in.holes", made.view_rows(True))
        .source("in.customer.$table", made.customer_rows())
        .source("in.lost.$table", made.customer_rows(True))
        .source("in.nation.$table", made.nation_rows())
    )


JOIN = "insert into out.named select v.kind, c.segment from {} v {} join in.customer.$table c on v.customer = c.id"
RIGHT = "insert into out.named select v.kind, c.segment from in.customer.$table c right join {} v on v.customer = c.id"


def test_inner_join_keeps_every_view(job, made):
    got = job.run(JOIN.format("in.views", ""))["out.named"]
    assert rows(got) == sorted(((kind, made.customers[key][0]) for kind, key in made.views), key=repr)


def test_null_keys_drop_out_of_inner_joins(job, made):
    got = job.run(JOIN.format("in.holes", "inner"))["out.named"]
    want = [(kind, made.customers[key][0]) for kind, key in made.views if not made.hole(key)]
    assert rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("text", [JOIN.format("in.holes", "left"), RIGHT.format("in.holes")])
def test_null_keys_stay_in_outer_joins(job, made, text):
    want = [(kind, None if made.hole(key) else made.customers[key][0]) for kind, key in made.views]
    assert rows(job.run(text)["out.named"]) == sorted(want, key=repr)


def test_join_chain(job, made):
    got = job.run("""
      insert into out.named
      select v.kind, n.name as land, c.segment, c.place as place
      from in.views v
      join in.lost.$table c on c.id = v.customer
      join in.nation.$table n on c.nation = n.id""")["out.named"]
    want = []
    for kind, key in made.views:
        segment, nation = made.customers[key]
        if not made.hole(key):
            want.append((kind, made.nations[nation], segment, nation))
    assert rows(got.select("kind", "land", "segment", "place.land.code")) == sorted(want, key=repr)


def test_count_per_kind(job, made):
    got = job.run("insert into counts (run, kind, n) select 'first', kind, count(*) from in.views group by kind")
    kinds = [kind for kind, _ in made.views]
    assert {r["kind"]: r["n"] for r in got["counts"].collect()} == {kind: kinds.count(kind) for kind in kinds}


def test_flatten_rows_add_up(spark):
    df = spark.createDataFrame([(i, list("abcdefgh"[:i])) for i in range(9)], "id int, letters array<string>")
    flat = df.select("id", S.flatten_rows("letters").alias("x"))
    assert flat.count() == 36 and flat.filter("id = 0").count() == 0


def test_nested_fields_of_a_customer(made):
    whole = made.customer_rows().select(F.struct("*").alias("r"))
    kind = whole.schema["r"].dataType
    get = lambda path: S.nested_field("r", kind, path)
    got = whole.select(
        get("id").alias("id"), get("place.land.name").alias("land"), get("place.lines.any[1]").alias("line"),
        get("accounts.main.number").alias("account"),
    )
    want = [(key, made.nations[nation], f"{key}-b", key) for key, (_, nation) in made.customers.items()]
    assert rows(got) == sorted(want, key=repr)


def test_null_message_reads_as_a_row_of_nulls(spark, made):
    schema = T.StructType().add("id", T.LongType()).add("name", T.StringType()).add("more", T.DoubleType())
    data = [(None if made.hole(key) else (key, name),) for key, name in made.nations.items()]
    df = spark.createDataFrame(data, "m struct<id: bigint, name: string>")
    want = [(None, None, None) if made.hole(key) else (key, name, None) for key, name in made.nations.items()]
    assert rows(project_to_schema(df.select("m.*"), schema)) == sorted(want, key=repr)


def test_case_with_null_and_boolean_filters(spark):
    df = spark.createDataFrame([(i, f"row {i}", {0: None, 1: True, 2: False}[i % 3]) for i in range(9)], "id int, name string, flag boolean")
    got = SqlJob(spark).source("t.simple", df).run(
        "insert into o select id, case when flag is true then 'set' when flag is null then name end as label from t.simple where flag is not false"
    )["o"]
    assert rows(got) == sorted([(i, f"row {i}") for i in (0, 3, 6)] + [(i, "set") for i in (1, 4, 7)], key=repr)
