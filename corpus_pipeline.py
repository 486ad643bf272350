"""A corpus pipeline over ``documents``: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Every stage takes (spark, docs, folder), works on all rows that the stage before kept, and returns the columns of the
documents; the last adds how often the mix holds each document. Between two stages the rows are written as Parquet and
read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm import decontaminate, line_dedup, mixing, near_dups, quality
from tideloom.llm.common import keep, key_columns, table
from tideloom.llm.queries import WEIGHTS
from tideloom.session import prepare

#: No stage but the fixed word rules can be written in SQL.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """(ka, kb, row): the row's key and all its columns."""
    return docs.select(*key_columns(F.col("doc_id"), F.col("text")), F.struct(*docs.columns).alias("row"))


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects."""
    rules = quality.learn(quality.training_rows(docs, table(spark, folder, "labels")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return quality.judge(rows, rules).filter("quality.kept").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeated chunks of lines go; a document that has nothing else left goes too. n_chars follows the text."""
    cut = line_dedup.dedup_lines(docs)
    cut = cut.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    given = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    changed = F.col("n_removed") > 0
    columns = [
        F.when(changed, given[c]).otherwise(F.col("row.n_chars") if c == "n_chars" else given[c]).alias(c) if c in given else F.col(f"row.{c}")
        for c in docs.columns
    ]
    return cut.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    first = near_dups.near_duplicates(docs).filter("first").select("ka", "kb").distinct()
    rows = _keyed(docs).join(first, ["ka", "kb"])
    # rows that repeat id and text are one document
    return rows.dropDuplicates(["ka", "kb"]).select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, folder, "benchmark"))
    dirty = keep(found.filter("n_hit > 0").select("ka", "kb").distinct(), "contaminated")
    return _keyed(docs).join(dirty, ["ka", "kb"], "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix: documents with ``repeats`` above 0, and size, source_size, target and taken words.

    A column of the documents that has one of these names is replaced.
    """
    once, added = ("size", "source_size", "target"), ("repeats", "taken")
    plan = mixing.mix(docs, WEIGHTS).groupBy("ka", "kb").agg(
        *[F.first(c).alias(c) for c in once], *[F.sum(c).alias(c) for c in added]
    )
    rows = _keyed(docs).join(plan.filter("repeats > 0"), ["ka", "kb"]).dropDuplicates(["ka", "kb"])
    return rows.select(*[f"row.{c}" for c in docs.columns if c not in once + added], *once, *added)


def _ready(stage):
    """The stage in a session with the settings that the operators rely on."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        return stage(prepare(spark), docs, folder)

    return run_stage


STAGES = [
    ("quality rules", _ready(quality_rules)),
    ("line dedup", _ready(dedup_lines)),
    ("near duplicates", _ready(near_duplicates)),
    ("benchmark decontamination", _ready(decontaminated)),
    ("mixing", _ready(mixed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
