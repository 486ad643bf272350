"""The operators as registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm import (
    alignment,
    decontaminate,
    divergence,
    language,
    licenses,
    line_dedup,
    mixing,
    near_dups,
    oracles,
    quality,
    secrets,
    suffix_dedup,
    token_counts,
    toxicity,
)
from tideloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Weights of the sources in code point order, repeating.
WEIGHTS = [5.0, 2.0, 1.0]


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_token_counts")
def op1(spark, folder):
    pieces = token_counts.load_pieces(f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(table(spark, folder, "documents"), pieces)


@query("op4_mix_sources")
def op4(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), WEIGHTS)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


@query("op8_secret_scan")
def op8(spark, folder):
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    fields = ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")
    return found.select("doc_id", *[F.col(f"secrets.{name}") for name in fields])


@query("op9_quality_rules")
def op9(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.learn(quality.training_rows(docs, table(spark, folder, "labels")))
    judged = quality.judge(docs, rules)
    return judged.select("doc_id", *[F.col(f"quality.{n}") for n in (*quality.BASE, "base_failed", "rule", "kept")])


@query("op6_decontaminate", oracles.DECONTAMINATE)
def op6(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_near_duplicates", oracles.NEAR_DUPLICATES)
def op7(spark, folder):
    found = near_dups.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size")


@query("op2_line_dedup")
def op2(spark, folder):
    cut = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), digest=True)
    return cut.select("row.doc_id", "n_lines", "n_removed", "n_chunks", F.col("kept").alias("kept_sha256"))


@query("op3_language")
def op3(spark, folder):
    """Pages with all kinds of evidence; documents with their text and their source as the host."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    model = language.train(docs)
    none = F.lit(None).cast("string")
    pages = language.page_evidence(table(spark, folder, "pages")).select(
        "page_id", F.lit(None).cast("bigint").alias("doc_id"), language.host_of(F.col("url")).alias("host"), "declared", "text"
    ).withColumn("suffix", F.substring_index("host", ".", -1))
    texts = docs.select(
        F.lit(None).cast("bigint").alias("page_id"), "doc_id", F.col("source").alias("host"), none.alias("declared"), "text", none.alias("suffix")
    )
    return language.identify(pages.unionByName(texts), model, ["page_id", "doc_id"])


@query("op5_license_scan")
def op5(spark, folder):
    found = licenses.find_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    each = lambda f: F.array_join(F.transform("licenses.found", f), ",")
    return found.select(
        "doc_id",
        "licenses.n_blocks",
        each(lambda x: x.license).alias("names"),
        each(lambda x: F.concat_ws(":", x.license, x.start, x.end)).alias("spans"),
        F.size(F.filter("licenses.found", lambda x: x.exact)).cast("bigint").alias("n_exact"),
    )


@query("op10_repeated_substrings")
def op10(spark, folder):
    found = suffix_dedup.repeated_substrings(table(spark, folder, "documents").select("doc_id", "text"), 400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


@query("op11_source_divergence", oracles.SOURCE_DIVERGENCE)
def op11(spark, folder):
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


@query("op12_token_alignment")
def op12(spark, folder):
    files = alignment.load(f"{token_counts.TOKENIZERS}/byte_bpe_50k.json", f"{token_counts.TOKENIZERS}/piece_bpe_32k.model")
    return alignment.align_documents(table(spark, folder, "documents").select("doc_id", "text"), files)


@query("op13_toxicity")
def op13(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, folder, "labels")))
    spans = F.array_join(F.transform("toxicity.spans", lambda x: F.concat_ws(":", x.start, x.end)), ",")
    return scored.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "toxicity.score", "toxicity.predicted", spans.alias("spans")
    )
