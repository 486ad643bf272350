"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined as log probabilities:

* text: byte trigrams, hashed into ``TABLE`` cells, under one multinomial model per language. The counts are grouped
  over all labelled documents; the model's size is fixed by the number of languages.
* the language that the markup declares, and the last label of the address: their likelihoods given the language are
  smoothed grouped counts over all rows.
* the host: a prior from the languages seen on it, smoothed towards its parent (host, site, domain, everything), again
  grouped counts. A host with a third of all rows is counted before the shuffle.

Counts use the text's own verdict where it is clear, and whole numbers throughout, so reruns agree.

Defined cases: a null or empty text, address or declaration is no evidence. A row without any gets the overall prior.
Ties go to the language that sorts first. Repeated rows get equal results. Without labelled text there is no model and
every language is null. Other columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import keep, steps

#: Cells of the trigram table (128 KB for each language, on the driver and in the tasks), and languages collected at a time.
TABLE, BLOCK = 1 << 15, 64
#: Weight of one trigram: neighbours overlap and a page repeats itself, so they are worth less than free evidence.
TEMPER = 0.05
#: Strength of the parent in host priors, and of the uniform part in likelihoods.
KAPPA, ALPHA = 8.0, 1.0
#: Log-likelihood per row (in nats, tempered) by which the best language must lead to be counted.
CLEAR = 3.0
_UNIT = 1000.0


def _cells(data: np.ndarray) -> np.ndarray:
    """Cell of each byte trigram; ASCII capitals count as small letters."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)


def _train(batches):
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        for lang in sorted(set(langs)):
            counts = np.zeros(TABLE, np.int64)
            mine = texts.filter(pa.array([x == lang for x in langs]))
            for start, end in steps([len(t.as_buffer()) for t in mine]):
                data = np.frombuffer(b"  ".join(t.as_py() for t in mine.slice(start, end - start)) + b"  ", np.uint8)
                counts += np.bincount(_cells(data), minlength=TABLE)
            used = np.flatnonzero(counts)
            arrays = [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "cell", "n"])


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, table of log probabilities in thousandths), from all rows with a language and a text."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    counts = rows.mapInArrow(_train, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = keep(counts, "trigrams")
    table, place = np.zeros((len(known), TABLE)), {x: i for i, x in enumerate(known)}
    for low in range(0, len(known), BLOCK):
        found = counts.filter(F.col("lang").isin(known[low : low + BLOCK])).toPandas()  # at most BLOCK * TABLE rows
        table[[place[x] for x in found["lang"]], found["cell"]] = found["n"]
    table += 0.5
    table = np.log(table / table.sum(axis=1, keepdims=True)) if known else table
    return known, np.round(table * _UNIT).astype(np.int32)


def _score(batches, table):
    table = table.value
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        out = np.zeros((batch.num_rows, len(table)), np.int64)
        for start, end in steps([len(t.as_buffer()) if t.is_valid else 0 for t in texts]):
            some = [t.as_py() or b"" for t in texts.slice(start, end - start)]
            sizes = np.fromiter((len(t) + 2 for t in some), np.int64, len(some))
            data = np.frombuffer(b"  ".join(some) + b"    ", np.uint8)
            cells = _cells(data)
            heads = np.cumsum(sizes) - sizes
            for k, row in enumerate(table):
                sums = np.add.reduceat(row[cells].astype(np.int64), heads)
                out[start:end, k] = np.where(sizes > 4, sums, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(table)), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "text_scores"])


def page_evidence(pages: DataFrame) -> DataFrame:
    """(url, declared, text) columns from raw pages: visible text, the declared language, and the address."""
    declared = F.regexp_extract("html", r"""(?i)<html[^>]*?\slang\s*=\s*["']?([a-zA-Z]{2,3})""", 1)
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    return pages.withColumns({"declared": F.nullif(F.lower(declared), F.lit("")), "text": visible})


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _part(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keys: list[str]) -> DataFrame:
    """(keys, host, declared, suffix, lang, probability) for rows with columns host, declared, suffix and text."""
    languages, table = model
    found = rows.select(*keys, "host", "declared", "suffix", "text")
    if not languages:
        nothing = F.lit(None)
        return found.drop("text").withColumns({"lang": nothing.cast("string"), "probability": nothing.cast("double")})
    types = ", ".join(f"`{c}` {t}" for c, t in found.drop("text").dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(table)
    scored = keep(found.mapInArrow(partial(_score, table=shared), f"{types}, text_scores array<bigint>"), "scored")
    best, second = F.array_max("text_scores"), F.element_at(F.sort_array("text_scores", asc=False), 2 if len(languages) > 1 else 1)
    own = F.when((best - second) * TEMPER / _UNIT >= CLEAR, F.array_position("text_scores", best).cast("int"))
    counted = scored.withColumns({
        "own": own, "site": _part(F.col("host"), 3), "domain": _part(F.col("host"), 2),
    })
    clear = counted.filter("own is not null")
    overall = _prior(clear.select(F.lit("").alias("host"), "own"), len(languages), None)
    root = [c / sum(r) for r in [overall] for c in r]
    out = counted
    parent = F.array(*[F.lit(c) for c in root])
    out = out.withColumn("prior", parent)
    for level in ("domain", "site", "host"):
        out = _smoothed(out, clear, level, len(languages))
    out = _likelihood(out, clear, "declared", len(languages))
    out = _likelihood(out, clear, "suffix", len(languages))
    sums = F.transform(
        F.sequence(F.lit(1), F.lit(len(languages))),
        lambda k: F.log(F.element_at("prior", k))
        + F.element_at("text_scores", k) * F.lit(TEMPER / _UNIT)
        + F.element_at("declared_given", k)
        + F.element_at("suffix_given", k),
    )
    out = out.withColumn("sums", sums).withColumn("top", F.array_max("sums"))
    total = F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages])
    place = F.array_position("sums", F.col("top")).cast("int")
    return out.select(
        *keys, "host", "declared", "suffix", F.element_at(names, place).alias("lang"), F.round(1 / total, 6).alias("probability")
    )


def _counts(languages: int) -> list[Column]:
    return [F.count_if(F.col("own") == k).alias(f"c{k}") for k in range(1, languages + 1)]


def _prior(clear: DataFrame, languages: int, _) -> list[float]:
    row = clear.agg(*_counts(languages)).first()
    return [float(c) + ALPHA for c in row]


def _smoothed(rows: DataFrame, clear: DataFrame, level: str, languages: int) -> DataFrame:
    """The prior of the parent level, updated by the counts of this level."""
    counts = clear.filter(F.col(level).isNotNull()).groupBy(level).agg(*_counts(languages))
    counts = counts.select(F.col(level).alias("part"), F.array(*[f"c{k}" for k in range(1, languages + 1)]).alias("counts"))
    joined = rows.join(counts, F.col(level) == F.col("part"), "left")
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    updated = F.zip_with("counts", "prior", lambda c, p: (c + KAPPA * p) / (total + KAPPA))
    return joined.withColumn("prior", F.coalesce(updated, F.col("prior"))).drop("part", "counts")


def _likelihood(rows: DataFrame, clear: DataFrame, name: str, languages: int) -> DataFrame:
    """log P(value of ``name`` | language), 0 for null; smoothed towards the value's overall share."""
    totals = clear.filter(F.col(name).isNotNull()).agg(*_counts(languages)).first()
    counts = clear.filter(F.col(name).isNotNull()).groupBy(name).agg(*_counts(languages))
    each = [f"c{k}" for k in range(1, languages + 1)]
    share = sum((F.col(c) for c in each), F.lit(0)) / F.lit(float(sum(totals) or 1))
    logs = F.array(*[F.log((F.col(c) + ALPHA * share) / F.lit(float(t) + ALPHA)) for c, t in zip(each, totals)])
    counts = counts.select(F.col(name).alias("value"), logs.alias(f"{name}_given"))
    zeros = F.array(*[F.lit(0.0)] * languages)
    joined = rows.join(counts, F.col(name) == F.col("value"), "left").drop("value")
    return joined.withColumn(f"{name}_given", F.coalesce(f"{name}_given", zeros))
