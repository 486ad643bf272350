"""Quality rules: a decision list learned from labelled documents, applied as an ordered Spark conditional.

Per-document statistics come from an Arrow function (one pass, no shuffle). ``learn`` grows and prunes threshold
conjunctions by sequential covering on a bounded sample of labelled rows; ``verdict`` turns them into
``when(...).when(...)``, so that scoring all documents stays inside Spark's expressions.

Defined cases: a null or empty text has no words and fails the base rules (0 < 50 words). Repeated rows get equal
results. Without usable labels the list is empty and only the base rules decide. A label of null is ignored, and so
is a document with labels that contradict each other. Other columns of the input are left alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import arrow_function

#: Labelled rows that are fetched for training, at most.
TRAINING_ROWS = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_upper", "n_punct", "n_distinct")
STATS = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"

# Fixed values.
SYMBOLS = "#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCTUATION = b"!?.,;:"


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in :data:`COUNTS` of one whole text."""
    data = (text or "").encode()
    words = data.split()  # of bytes: exactly ASCII white space
    joined = b"".join(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined) - _continuations(joined),
        sum(joined.count(c) for c in SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        _repeated_words(words),
        len(lines),
        len(joined) - len(joined.translate(None, UPPER)),
        len(joined) - len(joined.translate(None, PUNCTUATION)),
        len(set(words)),
    )


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(data: bytes) -> int:
    return 0 if data.isascii() else len(data) - len(data.translate(None, _CONTINUATION))


def _repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that is found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


@arrow_function(STATS)
def text_stats(texts: pa.Array) -> pa.Array:
    rows = [text_counts(text.as_py()) for text in texts]
    columns = zip(*rows) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _ratio(top: str, bottom: str):
    return lambda c: F.when(c(bottom) > 0, c(top).cast("double") / c(bottom)).otherwise(F.lit(0.0))


#: What rules may test, as expressions over the counts.
FEATURES = {
    "words": lambda c: c("n_words").cast("double"),
    "word_length": _ratio("word_chars", "n_words"),
    "symbols_per_word": _ratio("n_symbols", "n_words"),
    "dup_lines_per_line": _ratio("n_dup_lines", "n_lines"),
    "repeats_per_word": _ratio("n_repeat_words", "n_words"),
    "upper_per_char": _ratio("n_upper", "word_chars"),
    "punctuation_per_word": _ratio("n_punct", "n_words"),
    "distinct_per_word": _ratio("n_distinct", "n_words"),
}


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); what meets it is rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self, counts) -> Column:
        out = F.lit(True)
        for feature, sign, threshold in self.tests:
            value = FEATURES[feature](counts)
            out = out & ((value <= threshold) if sign == "<=" else (value > threshold))
        return out


def verdict(rules: list[Rule], counts) -> Column:
    """Number (from 1) of the first rule that rejects the document, null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        out = out.when(rule.column(counts), F.lit(number))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """Features and label ``bad`` of at most ``limit`` labelled documents, chosen by a hash of their id.

    ``docs`` (doc_id, text), ``labels`` (doc_id, quality). At most ``limit`` ids are broadcast.
    """
    one = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .select(F.col("doc_id").alias("label_id"), (F.col("low") == 0).alias("bad"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(limit)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(one), F.col("doc_id") == F.col("label_id"))
    found = found.select("doc_id", "bad", F.xxhash64("text").alias("text_hash"), text_stats("text").alias("s"))
    counts = lambda name: F.col(f"s.{name}")
    failed = base_failed(counts("n_words"), counts("n_repeat_words"))
    # rows that fail the base rules are left out by learn(): a filter here would move below the join, to all documents
    row = F.struct("text_hash", "bad", failed.alias("failed"), *[make(counts).alias(name) for name, make in FEATURES.items()])
    # of several texts of one id the one with the least hash, so that reruns learn the same rules
    one_text = found.groupBy("doc_id").agg(F.min(row).alias("row")).limit(limit)
    return one_text.select("doc_id", "row.bad", "row.failed", *[f"row.{name}" for name in FEATURES])


def learn(rows: DataFrame, *, max_rules: int = 12, max_tests: int = 4, precision: float = 0.95) -> list[Rule]:
    """Sequential covering over the (bounded) rows of :func:`training_rows`.

    Two thirds of the rows grow a rule by information gain, one third prunes it; a rule that is not at least
    ``precision`` right on either part ends the list.
    """
    names = list(FEATURES)
    table = rows.toPandas().sort_values("doc_id")
    table = table[~table["failed"].astype(bool)]
    if table.empty:
        return []
    values = table[names].to_numpy(float)
    bad = table["bad"].to_numpy(bool)
    growing = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & growing, left & ~growing
        tests = _grow(values, bad, grow, max_tests)
        tests = _prune(values, bad, prune, tests)
        if not tests:
            break
        met = _meets(values, tests)
        right = min(_precision(bad[met & grow]), _precision(bad[met & prune]))
        if right < precision or (met & left & bad).sum() < 3:
            break
        tests = _centred(values, bad, left, tests)
        rules.append(Rule(tuple((names[f], sign, float(t)) for f, sign, t in tests)))
        left &= ~_meets(values, tests)
    return rules


def _precision(bad: np.ndarray) -> float:
    return (bad.sum() + 1e-9) / (len(bad) + 1e-9)


def _meets(values: np.ndarray, tests) -> np.ndarray:
    met = np.ones(len(values), bool)
    for f, sign, t in tests:
        met &= (values[:, f] <= t) if sign == "<=" else (values[:, f] > t)
    return met


def _grow(values, bad, rows, max_tests):
    tests: list[tuple[int, str, float]] = []
    inside = rows.copy()
    while len(tests) < max_tests and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        now = np.log2(p0 / (p0 + n0))
        best = (1e-6, None)
        for f in range(values.shape[1]):
            column = values[inside, f]
            cuts = np.unique(np.quantile(column, np.linspace(0.01, 0.99, 99)))
            for t in cuts:
                low = column <= t
                for sign, chosen in (("<=", low), (">", ~low)):
                    p = bad[inside][chosen].sum()
                    if not p:
                        continue
                    n = chosen.sum() - p
                    gain = p * (np.log2(p / (p + n)) - now)
                    if gain > best[0]:
                        best = (gain, (f, sign, t))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _meets(values, tests[-1:])
    return tests


def _prune(values, bad, rows, tests):
    """The beginning of ``tests`` with the best (p - n) / (p + n) on rows not used for growing."""

    def worth(some):
        met = bad[rows & _meets(values, some)]
        return (2 * met.sum() - len(met)) / len(met) if len(met) else -1.0

    options = [tests[:n] for n in range(len(tests), 0, -1)]
    return max(options, key=lambda some: (worth(some), -len(some))) if options else []


def _centred(values, bad, rows, tests):
    """Each threshold in the middle between the bad rows it catches (but for their outermost 2 %) and the next value it
    leaves alone: what lies between was never seen and is not rejected for being a little different from good rows."""
    caught = rows & bad & _meets(values, tests)
    out = []
    for f, sign, t in tests:
        inner, low = values[caught, f], values[:, f] <= t
        edge = np.quantile(inner, 0.02 if sign == ">" else 0.98)
        beyond = values[rows & (low if sign == ">" else ~low), f]
        if len(beyond):
            near = beyond.max() if sign == ">" else beyond.min()
            if (edge - near) * (1 if sign == ">" else -1) > 0:
                t = (edge + near) / 2
        out.append((f, sign, t))
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: the counts, base_failed, rule (null: none rejects) and kept."""
    counts = lambda name: F.col(f"{out}.{name}")
    counted = docs.withColumn(out, text_stats(F.col(text)))
    failed = base_failed(counts("n_words"), counts("n_repeat_words"))
    rule = verdict(rules, counts)
    return counted.withColumn(
        out,
        F.struct(
            *[counts(name).alias(name) for name in COUNTS],
            failed.alias("base_failed"),
            rule.alias("rule"),
            (~failed & rule.isNull()).alias("kept"),
        ),
    )
