"""Source divergence audit: how far the sources of a language use its terms differently.

Terms are runs of ASCII letters (A-Z lower-cased) and bytes from 0x80. They are counted inside the tasks by length-bucketed
packing: a term of up to 8 bytes becomes one uint64, one of up to 16 bytes two of them, zero-filled at the end (no term has
a zero byte). Both buckets are sorted by radix, 16 bits at a time from the last digit, stable, so the documents of a term
stay in order; then runs of equal (term, group) are counted with numpy, and the documents in them. Longer terms have a
bucket for each length, sorted as bytes. What a step of texts yields is one row per (group, term), which Spark combines
before it shuffles; a source with a third of all rows sends its distinct terms, not its occurrences.

The kept terms of a language stand in at least ``least`` of its documents. The divergence of two sources is summed over all
kept terms, also those that one or both do not have. Counts are dealt in blocks of terms (about ``TERMS``) and tiles of
sources (about ``TILE`` by ``TILE``), so no task holds a language or a source; a block adds up one number per pair of sources
of its tile. Terms that neither source of a tile holds all have the same value, which is multiplied, not visited.

Defined cases: a null text, language or source reads as ''. A group without terms has count 0 for every kept term. A language
without kept terms has value 0 in every pair and no ``term`` rows. A language with one source has no pairs. Repeated rows
count as often as they stand. Very long texts are cut between terms and counted piece by piece, as one document. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.llm.common import keep, steps
from tideloom.operators.joins import broadcast_if_small

LEAST = 10
RANKS = 10
TERMS = 1024
TILE = 256
#: A longer text is cut into pieces of about this many bytes.
PIECE = 2 << 20

# Bytes of terms; A-Z as a-z, everything else of ASCII separates.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)

#: What is left of a big-endian word of eight bytes whose first n belong to the term.
_MASK = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order of rows by ``words`` (most significant first): one pass for each 16 bits that differ, last bits first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(new_term: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, rows, documents) of the runs of one term and group."""
    new_group, new_doc = new_term.copy(), new_term.copy()
    new_group[1:] |= group[1:] != group[:-1]
    new_doc[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new_group)
    return at, np.diff(at, append=len(group)), np.add.reduceat((new_doc | new_group).astype(np.int64), at)


def _joined(letters: np.ndarray) -> pa.Array:
    """Rows of zero-filled letters as binary values."""
    used = letters > 0
    ends = np.cumsum(used.sum(axis=1))
    offsets = np.zeros(len(letters) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(letters), [None, pa.py_buffer(offsets), pa.py_buffer(letters[used].tobytes())])


def count_terms(texts: list[bytes], groups: list[int]):
    """(terms, group, occurrences, documents) blocks of the texts, whose groups must not decrease."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = LETTERS[np.frombuffer(b" ".join(texts) + b" " * 17, np.uint8)]
    edge = np.diff((data > 0).view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    group = np.asarray(groups, np.int64)[doc]
    # the eight bytes from every place on, read as one big-endian number
    window = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    for low, high in ((1, 8), (9, 16)):
        pick = np.flatnonzero((lengths >= low) & (lengths <= high))
        if not len(pick):
            continue
        at, size = starts[pick], lengths[pick]
        words = [window[at].astype(np.uint64) & _MASK[np.minimum(size, 8)]]
        if high > 8:
            words.append(window[at + 8].astype(np.uint64) & _MASK[size - 8])
        order = radix_order(words)
        words = [w[order] for w in words]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
        yield _block(pick[order], new, group, doc, lambda r: np.stack([w[r] for w in words], 1).astype(">u8").view(np.uint8))  # noqa: B023
    for size in np.unique(lengths[lengths > 16]):
        pick = np.flatnonzero(lengths == size)
        rows = data[starts[pick][:, None] + np.arange(size)]
        whole = rows.view(f"S{size}").ravel()
        order = np.argsort(whole, kind="stable")
        whole, rows = whole[order], rows[order]
        new = np.ones(len(order), bool)
        new[1:] = whole[1:] != whole[:-1]
        yield _block(pick[order], new, group, doc, lambda r: rows[r])  # noqa: B023


def _block(rows, new_term, group, doc, letters):
    at, n, docs = _runs(new_term, group[rows], doc[rows])
    return _joined(letters(at)), group[rows[at]], n, docs


def _pieces(text: bytes):
    """The text cut at bytes that belong to no term, about every :data:`PIECE` bytes."""
    start = 0
    while len(text) - start > PIECE:
        cut = start + PIECE
        while cut < len(text) and LETTERS[text[cut]]:
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _count(batches):
    """(lang, source, text) -> one row per (lang, source, term) of each step."""
    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        for start, end in steps([len(t.as_buffer()) if t.is_valid else 0 for t in texts], PIECE):
            part = [batch.column(i).slice(start, end - start).to_pylist() for i in range(2)]
            names = sorted(set(zip(*part)))
            code = {name: i for i, name in enumerate(names)}
            numbered = sorted((code[name], i) for i, name in enumerate(zip(*part)))
            groups = [g for g, _ in numbered]
            some = [texts[start + i].as_py().encode() for _, i in numbered]
            if len(some) == 1 and len(some[0]) > PIECE:
                blocks = [_whole(some[0])]
            else:
                blocks = count_terms(some, groups)
            for terms, group, n, docs in blocks:
                taken = [pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in range(2)]
                arrays = [*taken, terms.cast(pa.string()), pa.array(n), pa.array(docs)]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])


def _whole(text: bytes):
    """The terms of one document, counted piece by piece."""
    total = Counter()
    for piece in _pieces(text):
        for terms, _, n, _ in count_terms([piece], [0]):
            for term, k in zip(terms.to_pylist(), n.tolist()):
                total[term] += k
    n = np.fromiter(total.values(), np.int64, len(total))
    return pa.array(list(total), pa.binary()), np.zeros(len(n), np.int64), n, np.ones(len(n), np.int64)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p, exact at any size: the product goes through a decimal."""
    wide = lambda c, kind: c.cast(kind)
    over = wide(F.lit(1_000_000_000), "decimal(10,0)") * wide(count + 2, "decimal(20,0)")
    under = wide(total, "decimal(20,0)") + wide(2 * terms, "decimal(18,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", over, under)


def _distance(p, q):
    return (p - q) * (p - q) // (p + q)


PAIRED = "lang string, source string, item string, total bigint, seen bigint, p bigint, q bigint"


def _tile(rows: pa.Table) -> pa.Table:
    """One tile of one block: sums over the terms that any of its sources holds, for each pair of sources.

    Rows with a null term say which sources there are, and their share of a term that they do not hold.
    """
    rows = rows.combine_chunks()
    term = rows.column("term").combine_chunks()
    marks = np.asarray(term.is_null())
    source = rows.column("source").combine_chunks().dictionary_encode()
    names, code = source.dictionary, source.indices.to_numpy()
    share, tile = rows.column("p").to_numpy(), rows.column("tile").to_numpy()
    base, side = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    base[code[marks]], side[code[marks]] = share[marks], tile[marks]
    held = term.filter(pa.array(~marks)).dictionary_encode()
    table = np.repeat(base[:, None], len(held.dictionary), axis=1)
    table[code[~marks], held.indices.to_numpy()] = share[~marks]
    x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
    left, right = np.flatnonzero(side == x), np.flatnonzero(side == y)
    # the same order of two sources in every block
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.to_pylist().__getitem__)] = np.arange(len(names))
    out = []
    for s in left.tolist():
        others = right[place[right] > place[s]] if x == y else right
        if len(others):
            out.append((np.full(len(others), s), others, _distance(table[s], table[others]).sum(axis=1)))
    a, b, total = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 3
    lang = pa.array([rows.column("lang")[0].as_py()] * len(a), pa.string())
    seen = np.full(len(a), table.shape[1])
    arrays = [lang, names.take(pa.array(a)), names.take(pa.array(b)), *map(pa.array, (total, seen, base[a], base[b]))]
    return pa.Table.from_arrays(arrays, names=["lang", "source", "item", "total", "seen", "p", "q"])


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", *, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from the other sources, and the terms that stand out."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = rows.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = keep(counts, "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = keep(kept.select("lang", "term", "all"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("whole"))
    held = keep(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "held-terms")

    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = keep(rows.select("lang", "source").distinct(), "groups")
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    groups = groups.join(tiles, "lang").join(totals, ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select(
        "lang", "source", "tiles",
        F.pmod(F.hash("source"), F.col("tiles")).alias("tile"),
        F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
        F.coalesce("v", F.lit(0)).cast("bigint").alias("v"),
        F.coalesce("whole", F.lit(0)).cast("bigint").alias("whole"),
    )
    groups = keep(groups, "groups")
    shared = held.join(broadcast_if_small(groups), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    shared = keep(shared.select("lang", "source", "term", "n", "all", "p", "v", "whole", "tile", "tiles"), "shares")
    terms = _terms(shared, ranks)
    return _pairs(groups, shared).unionByName(terms)


def _pairs(groups: DataFrame, shared: DataFrame) -> DataFrame:
    blocks = F.greatest(F.ceil(F.col("v") / TERMS).cast("int"), F.lit(1))
    columns = ("lang", "source", "term", "p", "tile", "tiles", "block")
    given = shared.withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int")).select(*columns)
    nothing = F.when(F.col("v") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))).otherwise(F.lit(1).cast("bigint"))
    marks = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), nothing.alias("p"), "tile", "tiles",
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )
    spread = given.unionByName(marks).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select(
        "lang", "source", "term", "p", "tile", "block", F.least("tile", "with").alias("x"), F.greatest("tile", "with").alias("y")
    )
    summed = spread.groupBy("lang", "block", "x", "y").applyInArrow(_tile, PAIRED)
    summed = summed.groupBy("lang", "source", "item").agg(
        F.sum("total").alias("total"), F.sum("seen").alias("seen"), F.first("p").alias("p"), F.first("q").alias("q")
    )
    # what every term has that neither of both holds
    apart = F.col("p") - F.col("q")
    rest = F.call_function("div", apart * apart, F.col("p") + F.col("q"))
    v = groups.select("lang", "v").distinct()
    value = (F.col("total") + (F.col("v") - F.col("seen")) * rest).alias("value")
    half = summed.join(v, "lang").select("lang", "source", "item", value)
    half = keep(half, "pairs")
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", _rank().alias("rank"))


def _terms(shared: DataFrame, ranks: int) -> DataFrame:
    q = _share(F.col("all"), F.col("whole"), F.col("v"))
    apart = F.col("p") - F.col("q")
    above = shared.select("lang", "source", "term", "p", q.alias("q")).filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.call_function("div", apart * apart, F.col("p") + F.col("q")).alias("value")
    )
    # the filter on the rank makes Spark keep the first rows of each task before it shuffles
    best = above.withColumn("rank", _rank()).filter(F.col("rank") <= ranks)
    return best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
