"""Removal of repeated substrings by induced suffix sorting, spread over the cluster in shards.

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else, in the same document or another.

1. Each window of ``length`` bytes has an anchor: the least hash among its 64-byte strings, the leftmost of equals.
   Equal windows have equal anchors at equal places, so windows that repeat share an anchor that repeats. The windows
   of one anchor follow each other and form a context. Counting anchors tells which documents have contexts to compare;
   only their texts go on.
2. Equal contexts are merged with their number (within a task first, then by their own hash, so that an anchor that many
   documents share is merged by many tasks), so a group of thousands of copies is one context. A shard holds whole anchors.
3. Each shard is suffix-sorted by induction (see induced.py); the tuples carry positions and common prefixes.
   Neighbours with a common prefix of ``length`` are one string; it repeats if its contexts stand for two starts or more.
   Shards are cut at ``SHARD`` bytes plus one anchor, so they fit in memory and the scratch files of induced.py stay
   idle; a task gets about ``TASK`` bytes, so a larger input has more tasks and none longer. An anchor with more than ``HOT`` different contexts (a third of all documents may share one) is cut into its
   windows, which are counted by their own 128-bit hash; only those that repeat are sorted, so no shard must hold more.
4. Repeated runs go back to the documents that hold the context, and are cut out there.

Defined cases: a null text counts as empty: 0 bytes, nothing removed. Repeated rows are documents of their own: their
strings start elsewhere too. Bytes are those of UTF-8; what is left may therefore not be valid text when a cut falls
inside a character (``cut_text`` drops the broken character). Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import keep, key_columns, steps
from tideloom.llm.induced import suffixes
from tideloom.llm.shingles import _P, _P_INVERSE, mix

GRAM = 64
#: Bytes of contexts that are sorted at once, unless one anchor has more.
SHARD = 2 << 20
#: Bytes of contexts that a task sorts, one shard after another.
TASK = 2 * SHARD
#: Different contexts of one anchor, beyond which it is cut into windows.
HOT = 4_000


class Anchors:
    """Anchors of all windows of many texts."""

    def __init__(self, length: int):
        self.length, self.span = length, length - GRAM + 1
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            steps_ = np.full(n, _P, np.uint64)
            steps_[0] = 1
            self.powers = np.multiply.accumulate(steps_)
            steps_[1:] = _P_INVERSE
            self.inverses = np.multiply.accumulate(steps_)

    def __call__(self, texts: list[bytes]):
        """(text number, anchor hash, first window, windows) arrays; windows are counted from the start of the text."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        if n < self.length or sizes.max() < self.length:
            return (np.zeros(0, np.int64),) * 4
        self._tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * self.inverses[: n - GRAM + 1])
        # the hash's upper half, then the place: the least is the leftmost of equals
        marked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        at = (self._least(marked) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
        valid = np.flatnonzero(np.arange(len(at)) + self.length <= ends[owner])
        at, owner = at[valid], owner[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        owner = owner[first]
        start = valid[first] - (ends[owner] - sizes[owner])
        return owner, grams[at[first]], start, np.diff(first, append=len(valid))

    def _least(self, values: np.ndarray) -> np.ndarray:
        """Minimum of every ``span`` values in a row, from running minima forward and backward in blocks of ``span``."""
        span, n = self.span, len(values)
        full = -(-n // span) * span
        padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = values
        blocks = padded.reshape(-1, span)
        forward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(backward[: n - span + 1], forward[span - 1 : n])


def _texts(column, start: int, end: int) -> list[bytes]:
    return [t.as_py() or b"" for t in column.slice(start, end - start)]


def _sizes(column) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


OCCURRENCES = "ka bigint, kb bigint, anchor bigint, first int, windows int"


def _occurrences(batches, length: int):
    """(ka, kb, text) -> one row for each anchor of each text."""
    find = Anchors(length)
    for batch in batches:
        ka, kb, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())
        for start, end in steps(_sizes(texts)):
            owner, anchor, first, windows = find(_texts(texts, start, end))
            arrays = [ka[start + owner], kb[start + owner], anchor.view(np.int64), first.astype(np.int32), windows.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["ka", "kb", "anchor", "first", "windows"])


def _hash(data: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(data)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _each_context(batch, length: int):
    """(row, anchor, first, context) of a batch with columns text and wanted."""
    texts, wanted = batch.column("text").cast(pa.binary()), batch.column("wanted")
    for row in range(batch.num_rows):
        text = texts[row].as_py()
        for w in wanted[row].as_py():
            yield row, w["anchor"], w["first"], text[w["first"] : w["first"] + w["windows"] + length - 1]


CONTEXTS = "anchor bigint, ca bigint, cb bigint, context binary, n bigint"


def _contexts(batches, length: int, limit: int = 8 << 20):
    """Different contexts with their numbers; merged as far as a bound on memory allows."""
    seen: dict[tuple, list] = {}
    held = 0
    for batch in batches:
        for _, anchor, _, context in _each_context(batch, length):
            key = (anchor, *_hash(context))
            if key in seen:
                seen[key][1] += 1
            else:
                seen[key] = [context, 1]
                held += len(context)
                if held > limit:
                    yield _context_rows(seen)
                    seen, held = {}, 0
    yield _context_rows(seen)


def _context_rows(seen) -> pa.RecordBatch:
    anchor, ca, cb = zip(*seen) if seen else ((), (), ())
    context, n = zip(*seen.values()) if seen else ((), ())
    arrays = [pa.array(x, pa.int64()) for x in (anchor, ca, cb)] + [pa.array(context, pa.binary()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor", "ca", "cb", "context", "n"])


PLACES = "ka bigint, kb bigint, first int, ca bigint, cb bigint"


def _places(batches, length: int):
    """Where each context stands."""
    for batch in batches:
        ka, kb = batch.column("ka").to_numpy(), batch.column("kb").to_numpy()
        rows = [(ka[row], kb[row], first, *_hash(context)) for row, _, first, context in _each_context(batch, length)]
        columns = zip(*rows) if rows else [()] * 5
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = ["ka", "kb", "first", "ca", "cb"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _windows(batches, length: int):
    """The windows of contexts of hot anchors, each a context of its own: (wa, wb, context, n, ca, cb, at)."""
    for batch in batches:
        rows = []
        for ca, cb, context, n in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "context", "n"))):
            for at in range(len(context) - length + 1):
                window = context[at : at + length]
                rows.append((*_hash(window), n, ca, cb, at))
            if len(rows) > 100_000:
                yield _window_rows(rows)
                rows = []
        yield _window_rows(rows)


def _window_rows(rows) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 6
    types = [pa.int64()] * 5 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["wa", "wb", "n", "ca", "cb", "at"])


RUNS = "ca bigint, cb bigint, low int, high int"


def repeated_starts(contexts: list[bytes], counts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context the runs (first, last) of starts whose string of ``length`` bytes stands elsewhere too.

    Sorts the suffixes of all contexts and follows the common prefixes.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    heads = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    symbols = data.astype(np.uint16) + np.uint16(1)
    symbols[heads + sizes] = 0
    marks = np.zeros(len(symbols), bool)
    owners = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    for positions, common in suffixes(symbols, cap=length):
        # strings of the full length lie side by side with common prefixes of the full length
        cut = np.flatnonzero(common < length)
        if not len(cut):
            continue
        sizes_of = np.diff(cut, append=len(positions))
        owner = owners[positions]
        start = positions - heads[owner]
        whole = start <= sizes[owner] - length
        weight = np.add.reduceat(np.where(whole, counts[owner], 0), cut)
        many = np.repeat(weight >= 2, sizes_of)
        marks[positions[many & whole]] = True
    out = []
    for head, size in zip(heads.tolist(), sizes.tolist()):
        edge = np.diff(np.r_[False, marks[head : head + size], False].astype(np.int8))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())))
    return out


def _sort_shards(batches, length: int):
    """Rows (anchor, ca, cb, context, n), sorted by anchor -> repeated runs; whole anchors together, SHARD bytes at a time."""
    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "ca", "cb", "context", "n"))):
            if row[0] != last and size > SHARD:
                yield _sorted(held, length)
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[3])
    yield _sorted(held, length)


def _sorted(rows: list[tuple], length: int) -> pa.RecordBatch:
    found = repeated_starts([r[3] for r in rows], np.array([r[4] for r in rows], np.int64), length) if rows else []
    flat = [(r[1], r[2], low, high) for r, runs in zip(rows, found) for low, high in runs]
    columns = zip(*flat) if flat else [()] * 4
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["ca", "cb", "low", "high"])


def _distinct(contexts: DataFrame) -> DataFrame:
    """Equal contexts merged. They are dealt by their own hash: a crowded anchor has many of them."""
    found = contexts.repartition("ca", "cb").groupBy("anchor", "ca", "cb").agg(F.first("context").alias("context"), F.sum("n").alias("n"))
    return found.withColumn("size", F.octet_length("context"))


def _runs(contexts: DataFrame, size: int, length: int) -> DataFrame:
    """Repeated runs of contexts with ``size`` bytes in all."""
    dealt = contexts.repartition(max(1, -(-size // TASK)), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(partial(_sort_shards, length=length), RUNS)


def merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def cut_text(data: bytes, spans) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


RESULT = "id {id}, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_sha256 string{text}"


def _cut(batches, keep_text: bool):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        rows = []
        for text, runs in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
            data, spans = text.as_py(), merged((r["start"], r["end"]) for r in runs.as_py() or ())
            left = cut_text(data, spans)
            listed = [{"start": s, "end": e} for s, e in spans]
            rows.append((len(data), len(data) - len(left), listed, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64(), pa.int64(), span, pa.string(), pa.string()]
        names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]
        arrays = [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]]
        yield pa.RecordBatch.from_arrays(arrays[: 6 if keep_text else 5], names=names[: 6 if keep_text else 5])


def repeated_substrings(
    docs: DataFrame, length: int = 400, *, id: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = HOT
) -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, spans, kept_sha256), with ``keep_text`` also ``kept``.

    Documents without any repeated anchor are done after the first join; only the others' texts move again.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    whole = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = docs.select(F.col(id).alias("id"), *key_columns(F.col(id), F.col(text)), whole)
    long = rows.filter(F.octet_length("text") >= length).select("ka", "kb", "text")
    anchors = keep(long.mapInArrow(partial(_occurrences, length=length), OCCURRENCES), "anchors")
    # written first: next to an aggregation in its own stage, a join can't be split where one anchor has very many rows
    often = keep(anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "often")
    # repeated rows share a key: one list for all of them
    wanted = anchors.join(often, "anchor").groupBy("ka", "kb").agg(
        F.collect_set(F.struct("first", "windows", "anchor")).alias("wanted")
    )
    joined = rows.join(wanted, ["ka", "kb"], "left")
    alone = F.col("wanted").isNull()
    joined = keep(
        joined.select(
            "id", "ka", "kb", "wanted",
            F.when(~alone, F.col("text")).alias("text"),
            *([F.col("text").alias("kept")] if keep_text else []),
            F.octet_length("text").cast("bigint").alias("n_bytes"),
            F.when(alone, F.sha2("text", 256)).alias("kept_sha256"),
        ),
        "candidates",
    )
    some = joined.filter("wanted is not null").select("id", "ka", "kb", "text", "wanted")
    contexts = some.select("text", "wanted").mapInArrow(partial(_contexts, length=length), CONTEXTS)
    contexts = keep(_distinct(contexts), "contexts")
    crowded = contexts.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > hot).select("anchor")
    crowded = keep(crowded, "crowded")
    few = contexts.join(crowded, "anchor", "left_anti")
    runs = _runs(few.drop("size"), few.agg(F.sum("size")).first()[0] or 0, length)
    if not crowded.limit(1).isEmpty():
        runs = runs.unionByName(_hot_runs(contexts.join(crowded, "anchor"), length))
    places = some.select("ka", "kb", "text", "wanted").mapInArrow(partial(_places, length=length), PLACES)
    start, end = F.col("first") + F.col("low"), F.col("first") + F.col("high") + length
    found = places.join(runs, ["ca", "cb"]).groupBy("ka", "kb").agg(
        F.collect_set(F.struct(start.alias("start"), end.alias("end"))).alias("runs")
    )
    kind = docs.schema[id].dataType.simpleString()
    schema = RESULT.format(id=kind, text=", kept string" if keep_text else "")
    cut = some.select("id", "ka", "kb", "text").join(found, ["ka", "kb"], "left").select("id", "text", "runs")
    cut = cut.mapInArrow(partial(_cut, keep_text=keep_text), schema)
    rest = joined.filter("wanted is null").select(
        "id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), "kept_sha256", *(["kept"] if keep_text else []),
    )
    return rest.unionByName(cut).withColumnRenamed("id", id)


def _hot_runs(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of anchors with very many contexts: their windows, merged by hash, sorted as contexts."""
    rows = contexts.select("ca", "cb", "context", "n")
    parts = keep(
        rows.mapInArrow(partial(_windows, length=length), "wa bigint, wb bigint, n bigint, ca bigint, cb bigint, at int"), "windows"
    )
    many = parts.groupBy("wa", "wb").agg(F.sum("n").alias("n"), F.min(F.struct("ca", "cb", "at")).alias("from")).filter("n > 1")
    many = keep(many.select("wa", "wb", "n", "from.ca", "from.cb", "from.at"), "many")
    text = rows.select("ca", "cb", "context")
    whole = many.join(text, ["ca", "cb"]).select(
        F.col("wa").alias("anchor"), F.col("wa").alias("ca"), F.col("wb").alias("cb"),
        F.expr(f"substring(context, at + 1, {length})").alias("context"), "n",
    )
    again = _runs(whole, many.count() * length, length).select(F.col("ca").alias("wa"), F.col("cb").alias("wb"))
    return parts.join(again, ["wa", "wb"]).select("ca", "cb", F.col("at").alias("low"), F.col("at").alias("high"))
