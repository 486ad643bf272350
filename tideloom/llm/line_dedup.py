"""Line dedup with content-defined chunks of lines.

A rolling hash over the hashes of the lines chooses boundaries: a chunk may start before a line if the hash of it and the next
one says so, and end after a line if the hash of it and the one before says so (:data:`SKIPPED` is the share of lines where
neither is chosen). From every start a chunk runs on, and from every end it runs back, until it has two lines and
:data:`LEAST` letters and digits. So a chunk is decided by its own lines alone, wherever its passage stands, every chunk is
worth removing, and the chunks from the starts and to the ends of a passage overlap until they cover it: blank lines and
brackets go with a passage that holds them, never by themselves.

Chunks are counted over the whole corpus by 128-bit hashes, polynomials of the line hashes; of each that repeats, the first
occurrence (least id, then place) stays. The others go after their bytes were compared with the first one's. As chunks
overlap, a line of a first occurrence may itself go as part of a still earlier one; an equal chunk before it always stays.

Hashes of chunks are shuffled, texts once, and as text only those repeated chunks that a document needs to cover its repeated
lines. A chunk held by a third of all documents is combined before the shuffle (counts, first place) and joined with skew
splitting.

Defined cases: a null text stays null, an empty one has one empty line. A null id sorts first. Rows that repeat id and
text are one document in two rows and get equal results. Lines end at "\n"; what is left is joined by "\n" again, and a
document whose lines all go keeps an empty text. A line that repeats alone, between other neighbours, stays; so does a
document of one line, and a passage with fewer letters and digits. Occurrences in one document may overlap. Other columns,
whatever their names, are returned as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import arrow_function, keep, key_columns, returning_memory, steps
from tideloom.llm.shingles import mix

#: Letters and digits (and characters beyond ASCII) that a chunk has at least.
LEAST = 40
#: One in so many lines starts no chunk, and one ends none.
SKIPPED = 16

_P = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_INVERSE = np.array([pow(int(p), -1, 1 << 64) for p in _P], np.uint64)

# Bytes that begin a letter, a digit or a character beyond ASCII.
_CONTENT = np.zeros(256, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x100)):
    _CONTENT[_low:_high] = 1


def line_chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first line, lines, hashes) of the chunks of all texts."""
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = b"\n".join(texts) + b"\n"
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for line in data[:-1].split(b"\n")), "<u8").reshape(-1, 2)
    raw = np.frombuffer(data, np.uint8)
    begins = np.concatenate([[0], np.flatnonzero(raw[:-1] == 10) + 1])
    content = np.concatenate([[0], np.cumsum(np.add.reduceat(_CONTENT[raw], begins, dtype=np.int64))])
    last = np.repeat(np.cumsum(counts), counts)  # the line after the text's last
    first = last - np.repeat(counts, counts)
    n, at = len(digests), np.arange(len(digests))
    pair = np.zeros(n, np.uint64)  # of each line and the next
    pair[:-1] = mix(digests[:-1, 0] * _P[0] + digests[1:, 0])
    chosen = pair % np.uint64(SKIPPED) != 0
    # on from a start, and back from an end
    end = np.maximum(np.searchsorted(content, content[:-1] + LEAST), at + 2)
    forward = np.flatnonzero(chosen & (end <= last))
    start = np.minimum(np.searchsorted(content, content[1:] - LEAST, side="right") - 1, at - 1)
    back = np.flatnonzero(np.r_[False, chosen[:-1]] & (start >= first))
    spans = np.unique(np.concatenate([np.stack([forward, end[forward]], 1), np.stack([start[back], back + 1], 1)]), axis=0)
    x, y = spans[:, 0], spans[:, 1]
    power = np.ones((n + 1, 2), np.uint64)
    power[1:] = np.multiply.accumulate(np.broadcast_to(_P, (n, 2)), axis=0)
    inverse = np.ones((n + 1, 2), np.uint64)
    inverse[1:] = np.multiply.accumulate(np.broadcast_to(_INVERSE, (n, 2)), axis=0)
    total = np.zeros((n + 1, 2), np.uint64)
    total[1:] = np.cumsum(mix(digests.astype(np.uint64)) * power[:n], axis=0)
    hashes = mix((total[y] - total[x]) * inverse[x] + (y - x).astype(np.uint64)[:, None])
    owner = np.repeat(np.arange(len(counts)), counts)[x]
    return owner, x - first[x], y - x, hashes


def chunks(text: str) -> list[tuple[int, int, str]]:
    """(first line, lines, text) of all chunks."""
    lines = text.split("\n")
    _, start, size, _ = line_chunks([text.encode()])
    return [(i, n, "\n".join(lines[i : i + n])) for i, n in zip(start.tolist(), size.tolist())]


@returning_memory
def _chunk_rows(batches):
    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        for low, high in steps([len(t.as_buffer()) for t in texts]):
            owner, start, size, hashes = line_chunks([t.as_py() for t in texts.slice(low, high - low)])
            hashes, at = hashes.view(np.int64), pa.array(owner + low)
            arrays = [batch.column(c).take(at) for c in range(3)]
            arrays += [pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "ka", "kb", "start", "lines", "ha", "hb"])


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("lines", pa.int32()), ("ha", pa.int64()), ("hb", pa.int64())]))


@arrow_function("array<struct<start:int,lines:int,ha:bigint,hb:bigint>>")
def _cover(runs: pa.Array) -> pa.Array:
    """As few of the runs of each document as cover the same lines."""
    out = []
    for some in runs.to_pylist():
        chosen, reach, best = [], 0, None
        for run in sorted(some or [], key=lambda r: (r["start"], r["lines"])):
            if best and run["start"] > reach:
                chosen.append(best)
                reach, best = best["start"] + best["lines"], None
            if run["start"] + run["lines"] > (best["start"] + best["lines"] if best else reach):
                if not best and run["start"] >= reach:
                    chosen.append(run)
                    reach = run["start"] + run["lines"]
                else:
                    best = run
        out.append(chosen + ([best] if best else []))
    return pa.array(out, _RUNS)


@arrow_function("array<string>")
def _pieces(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """The text of each wanted chunk."""
    out = []
    for text, some in zip(texts, wanted):
        lines = text.as_py().split("\n")
        out.append(["\n".join(lines[w["start"] : w["start"] + w["lines"]]) for w in some.as_py()])
    return pa.array(out, pa.list_(pa.string()))


@arrow_function("struct<text:string,n_lines:bigint,n_chunks:bigint>")
def _without(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """The text without the chunks (start, bytes) whose bytes are the document's own, lines and chunks removed."""
    kept, gone, number = [], [], []
    for text, some in zip(texts, runs):
        lines = text.as_py().split("\n")
        stays, count = np.ones(len(lines), bool), 0
        for run in some.as_py():
            start, end = run["start"], run["start"] + run["lines"]
            if "\n".join(lines[start:end]) == run["piece"]:
                stays[start:end] = False
                count += 1
        kept.append("\n".join(line for line, stay in zip(lines, stays) if stay))
        gone.append(int((~stays).sum()))
        number.append(count)
    arrays = [pa.array(kept, pa.string()), pa.array(gone, pa.int64()), pa.array(number, pa.int64())]
    return pa.StructArray.from_arrays(arrays, names=["text", "n_lines", "n_chunks"])


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", *, digest: bool = False) -> DataFrame:
    """(row, n_lines, n_removed, n_chunks, kept): ``row`` holds the document's columns, ``kept`` its text without the chunks.

    With ``digest``, ``kept`` is the SHA-256 of that text instead, and texts that stay as they are move only once.
    """
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"),
        F.col(id).alias("id"),
        *key_columns(F.col(id), F.col(text)),
        F.col(text).alias("text"),
    )
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, ka bigint, kb bigint, start int, lines int, ha bigint, hb bigint"
    cut = keep(rows.filter(F.col("text").contains("\n")).select("id", "ka", "kb", "text").mapInArrow(_chunk_rows, schema), "chunks")
    place = F.struct("id", "ka", "kb", "start")
    often = cut.groupBy("ha", "hb").agg(F.count("*").alias("times"), F.min(place).alias("least")).filter("times > 1")
    marked = cut.join(often, ["ha", "hb"]).withColumn("stays", place.eqNullSafe(F.col("least")))
    run = F.struct("start", "lines", "ha", "hb")
    marked = marked.groupBy("ka", "kb").agg(
        F.collect_set(F.when(F.col("stays"), run)).alias("firsts"), F.collect_set(F.when(~F.col("stays"), run)).alias("others")
    )
    marked = keep(marked.select("ka", "kb", "firsts", _cover("others").alias("others")), "marked")
    wanted = marked.select("ka", "kb", "firsts")
    joined = rows.join(wanted, ["ka", "kb"], "left")
    touched = F.col("firsts").isNotNull()
    kept = F.sha2("text", 256) if digest else F.col("text")
    joined = joined.select(
        "row", "ka", "kb", "firsts",
        F.when(touched, F.col("text")).alias("text"),
        F.when(~touched, kept).alias("kept"),
        F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
    )
    joined = keep(joined, "split")
    sources = joined.filter(F.size("firsts") > 0).select("firsts", _pieces("text", "firsts").alias("pieces"))
    originals = sources.select(F.explode(F.arrays_zip("firsts", "pieces")).alias("x")).select("x.firsts.ha", "x.firsts.hb", F.col("x.pieces").alias("piece"))
    originals = originals.dropDuplicates(["ha", "hb"])
    others = marked.select("ka", "kb", F.explode("others").alias("x")).select("ka", "kb", "x.*")
    runs = others.join(originals, ["ha", "hb"]).groupBy("ka", "kb").agg(F.collect_list(F.struct("start", "lines", "piece")).alias("runs"))
    some = joined.filter("firsts is not null").join(runs, ["ka", "kb"], "left")
    none = F.array().cast("array<struct<start:int,lines:int,piece:string>>")
    some = some.withColumn("left", _without("text", F.coalesce("runs", none)))
    left = F.col("left.text")
    some = some.select(
        "row", "n_lines", F.col("left.n_lines").alias("n_removed"), F.col("left.n_chunks").alias("n_chunks"),
        (F.sha2(left, 256) if digest else left).alias("kept"),
    )
    zero = F.lit(0).cast("bigint")
    rest = joined.filter("firsts is null").select("row", "n_lines", zero.alias("n_removed"), zero.alias("n_chunks"), "kept")
    return rest.unionByName(some)
