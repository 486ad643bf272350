"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes of the same text.

Both tokenizers cut the same bytes (a space and the text), so a token is a byte range. Two ranges overlap if and only if some
stretch between two neighbouring token ends lies in both: the links of a text are the stretches between its ends, without a
search. For the groups every token points to its farthest-right overlapping token: the other side's token that holds its
last byte, or, of two tokens that end together, the one of side B, which points to itself. Successors are then doubled
(``p = p[p]``) over all tokens of a step at once until nothing changes: after k rounds a token sees 2^k steps ahead, so a
group of n tokens takes log n rounds. All tokens of a group arrive at its terminal token, whose number labels the group.

How often an id pair is linked is counted over the whole corpus. Texts are worked in chunks of about ``CHUNK`` bytes; a chunk
gives each of its distinct pairs once, with its number of links, and each text the places of its pairs in that list. Pairs are
summed by Spark, the sums go back to the chunks that asked for them, and each chunk is put together with its texts. So not
every link is shuffled, no count is broadcast, and a pair that all texts share is one row per chunk.

Side A is encoded by the vocabulary's own library where a text has letters beyond Latin or very long words, else by a faster
encoder with the same entries and the same split; both give the same ids.

Defined cases: a null or empty text, and one whose tokens do not give back its bytes on either side, has no tokens: zeros and
''. Repeated rows count as often as they stand. A text of more than ``CUT`` bytes is cut where a space stands between two
small ASCII letters, if no piece of side B has a space after another character: there both sides begin a token whatever
follows, so its tokens are those of the whole text; chunks are bounded then, also by such cuts. A text without such a place is
one chunk. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import keep

CHUNK = 512 << 10
CUT = 256 << 10

# The characters that byte-level vocabularies write for bytes; all other bytes follow from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _PLAIN} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}

# How byte-level vocabularies of this kind split texts before they merge bytes.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_BREAK = re.compile(r"[a-z](?= [a-z])")
#: Letters whose classes no library's tables differ in, and words of a usual length: such texts take the faster encoder.
_UNUSUAL = re.compile(r"[^\x00-\u024f]|[^\s]{2000}")


def load(byte_level: str, pieces: str) -> tuple[bytes, bytes]:
    """The two vocabulary files, read on the driver; tasks get their content."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        return a.read(), b.read()


class Tokenizers:
    """Both tokenizers of a task, and the bytes of every id."""

    def __init__(self, files: tuple[bytes, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is all there is
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(files[0])
        self.a.encode_special_tokens = True
        named = json.loads(files[0])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        special = {t["id"]: t["content"].encode() for t in named["added_tokens"]}
        entries = named["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max([*entries.values(), *special]))
        for entry, i in entries.items():
            self.bytes_a[i] = special.get(i) or bytes(_BYTES[c] for c in entry)
        plain = {x: i for i, x in enumerate(self.bytes_a) if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=plain, special_tokens={})
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        inner = re.compile("[^▁]▁")
        self.cuts = not any(inner.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def parts(self, text: str) -> list[str]:
        """The text in parts whose tokens, one after the other, are the text's; each stands for a space and itself."""
        if len(text) <= CUT or not self.cuts:
            return [text]
        out, start = [], 0
        while len(text) - start > CUT:
            found = _BREAK.search(text, start + CUT)
            if not found:
                break
            out.append(text[start : found.end()])
            start = found.end() + 1
        return [*out, text[start:]]

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(ids of A, ids of B) of every part; None where the tokens do not give back its bytes."""
        out = []
        for part in parts:
            spaced = " " + part
            if _UNUSUAL.search(part):
                a = self.a.encode(spaced, add_special_tokens=False).ids
            else:
                a = self.fast.encode_ordinary(spaced)
            b, whole = self.b.encode(part, num_threads=1), spaced.encode()
            same = b"".join([self.bytes_a[i] for i in a]) == whole and b"".join([self.bytes_b[i] for i in b]) == whole
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else None)
        return out


def doubled(successor: np.ndarray) -> np.ndarray:
    """The terminal node that every node's successors lead to."""
    while True:
        further = successor[successor]
        if (further == successor).all():
            return successor
        successor = further


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label of each A token, label of each B token, A token of each link, B token of each link).

    Ends are strictly increasing and both sides end at the same byte. Labels grow with the place.
    """
    size, n = int(ends_a[-1]), len(ends_a)
    is_a, is_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    is_a[ends_a], is_b[ends_b] = True, True
    # the token that holds each byte
    token_a, token_b = np.cumsum(is_a, dtype=np.int32), np.cumsum(is_b, dtype=np.int32)
    both = is_a[ends_b]
    successor = np.concatenate([token_b[ends_a - 1] + n, np.where(both, np.arange(len(ends_b)) + n, token_a[ends_b - 1])])
    last = doubled(successor)
    before = np.flatnonzero(is_a | is_b) - 1
    return last[:n], last[n:], token_a[before], token_b[before]


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order of their first place, place of each value among them, how often each)."""
    coded = pa.array(values).dictionary_encode()
    places = coded.indices.to_numpy()
    return coded.dictionary.to_numpy(), places, np.bincount(places, minlength=len(coded.dictionary))


class _Chunk(list):
    """Parts of texts (text number, whether it is the last, ids of A, ids of B) that are aligned together."""

    size = 0


# Numbers of a group's tokens are followed by ",", the last of A by "|", the last of B by ";".
_MARKS = (",", "|", ";")


class _Aligner:
    def __init__(self, files: tuple[bytes, bytes]):
        self.tokens = Tokenizers(files)
        top = max(len(self.tokens.bytes_a), len(self.tokens.bytes_b))
        self.words = np.array([f"{i}{mark}" for i in range(top) for mark in _MARKS], object)

    def run(self, chunk: _Chunk):
        """(pairs, how often), and for each part: (counts of A, B, groups, links; groups as text; places in pairs; how often)."""
        n_a, n_b = ([len(part[k]) for part in chunk] for k in (2, 3))
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        a, b = (np.concatenate([part[k] for part in chunk]) for k in (2, 3))
        ends_a, ends_b = np.cumsum(self.tokens.sizes[0][a]), np.cumsum(self.tokens.sizes[1][b])
        label_a, label_b, link_a, link_b = align(ends_a, ends_b)
        terminal = np.flatnonzero(label_b == np.arange(len(a), len(a) + len(b)))
        n_groups = np.diff(np.searchsorted(terminal, stop_b), prepend=0)
        # a group's tokens of A, then its tokens of B
        group_a, group_b = np.searchsorted(terminal + len(a), label_a), np.searchsorted(terminal + len(a), label_b)
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        code = np.empty(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
        code[at_a], code[at_b] = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
        code[at_a[np.cumsum(many_a) - 1]] += 1
        code[at_b[np.cumsum(many_b) - 1]] += 2
        words, stops = self.words[code], stop_a + stop_b
        texts = ["".join(words[x:y]) for x, y in zip([0, *stops[:-1]], stops)]
        # distinct pairs of the chunk, and of each part
        pairs, place, often = _counted((a[link_a].astype(np.int64) << 32) | b[link_b])
        n_links = np.diff(np.searchsorted(link_a, stop_a), prepend=0)
        mine, _, times = _counted(np.repeat(np.arange(len(chunk)), n_links) * len(pairs) + place)
        edges = np.searchsorted(mine // len(pairs), np.arange(len(chunk) + 1))
        parts = [
            (n_a[i], n_b[i], int(n_groups[i]), int(n_links[i]), texts[i], mine[x:y] - i * len(pairs), times[x:y])
            for i, (x, y) in enumerate(zip(edges[:-1], edges[1:]))
        ]
        return pairs, often, parts


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
CODED = (
    "chunk bigint, row bigint, id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, often array<bigint>, places array<int>, times array<int>"
)
_LISTS = {"pairs": pa.int64(), "often": pa.int64(), "places": pa.int32(), "times": pa.int32()}


def _batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    fields = [("chunk", pa.int64()), ("row", pa.int64()), ("id", id_type), *[(n, pa.int64()) for n in NUMBERS]]
    fields += [("groups_sha256", pa.string()), *[(n, pa.list_(t)) for n, t in _LISTS.items()]]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in fields], names=[n for n, _ in fields])


def _coder(files):
    """The task: rows (id, text) -> a row for each part of a text, and one for each chunk (its ``row`` is null)."""

    def flush(aligner, chunk, number, ids, digests):
        pairs, often, parts = aligner.run(chunk)
        out = [{"chunk": number, "pairs": pairs, "often": often}]
        for (row, last, _, _), (*numbers, text, places, times) in zip(chunk, parts):
            digests[row].update((text[:-1] if last else text).encode())
            out.append({
                "chunk": number, "row": row, "id": ids[row], **dict(zip(NUMBERS, numbers)),
                "groups_sha256": digests[row].hexdigest() if last else None, "places": places, "times": times,
            })
            if last:
                del ids[row], digests[row]
        return out

    def run(batches):
        aligner = _Aligner(files.value)
        row = number = TaskContext.get().partitionId() << 32
        chunk, ids, digests, kind = _Chunk(), {}, {}, None
        for batch in batches:
            kind, plain = batch.column(0).type, []
            for start in range(0, batch.num_rows, 64):
                cut = [aligner.tokens.parts(t) if t else [] for t in batch.column(1).slice(start, 64).to_pylist()]
                coded = iter(aligner.tokens.encode([part for parts in cut for part in parts]))
                for name, parts in zip(batch.column(0).slice(start, 64).to_pylist(), cut):
                    tokens, row = [next(coded) for _ in parts], row + 1
                    if not tokens or any(t is None for t in tokens):
                        plain.append({"row": row, "id": name, **dict.fromkeys(NUMBERS, 0), "groups_sha256": ""})
                        continue
                    ids[row], digests[row] = name, hashlib.sha256()
                    for i, (a, b) in enumerate(tokens, 1):
                        chunk.append((row, i == len(tokens), a, b))
                        chunk.size += int(aligner.tokens.sizes[0][a].sum())
                        if chunk.size >= CHUNK:
                            yield _batch(flush(aligner, chunk, number, ids, digests), kind)
                            chunk, number = _Chunk(), number + 1
            if plain:
                yield _batch(plain, kind)
        if chunk:
            yield _batch(flush(aligner, chunk, number, ids, digests), kind)

    return run


def _summed(parts: pa.Table, sums: pa.Table) -> pa.Table:
    """The parts of a chunk with the corpus-wide counts of their pairs."""
    if not parts.num_rows:
        return pa.table({"row": pa.array([], pa.int64()), "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})
    total, best = np.zeros((2, sums.num_rows), np.int64)
    at = sums.column("place").to_numpy()
    total[at], best[at] = sums.column("total").to_numpy(), sums.column("best").to_numpy()
    places, times = (parts.column(c).combine_chunks() for c in ("places", "times"))
    edges = places.offsets.to_numpy()
    place, often = places.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    running = [np.concatenate([[0], np.cumsum(often * x[place])]) for x in (best, total)]
    edges = edges - edges[0]
    n_best, count_sum = (x[edges[1:]] - x[edges[:-1]] for x in running)
    return pa.table({"row": parts.column("row"), "n_best": n_best, "count_sum": count_sum})


def align_documents(docs: DataFrame, files: tuple[bytes, bytes], id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # two vocabulary files, whatever the corpus
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    coded = keep(rows.mapInArrow(_coder(shared), CODED.format(kind)), "aligned")
    listed = coded.filter("row is null").select("chunk", F.posexplode(F.arrays_zip("pairs", "often")).alias("place", "x"))
    listed = listed.select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.often").alias("often"))
    totals = keep(listed.groupBy("pair").agg(F.sum("often").alias("total")), "pair-counts")
    side_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    highest = totals.groupBy(side_b).agg(F.max("total").alias("highest"))
    marked = totals.withColumn("b", side_b).join(highest, "b").select(
        "pair", "total", (F.col("total") == F.col("highest")).cast("bigint").alias("best")
    )
    sums = listed.join(marked, "pair").select(F.col("chunk").alias("asked"), "place", "total", "best")
    parts = coded.filter("chunk is not null and row is not null")
    weighed = parts.select("chunk", "row", "places", "times").groupBy("chunk").cogroup(sums.groupBy("asked")).applyInArrow(
        _summed, "row bigint, n_best bigint, count_sum bigint"
    )
    zero = F.lit(0).cast("bigint")
    counted = coded.filter("row is not null").select("row", "id", *NUMBERS, "groups_sha256", zero.alias("n_best"), zero.alias("count_sum"))
    # a row per part and a row of its counts
    nothing = [F.lit(None).cast(kind).alias("id"), *[zero.alias(n) for n in NUMBERS], F.lit(None).cast("string").alias("groups_sha256")]
    every = counted.unionByName(weighed.select("row", *nothing, "n_best", "count_sum"))
    added = [F.sum(n).alias(n) for n in (*NUMBERS, "n_best", "count_sum")]
    out = every.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), *added, F.max("groups_sha256").alias("groups_sha256"))
    return out.select(F.col("id").alias(id), *NUMBERS, "n_best", "count_sum", "groups_sha256")
