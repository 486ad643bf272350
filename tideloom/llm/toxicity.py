"""Toxic spans by a linear-chain conditional random field; its marginals add up to a score for each document.

Tokens are runs of ASCII letters (lower-cased) and bytes from 0x80, in sequences that end at a line, a sentence or
``LONGEST`` tokens. The field has two tags, plain and toxic. A token's features are its letters, its first and last letters,
its neighbours and a bias, hashed to ``CELLS`` weights; tags of neighbouring tokens have weights too.

Labels come with documents, not with tokens, so tokens are labelled first. In the texts marked toxic, every word and word
beginning that stands in a share of them (``SUPPORT``) is a candidate; candidates that the texts marked clean rarely have
(a precision of at least ``PRECISION``, and a likelihood ratio far beyond chance) are cues. Equal texts count once. Tokens of
toxic texts with a cue are tagged toxic, all tokens of clean texts plain, also those with a cue; sequences of toxic texts
without a cue are left out. The field is trained on a bounded sample of these sequences (``SEQUENCES`` of each kind, those
with the least hash) by its exact gradient, the difference of observed and expected features from forward-backward.

A document's score comes from the marginals of all its tokens: the expected number of toxic tokens, the largest marginal and
the chance that no token is toxic, in a logistic function fitted on the labelled texts. Offending spans are runs of tokens
of a sequence with a marginal of at least one half, as code points of the text.

The model is learned from the texts of at most ``ROWS`` labelled ids and is a table of weights of fixed size; every row is
scored. Labels, languages, sources and ids are no inputs of a score.

Defined cases: a null or empty text, and one without letters, has no tokens and gets the score of a text without any toxic
token. An id with two different labels, and equal texts with different labels, teach nothing. Null ids or labels teach
nothing, rows of a null id are held out (its remainder is null, so they are never learned from). Repeated rows get equal
scores. Without toxic or without clean labels every score is the share of toxic ones with one row of each kind added.
Longer texts than ``PIECE`` bytes are worked piece by piece, cut between tokens. Other columns are returned as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import arrow_function, keep, steps
from tideloom.llm.divergence import LETTERS
from tideloom.llm.shingles import mix

BITS = 18
CELLS = 1 << BITS
LONGEST = 64
PIECE = 1 << 20
SUPPORT, PRECISION, CHANCE = 0.01, 0.8, 15.0
#: Labelled ids that are learned from, and training sequences of each kind.
ROWS, SEQUENCES = 20_000, 5_000
ROUNDS, RATE, DECAY = 80, 0.1, 0.02

PREFIXES, SUFFIXES = (4, 5, 6, 7, 8), (3, 4, 5, 6)
#: Features of a token that can be cues: its letters and its beginnings.
CUES = 1 + len(PREFIXES)

_FULL = [(1 << 64) - (1 << (64 - 8 * n)) if n else 0 for n in range(9)]
_MASK = np.array(_FULL, np.uint64)
#: An odd factor and a summand for each feature.
_FACTOR = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)
_ADDED = mix(np.arange(101, 133, dtype=np.uint64))
_BREAKS = np.zeros(256, np.int64)
_BREAKS[[ord(c) for c in "\n.!?"]] = 1
_PAD = 32


@dataclass
class Tokens:
    text: np.ndarray  # number of the text
    start: np.ndarray  # bytes in the text
    end: np.ndarray
    sequence: np.ndarray
    marks: np.ndarray  # (tokens, features) 64 bits each; 0 where a token has no such feature

    @property
    def cells(self) -> np.ndarray:
        return np.where(self.marks == 0, 0, 1 + (self.marks >> np.uint64(64 - BITS)).astype(np.int64) % (CELLS - 1))


def tokens(texts: list[bytes]) -> Tokens:
    raw = np.frombuffer(b" " * _PAD + b" ".join(texts) + b" " * _PAD, np.uint8)
    data = LETTERS[raw]
    edge = np.diff((data > 0).view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    text = np.searchsorted(first[1:] + _PAD, starts, side="right")
    sentence = np.cumsum(_BREAKS[raw])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1])
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    new |= place % LONGEST == 0

    window = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    eight = lambda at, left: window[at].astype(np.uint64) & _MASK[np.clip(left, 0, 8)]
    head = eight(starts, size)
    letters = head * _FACTOR[20]
    for k in (8, 16):
        letters = letters ^ mix(eight(starts + k, size - k) + _ADDED[20 + k // 8]) * (size > k)
    tail = window[np.maximum(ends - 8, 0)].astype(np.uint64)
    letters = letters ^ mix(np.where(size > 24, tail, np.uint64(0)) + size.astype(np.uint64))
    marks = [letters * _FACTOR[0] + _ADDED[0]]
    for k in PREFIXES:
        marks.append(np.where(size > k, (head & _MASK[k]) * _FACTOR[k] + _ADDED[k], np.uint64(0)))
    for k in SUFFIXES:
        low = tail & np.uint64((1 << (8 * k)) - 1)
        marks.append(np.where(size > k, low * _FACTOR[8 + k] + _ADDED[8 + k], np.uint64(0)))
    word, last = marks[0], np.append(new[1:], True)[: len(new)]
    before, after = np.roll(word, 1), np.roll(word, -1)
    marks.append(np.where(new, _ADDED[18], before * _FACTOR[18]))
    marks.append(np.where(last, _ADDED[19], after * _FACTOR[19]))
    marks.append(np.full(len(starts), _ADDED[30]))
    offset = first[text] + _PAD
    return Tokens(text, starts - offset, ends - offset, np.cumsum(new) - 1, np.stack(marks, 1))


@dataclass
class Field:
    """Weights of the tag ``toxic`` by feature (``plain`` has 0), and of (plain, toxic) x (plain, toxic) neighbours."""

    cells: np.ndarray
    steps: np.ndarray
    cues: np.ndarray
    logistic: np.ndarray

    def marginals(self, found: Tokens):
        return forward_backward(self.cells[found.cells].sum(axis=1), found.sequence, self.steps)


def forward_backward(emission: np.ndarray, sequence: np.ndarray, steps_: np.ndarray):
    """(chance of toxic for each token, chance of (tag, tag) for each token and its left one, log chance that a sequence
    is all plain, log of each sequence's normaliser). Sequences are numbered from 0 in order.
    """
    n = len(emission)
    starts = np.flatnonzero(np.diff(sequence, prepend=-1)) if n else np.zeros(0, np.int64)
    length = np.diff(starts, append=n)
    order = np.argsort(-length, kind="stable")
    at, size = starts[order], length[order]
    toxic = np.exp(np.clip(emission, -30, 30))
    move = np.exp(np.clip(steps_, -30, 30))
    longest = int(size[0]) if len(size) else 0
    going = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]  # sequences longer than t
    ahead, back = np.ones((2, n)), np.ones((2, n))
    scale = np.ones(n)
    for t in range(longest):
        here = at[: going[t]] + t
        if t:
            p, q = ahead[:, here - 1]
            a, b = p * move[0, 0] + q * move[1, 0], (p * move[0, 1] + q * move[1, 1]) * toxic[here]
        else:
            a, b = np.ones(len(here)), toxic[here]
        scale[here] = a + b
        ahead[0, here], ahead[1, here] = a / scale[here], b / scale[here]
    for t in range(longest - 2, -1, -1):
        here = at[: going[t + 1]] + t
        right = here + 1
        p, q = back[0, right] / scale[right], back[1, right] * toxic[right] / scale[right]
        back[0, here], back[1, here] = move[0, 0] * p + move[0, 1] * q, move[1, 0] * p + move[1, 1] * q
    chance = ahead[1] * back[1]
    inner = np.setdiff1d(np.arange(n), starts, assume_unique=True)
    pairs = np.zeros((2, 2, n))
    for i in range(2):
        for j in range(2):
            factor = toxic[inner] if j else 1.0
            pairs[i, j, inner] = ahead[i, inner - 1] * move[i, j] * factor * back[j, inner] / scale[inner]
    total = np.add.reduceat(np.log(scale), starts) if n else np.zeros(0)
    return chance, pairs, (length - 1) * steps_[0, 0] - total, total


def train(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of neighbours from (tags, cells) of sequences: Adam on the exact gradient."""
    tags = np.concatenate([t for t, _ in sequences]).astype(np.float64)
    cells = np.concatenate([c for _, c in sequences])
    sequence = np.repeat(np.arange(len(sequences)), [len(t) for t, _ in sequences])
    used, at = np.unique(cells, return_inverse=True)
    at = at.reshape(cells.shape)
    inner = np.flatnonzero(sequence[1:] == sequence[:-1]) + 1
    seen = np.array([[((tags[inner - 1] == i) & (tags[inner] == j)).sum() for j in (0, 1)] for i in (0, 1)], np.float64)
    weights = np.zeros(len(used) + 4)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, ROUNDS + 1):
        emission = weights[:-4][at].sum(axis=1)
        chance, pairs, _, _ = forward_backward(emission, sequence, weights[-4:].reshape(2, 2))
        error = np.broadcast_to((tags - chance)[:, None], at.shape)
        slope = np.append(np.bincount(at.ravel(), error.ravel(), len(used)), (seen - pairs.sum(axis=2)).ravel()) - DECAY * weights
        slope[:-4][used == 0] = 0.0
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights += RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    whole = np.zeros(CELLS)
    whole[used] = weights[:-4]
    return whole, weights[-4:].reshape(2, 2)


def pieces(text: bytes):
    """(first byte, bytes) of the parts of a text, cut at bytes that belong to no token; at lines where there are some."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(b"\n", start + PIECE // 2, start + PIECE) + 1
        if not cut:
            cut = start + PIECE
            while cut < len(text) and LETTERS[text[cut]]:
                cut += 1
        yield start, text[start:cut]
        start = cut
    yield start, text[start:]


def _blocks(texts: pa.Array):
    """(numbers of the texts, first bytes, tokens, bytes) of pieces of about :data:`PIECE` bytes together."""
    parts = [(i, at, part) for i, t in enumerate(texts.to_pylist()) if t for at, part in pieces(t.encode())]
    for low, high in steps([len(p[2]) for p in parts], PIECE):
        some = [p[2] for p in parts[low:high]]
        yield np.array([p[0] for p in parts[low:high]]), np.array([p[1] for p in parts[low:high]]), tokens(some), some


def _toxic_marks(batches):
    """texts marked toxic -> (mark, in how many), one row per mark and step."""
    for batch in batches:
        for numbers, _, found, _ in _blocks(batch.column(0)):
            marks = found.marks[:, :CUES].ravel()
            text = np.repeat(numbers[found.text], CUES)
            once = np.unique(np.rec.fromarrays([marks[marks > 0], text[marks > 0]]))
            mark, n = np.unique(once.f0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(n)], names=["mark", "n"])


def _known(marks: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each mark in the sorted ``known``, -1 where it is not there."""
    if not len(known):
        return np.full(marks.shape, -1)
    at = np.minimum(np.searchsorted(known, marks), len(known) - 1)
    return np.where(known[at] == marks, at, -1)


def _clean_counter(known: np.ndarray):
    def run(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for numbers, _, found, _ in _blocks(batch.column(0)):
                at = _known(found.marks[:, :CUES], known)
                here = np.unique((numbers[found.text][:, None] * len(known) + at)[at >= 0])
                total += np.bincount(here % max(len(known), 1), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], names=["mark", "n"])

    return run


def likelihood_ratio(a: float, b: float, toxic: float, clean: float) -> float:
    """G squared of a mark in ``a`` of the toxic and ``b`` of the clean texts."""
    n, both, total = toxic + clean, a + b, 0.0
    for seen, side, hits in ((a, toxic, both), (b, clean, both), (toxic - a, toxic, n - both), (clean - b, clean, n - both)):
        if seen > 0:
            total += 2 * seen * math.log(seen * n / (side * hits))
    return total


def _sampler(cues: np.ndarray):
    """(toxic, text) -> (kind, hash, tags, cells) of the sequences with the least hashes of this task, by kind."""

    def run(batches):
        held: dict[int, list] = {0: [], 1: [], 2: []}
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for numbers, _, found, _ in _blocks(batch.column(1)):
                if not len(found.text):
                    continue
                cells = found.cells
                has = (_known(found.marks[:, :CUES], cues) >= 0).any(axis=1)
                starts = np.flatnonzero(np.diff(found.sequence, prepend=-1))
                ends = np.append(starts[1:], len(found.text))
                any_cue = np.maximum.reduceat(has, starts)
                label = toxic[numbers[found.text[starts]]]
                # toxic with a cue, clean with one, clean without
                kind = np.where(label == 1, np.where(any_cue, 0, -1), np.where(any_cue, 1, 2))
                weight = np.arange(1, len(found.text) + 1, dtype=np.uint64)
                weight = mix(weight - np.repeat(weight[starts], ends - starts)) | np.uint64(1)
                key = mix(np.add.reduceat(found.marks[:, 0] * weight, starts))
                for k, rows in held.items():
                    pick = np.flatnonzero(kind == k)
                    pick = pick[np.argsort(key[pick], kind="stable")[:SEQUENCES]]
                    for i in pick.tolist():
                        x, y = starts[i], ends[i]
                        tags = has[x:y] if k == 0 else np.zeros(y - x, bool)
                        rows.append((int(key[i] >> np.uint64(1)), tags.tobytes(), cells[x:y].astype(np.int32).tobytes()))
                    if len(rows) > 2 * SEQUENCES:
                        rows.sort()
                        del rows[SEQUENCES:]
        for k, rows in held.items():
            rows.sort()
            for low in range(0, min(len(rows), SEQUENCES), 500):
                h, t, c = zip(*rows[low : min(low + 500, SEQUENCES)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(h), pa.int32()), pa.array(h, pa.int64()), pa.array(t, pa.binary()), pa.array(c, pa.binary())],
                    names=["kind", "key", "tags", "cells"],
                )

    return run


MEASURES = "struct<expected:double,most:double,clear:double,spans:array<struct<start:bigint,end:bigint,chance:double>>>"


def measure(field: Field, text: str) -> Column:
    """What the marginals of a text add up to, and its toxic spans."""

    def run(texts: pa.Array) -> pa.Array:
        n = len(texts)
        expected, most, clear = np.zeros(n), np.zeros(n), np.zeros(n)
        spans: list[list] = [[] for _ in range(n)]
        behind = np.zeros(n, np.int64)  # code points in the pieces before
        for numbers, _, found, parts in _blocks(texts):
            if len(found.text):
                chance, _, plain, _ = field.marginals(found)
                text = numbers[found.text]
                np.add.at(expected, text, chance)
                np.maximum.at(most, text, chance)
                starts = np.flatnonzero(np.diff(found.sequence, prepend=-1))
                np.add.at(clear, text[starts], plain)
                hit = np.flatnonzero(chance >= 0.5)
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (found.sequence[hit[1:]] != found.sequence[hit[:-1]])
                runs = np.flatnonzero(new)
                for x, y in zip(hit[runs].tolist(), hit[np.append(runs[1:], len(hit)) - 1].tolist() if len(hit) else []):
                    i, part = text[x], parts[found.text[x]]
                    start = behind[i] + _points(part[: found.start[x]])
                    inside = _points(part[found.start[x] : found.end[y]])
                    spans[i].append({"start": int(start), "end": int(start + inside), "chance": float(chance[x : y + 1].max())})
            for i, part in zip(numbers.tolist(), parts):
                behind[i] += _points(part)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
        return pa.StructArray.from_arrays(
            [pa.array(expected), pa.array(most), pa.array(clear), pa.array(spans, kind)], names=["expected", "most", "clear", "spans"]
        )

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_function(MEASURES)(run)(F.coalesce(F.col(text), F.lit("")))


def _points(part: bytes) -> int:
    return len(part.decode())


def _inputs(expected, most, clear) -> list:
    """Inputs of the logistic function, for numpy and for columns alike."""
    log1p = F.log1p if isinstance(expected, Column) else np.log1p
    least = (lambda x: F.least(x, F.lit(20.0))) if isinstance(expected, Column) else (lambda x: np.minimum(x, 20.0))
    return [log1p(expected), most, log1p(least(-clear))]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method; no input may lower the score."""
    x = np.column_stack([x, np.ones(len(x))])
    free = np.ones(x.shape[1], bool)
    while True:
        w, z = np.zeros(x.shape[1]), x[:, free]
        ridge = penalty * np.diag([1.0] * (z.shape[1] - 1) + [1e-9])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w[free], -30, 30)))
            slope = z.T @ (y - p) - ridge @ w[free]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(z.shape[1]), slope)
            w[free] += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        wrong = (w < 0) & (np.arange(len(w)) < len(w) - 1)
        if not wrong.any():
            return w
        free &= ~wrong


def held_out(id: Column) -> Column:
    """Whether a row is kept out of learning: the remainder of its id's checksum is 0 (or there is no id)."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int = ROWS) -> DataFrame:
    """(toxic, text, key): the texts to learn from, those of at most ``rows`` labelled ids (with the least hashes), each once."""
    given = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(id))).groupBy(F.col(id).alias("id"))
    given = given.agg(F.min(label).alias("toxic"), F.max(label).alias("most")).filter("toxic = most").select("id", "toxic")
    given = given.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.filter(F.col(text) != "").select(F.col(id).alias("id"), F.col(text).alias("text"))
    # the broadcast side has at most ``rows`` ids
    found = keep(texts.join(F.broadcast(given), "id").select("toxic", "text", F.xxhash64("text").alias("key")), "labelled")
    once = found.groupBy("key").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"), F.min("text").alias("text"))
    return once.filter("toxic = most").select("toxic", "text", "key")


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Field:
    rows = keep(labelled(docs, labels, id, text, label), "training")
    n_toxic, n_clean = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    none = np.zeros(0, np.uint64)
    nothing = Field(np.zeros(CELLS), np.zeros((2, 2)), none, np.array([0, 0, 0, math.log((n_toxic + 1) / (n_clean + 1))]))
    if not n_toxic or not n_clean:
        return nothing
    toxic, clean = (rows.filter(F.col("toxic") == k).select("text") for k in (1, 0))
    least = max(3, math.ceil(SUPPORT * n_toxic))
    often = toxic.mapInArrow(_toxic_marks, "mark bigint, n bigint").groupBy("mark").agg(F.sum("n").alias("n"))
    # marks in a hundredth of the texts: as many as a hundred texts have
    support = {r["mark"]: r["n"] for r in often.filter(F.col("n") >= least).collect()}
    known = np.sort(np.array(list(support), np.int64).view(np.uint64))
    counted = clean.mapInArrow(_clean_counter(known), "mark bigint, n bigint").groupBy("mark").agg(F.sum("n").alias("n"))
    misses = {r["mark"]: r["n"] for r in counted.collect()}
    cues = [
        mark for mark, a in support.items()
        if a >= PRECISION * (a + misses.get(mark, 0)) and likelihood_ratio(a, misses.get(mark, 0), n_toxic, n_clean) >= CHANCE
    ]
    cues = np.sort(np.array(cues, np.int64).view(np.uint64))
    sampled = rows.select("toxic", "text").mapInArrow(_sampler(cues), "kind int, key bigint, tags binary, cells binary")
    sampled = keep(sampled, "sequences")
    width = len(tokens([b"a"]).marks[0])
    some = [r for k in range(3) for r in sampled.filter(F.col("kind") == k).orderBy("key", "tags", "cells").limit(SEQUENCES).collect()]
    if not len(cues) or not some:
        return nothing
    field = Field(*train([(np.frombuffer(r["tags"], bool), np.frombuffer(r["cells"], np.int32).reshape(-1, width)) for r in some]), cues, nothing.logistic)
    part = rows.select("toxic", measure(field, "text").alias("m"))
    seen = part.select("toxic", "m.expected", "m.most", "m.clear").toPandas()
    x = np.column_stack(_inputs(*[seen[c].to_numpy(float) for c in ("expected", "most", "clear")]))
    field.logistic = fit_logistic(x, seen["toxic"].to_numpy(float))
    return field


def score(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """(row, toxicity): the document's columns, and (score, predicted, expected, most, spans)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), measure(field, text).alias("m"))
    inputs = _inputs(F.col("m.expected"), F.col("m.most"), F.col("m.clear"))
    total = F.lit(float(field.logistic[-1]))
    for weight, x in zip(field.logistic[:-1], inputs):
        total = total + F.lit(float(weight)) * x
    chance = 1 / (1 + F.exp(-total))
    fields = ("expected", "most", "spans")
    return rows.select(
        "row", F.struct(chance.alias("score"), (chance >= 0.5).cast("int").alias("predicted"), *[F.col(f"m.{f}") for f in fields]).alias("toxicity")
    )
