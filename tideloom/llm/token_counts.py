"""Token counts by a unigram model over a public vocabulary, with a trie shared by all pre-tokens of a task.

The best segmentation of a pre-token is found by forward dynamic programming: the score of a prefix is the best, over
the pieces that end there, of the score of the shorter prefix plus the piece's. That score depends on the prefix alone,
so distinct pre-tokens are inserted in a trie whose nodes keep it: a shared prefix is scored once, and a node at the
end of a pre-token gives its token count. Which pieces end at a node follows from the longest suffix of the prefix that
begins a piece, which a node keeps too. There is no shuffle; each task keeps one trie, emptied at ``MAX_NODES``.

A piece's score is a log probability by Zipf's law from its rank in the vocabulary file, rounded to a millionth, so
that sums are exact; equal scores go to the segmentation with fewer tokens.

Defined cases: null and empty texts have 0 tokens. A pre-token of any length is counted whole: behind ``KEPT`` bytes
its scores go on in a rolling window instead of the trie. Repeated rows get equal counts; other columns are not read.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Pre-tokens as byte-level vocabularies define them (a fixed value).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: About 200 bytes each.
MAX_NODES = 1_000_000
KEPT = 64
#: A millionth of a score in values that hold a number of tokens too; no pre-token has as many.
ONE = 1 << 40


def load_pieces(path: str) -> dict[bytes, int]:
    """Piece -> score in millionths, from a file of (base64 piece, rank) lines. All 256 bytes must be pieces."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path} does not hold every byte")
    total = math.log(sum(1 / (rank + 2.7) for rank in ranks.values()))
    return {piece: round(-1e6 * (math.log(rank + 2.7) + total)) for piece, rank in ranks.items()}


class Endings:
    """Which pieces end at a place: states are the beginnings of pieces, a text is in that of its longest suffix among them.

    States and steps are made when they are first met. ``ends`` holds (length, value) for each piece that ends in a state.
    """

    def __init__(self, pieces: dict[bytes, int]):
        self.values = {piece: score * ONE - 1 for piece, score in pieces.items()}
        self.longest = max(map(len, pieces))
        self.beginnings = {piece[:n] for piece in pieces for n in range(1, len(piece) + 1)}
        self.numbers: dict[bytes, int] = {b"": 0}
        self.names, self.ends = [b""], [()]
        self.steps: dict[int, int] = {}  # by 256 * state + byte

    def step(self, after: int) -> int:
        """The state after 256 * state + byte."""
        state = self.steps.get(after)
        if state is None:
            tail = self.names[after >> 8] + bytes((after & 255,))
            while tail not in self.beginnings:
                tail = tail[1:]
            state = self.numbers.get(tail)
            if state is None:
                state = self.numbers[tail] = len(self.names)
                self.names.append(tail)
                found = ((n, self.values.get(tail[-n:])) for n in range(1, len(tail) + 1))
                self.ends.append(tuple((n, value) for n, value in found if value is not None))
            self.steps[after] = state
        return state


class Trie:
    """Forward scores of all prefixes seen, and the token counts at their ends.

    A score and its number of tokens are one value, ``score * ONE - tokens``: the greatest has the best score, of equal
    scores the fewest tokens.
    """

    def __init__(self, pieces: dict[bytes, int], max_nodes: int = MAX_NODES):
        self.endings = Endings(pieces)
        self.max_nodes = max_nodes
        self.counts: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # by 256 * node + byte
        self.values: list[int] = [0]
        self.states: list[int] = [0]

    def count(self, pre_token: str) -> int:
        """Tokens of the best segmentation; remembered at the end of the pre-token."""
        n = self.counts.get(pre_token)
        if n is None:
            if len(self.values) >= self.max_nodes:
                self.clear()
            if len(self.counts) >= self.max_nodes:
                self.counts.clear()
            n = self._insert(pre_token.encode())
            if len(pre_token) <= KEPT:
                self.counts[pre_token] = n
        return n

    def _insert(self, word: bytes) -> int:
        children, values, states = self.children, self.values, self.states
        step, steps, ends, longest = self.endings.step, self.endings.steps, self.endings.ends, self.endings.longest
        node, path = 0, [0]  # the value of each prefix
        for byte in word[:KEPT]:
            child = children.get(node << 8 | byte)
            if child is None:
                after = states[node] << 8 | byte
                state = steps.get(after)
                if state is None:
                    state = step(after)
                child = children[node << 8 | byte] = len(values)
                values.append(max([path[-length] + value for length, value in ends[state]]))
                states.append(state)
            node = child
            path.append(values[node])
        state = states[node]
        for byte in word[KEPT:]:
            state = step(state << 8 | byte)
            path.append(max([path[-length] + value for length, value in ends[state]]))
            if len(path) > 2 * longest:
                del path[: len(path) - longest]
        return -path[-1] % ONE


def _count_batches(batches, pieces, pattern):
    trie, split = Trie(pieces.value if hasattr(pieces, "value") else pieces), regex.compile(pattern)
    for batch in batches:
        words, tokens = [], []
        for text in batch.column(batch.num_columns - 1):
            found = split.findall(text.as_py() or "")
            words.append(len(found))
            tokens.append(sum(trie.count(word) * n for word, n in Counter(found).items()))
        arrays = [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
        names = [*batch.schema.names[:-1], "n_pre_tokens", "n_tokens"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def count_tokens(docs: DataFrame, pieces: dict[bytes, int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_pre_tokens, n_tokens) for each row of ``docs``. The vocabulary is broadcast: its size is that of its file."""
    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"))
    kind = rows.schema[id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = f"`{id}` {kind}, n_pre_tokens bigint, n_tokens bigint"
    return rows.mapInArrow(partial(_count_batches, pieces=shared, pattern=PRE_TOKENS), schema)
