"""Suffix sorting by induction, with common prefixes. Queues and large arrays may go to disk, results stay in memory.

The text is a row of small whole numbers. Suffixes that start where a rise follows a fall (S*) are sorted first: one
induction sorts the pieces between them, equal pieces get equal names, and the shorter text of names is sorted in turn.
A second induction then carries (position, common prefix) tuples from the S* suffixes to all others: scanning them in
order, each tuple puts its left neighbour into the queue of that neighbour's symbol. As the scan is in order, a queue
for each symbol is all the priority queue there is; queues are appended to and read in blocks, and blocks go to a
scratch file of the task beyond a bound. The common prefix of two neighbours in a queue is one more than the least
common prefix between the tuples that put them there.

Common prefixes are cut off at ``cap``; the order of suffixes that agree that far is left open.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Bytes that queues or one array hold in memory, before they go to a scratch file of the task.
IN_MEMORY = 48 << 20
FAR = np.uint16(65535)


def _scratch_file():
    """Without a name, beside Spark's own spill files: it ends with the task."""
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)


def array(n: int, dtype) -> np.ndarray:
    """Zeros, in memory or in a mapped scratch file."""
    size = max(1, n) * np.dtype(dtype).itemsize
    if size <= IN_MEMORY:
        return np.zeros(n, dtype)
    return np.memmap(_scratch_file(), dtype=dtype, shape=(n,))


class Queues:
    """For each symbol a queue of (position, common prefix) tuples, appended and read in blocks."""

    def __init__(self, symbols: int, memory: int = IN_MEMORY):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.held += positions.nbytes + common.nbytes
        self.blocks[symbol].append((positions, common))
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = _scratch_file()
        self.file.seek(0, os.SEEK_END)
        for blocks in self.blocks:
            for i, block in enumerate(blocks):
                if isinstance(block[0], np.ndarray):
                    at = self.file.tell()
                    block[0].tofile(self.file)
                    block[1].tofile(self.file)
                    blocks[i] = (at, len(block[0]), block[0].dtype, block[1].dtype)
        self.held = 0

    def _load(self, block):
        if isinstance(block[0], np.ndarray):
            return block
        at, n, a, b = block
        self.file.flush()
        self.file.seek(at)
        return np.fromfile(self.file, a, n), np.fromfile(self.file, b, n)

    def after(self, symbol: int, start: int):
        """Blocks of one queue from number ``start`` on, as one pair of arrays."""
        blocks = [self._load(b) for b in self.blocks[symbol][start:]]
        if not blocks:
            return np.zeros(0, np.int64), np.zeros(0, np.uint16)
        return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])

    def size(self, symbol: int) -> int:
        return len(self.blocks[symbol])

    def drop(self, symbol: int) -> None:
        self.blocks[symbol] = []


class _Least:
    """Range minimum over a block of common prefixes."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Least of values[start:end], for ranges that are not empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.levels[0].dtype)
        for k in range(len(self.levels)):
            at = np.flatnonzero(level == k)
            if len(at):
                values = self.levels[k]
                out[at] = np.minimum(values[start[at]], values[end[at] - (1 << k)])
        return out


class Text:
    """Symbols with their types: ``rising`` (S) if the suffix is smaller than the next one, ``run`` of equal symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.symbols, self.n = symbols, n
        self.count = int(symbols.max()) + 1
        starts = np.r_[0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1]
        heads = symbols[starts].astype(np.int64)
        up = np.r_[heads[1:] > heads[:-1], False]
        lengths = np.diff(starts, append=n)
        self.rising = array(n, bool)
        self.rising[:] = np.repeat(up, lengths)
        self.run = array(n, np.uint16)
        self.run[:] = np.minimum(np.repeat(starts + lengths, lengths) - np.arange(n), 65534)
        self.stars = np.flatnonzero(self.rising[1:] & ~self.rising[:-1]) + 1


def induce(text: Text, stars: np.ndarray, common: np.ndarray | None, cap: int, whole: bool = True):
    """Sorted suffixes from sorted S* suffixes.

    Yields for each symbol (positions, common prefix with the one before, 0 for the first). Without ``common``, only
    the order of the pieces between S* positions is right, and only S* positions are given.
    """
    carry = common is not None
    common = common if carry else np.zeros(len(stars), np.uint16)
    falls = Queues(text.count)
    cuts = np.searchsorted(text.symbols[stars], np.arange(text.count + 1))
    step = _Step(text, falls, rising=False, carry=carry, cap=cap)
    step.seed(text.n - 1)
    for symbol in range(text.count):
        step.drain(symbol)
        mine = slice(cuts[symbol], cuts[symbol + 1])
        if cuts[symbol] < cuts[symbol + 1]:
            scan = common[mine].copy()
            last = step.last
            scan[0] = min(int(text.run[last]), int(text.run[stars[cuts[symbol]]]), cap) if last is not None else 0
            step.scan(stars[mine], scan)
    rises = Queues(text.count)
    step = _Step(text, rises, rising=True, carry=carry, cap=cap)
    out: list = [None] * text.count
    for symbol in range(text.count - 1, -1, -1):
        step.drain(symbol)
        low, low_common = falls.after(symbol, 0)
        falls.drop(symbol)
        if len(low):
            scan = np.empty(len(low), np.uint16)
            scan[1:] = low_common[1:][::-1]
            scan[0] = min(int(text.run[step.last]), int(text.run[low[-1]]), cap) if step.last is not None else 0
            step.scan(low[::-1], scan)
        if not whole:
            high = rises.after(symbol, 0)[0][::-1]
            rises.drop(symbol)
            star = high[(high > 0) & ~text.rising[high - 1]] if len(high) else high
            out[symbol] = star
        else:
            high, high_common = rises.after(symbol, 0)
            rises.drop(symbol)
            positions = np.concatenate([low, high[::-1]])
            values = np.zeros(len(positions), np.uint16)
            values[: len(low)] = low_common
            if len(high):
                # high_common[i]: with the one before in falling order
                values[len(low) + 1 :] = high_common[1:][::-1]
                if len(low):
                    values[len(low)] = min(int(text.run[low[-1]]), int(text.run[high[-1]]), cap)
            if len(values):
                values[0] = 0
            out[symbol] = (positions, values)
    return out


class _Step:
    """One direction of the induction: scanned tuples put their left neighbours of one type into queues."""

    def __init__(self, text: Text, queues: Queues, rising: bool, carry: bool, cap: int):
        self.text, self.queues, self.rising, self.carry, self.cap = text, queues, rising, carry, cap
        self.pending = np.full(text.count, FAR, np.uint16)  # least common prefix since the last put
        self.started = np.zeros(text.count, bool)
        self.last = None  # the last tuple of the queue drained

    def seed(self, position: int) -> None:
        symbol = int(self.text.symbols[position])
        self.queues.put(symbol, np.array([position]), np.zeros(1, np.uint16))
        self.started[symbol] = True

    def drain(self, symbol: int) -> None:
        """Scan a queue to its end; it may grow by its own symbol meanwhile."""
        done, first = 0, True
        self.last = None
        while done < self.queues.size(symbol):
            end = self.queues.size(symbol)
            positions, common = self.queues.after(symbol, done)
            done = end
            if first and len(common):
                common = common.copy()
                common[0] = 0
                first = False
            self.last = positions[-1]
            self.scan(positions, common)

    def scan(self, positions: np.ndarray, common: np.ndarray) -> None:
        text = self.text
        at = np.flatnonzero(positions > 0)
        left = positions[at] - 1
        wanted = text.rising[left] == self.rising
        at, left = at[wanted], left[wanted]
        if not len(at):
            if self.carry:
                np.minimum(self.pending, common.min(), out=self.pending)
            return
        symbols = text.symbols[left]
        order = np.argsort(symbols, kind="stable")
        at, left, symbols = at[order], left[order], symbols[order]
        heads = np.r_[0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1]
        ends = np.r_[heads[1:], len(symbols)]
        shared = np.zeros(len(at), np.uint16)
        if self.carry:
            least = _Least(common)
            previous = np.empty(len(at), np.int64)
            previous[1:] = at[:-1] + 1
            previous[heads] = 0
            values = least(previous, at + 1)
            hit = symbols[heads]
            values[heads] = np.where(self.started[hit], np.minimum(values[heads], self.pending[hit]), 0)
            shared = np.minimum(values.astype(np.int32) + 1, self.cap).astype(np.uint16)
            shared[heads] = np.where(self.started[hit], shared[heads], 0)
            np.minimum(self.pending, common.min(), out=self.pending)
            tails = at[ends - 1] + 1
            open_ = tails < len(common)
            self.pending[hit] = FAR
            self.pending[hit[open_]] = least(tails[open_], np.full(open_.sum(), len(common)))
            self.started[hit] = True
        for head, end in zip(heads.tolist(), ends.tolist()):
            self.queues.put(int(symbols[head]), left[head:end], shared[head:end])


def _same_length_equal(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether symbols[a:a+length] equals symbols[b:b+length], for each pair."""
    equal = lengths > 0
    active = np.flatnonzero(equal)
    offset = 0
    while len(active):
        same = symbols[a[active] + offset] == symbols[b[active] + offset]
        equal[active[~same]] = False
        active = active[same]
        offset += 1
        active = active[lengths[active] > offset]
    return equal


def _common(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, done: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b that are known to agree in the first ``done`` symbols."""
    out, n = np.minimum(done, cap), len(symbols)
    active = np.flatnonzero(out < cap)
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        fine = (x < n) & (y < n)
        active, x, y = active[fine], x[fine], y[fine]
        active = active[symbols[x] == symbols[y]]
        out[active] += 1
        active = active[out[active] < cap]
    return out


def _sorted_stars(text: Text, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """S* positions in order, and the common prefix of each with the one before."""
    stars = text.stars
    m = len(stars)
    if m == 0:
        return stars, np.zeros(0, np.uint16)
    by_symbol = stars[np.argsort(text.symbols[stars], kind="stable")]
    pieces = np.concatenate([p for p in induce(text, by_symbol, None, cap, whole=False)])
    number = array(text.n, np.int32)
    number[stars] = np.arange(m, dtype=np.int32)
    order = number[pieces].astype(np.int64)
    # a piece reaches to the next S* position; the last one is like no other
    lengths = np.r_[np.diff(stars) + 1, 0]
    a, b = order[:-1], order[1:]
    equal = _same_length_equal(text.symbols, stars[a], stars[b], np.where(lengths[a] == lengths[b], lengths[a], 0))
    # a name is the first place of its equals in the order
    new = np.r_[True, ~equal]
    ranks = array(m, np.int32)
    ranks[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    levels, width = [ranks], 1
    # names are doubled until all differ, or they agree for more symbols than the cap; only shared ones are sorted again
    while width < cap:
        shared = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(shared):
            break
        who = order[shared]
        after = who + width
        key = ranks[who].astype(np.int64) * (m + 1) + np.where(after < m, ranks[np.minimum(after, m - 1)] + 1, 0)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[shared] = who
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[shared] = fresh
        before, ranks = ranks, array(m, np.int32)
        ranks[:] = before
        ranks[who] = np.maximum.accumulate(np.where(fresh, shared, 0))
        levels.append(ranks)
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    # neighbours that differ in their first name share no longer one
    alike = np.flatnonzero(levels[0][a] == levels[0][b])
    x, y = a[alike], b[alike]
    for k in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero((x < m) & (y < m))
        at = at[levels[k][x[at]] == levels[k][y[at]]]
        x[at] += 1 << k
        y[at] += 1 << k
    a[alike], b[alike] = x, y
    start_a, start_b = order[:-1], order[1:]
    reach = np.r_[stars, text.n]
    done = reach[np.minimum(a, m)] - stars[start_a]
    common = np.zeros(m, np.uint16)
    common[1:] = _common(text.symbols, stars[start_a], stars[start_b], done, cap)
    return stars[order], common


def suffixes(symbols: np.ndarray, cap: int = 65000):
    """For each symbol in order, (positions, common prefix with the suffix before, at most ``cap``)."""
    text = Text(symbols)
    stars, common = _sorted_stars(text, cap)
    return induce(text, stars, common, cap)
