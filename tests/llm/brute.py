"""Plain Python versions of the operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeated(texts: list[str | None], length: int):
    """Per text (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def repeated_lines(texts: list[str], least: int = 2, content: int = 0) -> list[set[int]]:
    """Per text the lines in any run of ``least`` lines and ``content`` letters or digits that stood before, here or earlier."""
    seen, out = set(), []
    for text in texts:
        lines, gone = text.split("\n"), set()
        for start in range(len(lines)):
            for end in range(start + least, len(lines) + 1):
                run = tuple(lines[start:end])
                if run in seen and sum(c.isalnum() for line in run for c in line) >= content:
                    gone |= set(range(start, end))
                seen.add(run)
        out.append(gone)
    return out


def contamination(texts, items: list[tuple], width: int = 10):
    """Per text (n_words, n_hit, n_items, sha256 of the item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        words = TERM.findall(lower(text))
        for s in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[s : s + width])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        words = TERM.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(words) - n + 1):
                if tuple(words[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(words[s : s + n])]
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def shingles(text, width: int = 5) -> Counter:
    words = TERM.findall(lower(text))
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard(a: Counter, b: Counter) -> float:
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def classes(texts, similarity: float = 0.8) -> list[frozenset]:
    """Connected components of equal texts and of pairs at the similarity."""
    n, bags = len(texts), [shingles(t) for t in texts]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            if texts[i] == texts[j] or jaccard(bags[i], bags[j]) >= similarity:
                root[find(i)] = find(j)
    groups = defaultdict(set)
    for i in range(n):
        groups[find(i)].add(i)
    return sorted(map(frozenset, groups.values()), key=min)


def quality_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        sum(1 for i, x in enumerate(lines) if x in lines[:i]),
        len(covered),
    )


def best_tokens(word: bytes, pieces: dict[bytes, int]) -> int:
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = [
            (best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces
        ]
        best.append(max(options))
    return -best[-1][1]


def terms(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def aligned(rows, tokens) -> list[tuple]:
    """The alignment of (id, text) rows, comparing every token of one side with every one of the other."""
    links, docs = Counter(), []
    for doc_id, text in rows:
        ranges, ids = [], []
        for side, encode, content in ((0, lambda t: tokens.a.encode(" " + t, add_special_tokens=False).ids, tokens.bytes_a), (1, tokens.b.encode, tokens.bytes_b)):
            found = encode(text) if text else []
            at = [0]
            for i in found:
                at.append(at[-1] + len(content[i]))
            ids.append(found)
            ranges.append((list(zip(at, at[1:])), b"".join(content[i] for i in found)))
        if not text or any(joined != b" " + text.encode() for _, joined in ranges):
            docs.append((doc_id, 0, 0, 0, [], ""))
            continue
        (a, _), (b, _) = ranges
        pairs = [(i, j) for (s, e), i in zip(a, ids[0]) for (x, y), j in zip(b, ids[1]) if s < y and x < e]
        ends, groups, start = sorted({e for _, e in a} & {e for _, e in b}), [], 0
        for end in ends:
            both = [",".join(str(i) for (s, e), i in zip(r, found) if start <= s and e <= end) for r, found in ((a, ids[0]), (b, ids[1]))]
            groups.append("|".join(both))
            start = end
        links.update(pairs)
        docs.append((doc_id, len(a), len(b), len(ends), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return [
        (i, n_a, n_b, n, len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), sha) for i, n_a, n_b, n, p, sha in docs
    ]
