"""Near duplicates by BagMinHash: weighted-Jaccard signatures of word shingles, banded, then verified.

A document is the multiset of its runs of five words. Each (shingle, unit of weight) has a Poisson process of points;
the weights are the whole numbers, ordered in octaves (0,1], (1,2], (2,4], (4,8] ..., each octave a process of its own
whose points are thinned to the units that the document's weight covers. A point falls into one of ``SLOTS`` slots, and
the signature holds the earliest point of each slot. Points are drawn in order of time, and a process is left as soon
as it passes the latest slot, so a document costs about one point per shingle plus SLOTS log SLOTS, not their product.
Two documents agree in a slot with a probability equal to their weighted Jaccard similarity.

Texts that are equal form one node before anything is compared. Nodes that agree in a band of ``ROWS`` slots share a
bucket (at 0.8, the chance to share none of the bands is below 3 in 100,000). Within a bucket every node is verified
against two leaders, the nodes with most company over all their buckets: of many copies of one text with changes of
their own, those are the ones nearest to the text. Verified links are merged to classes. Only in a bucket that still
holds several classes are the others compared, in blocks of about ``BLOCK`` nodes that hold their texts: the blocks of
the bucket's largest class meet those of the other nodes, which also meet each other. Pairs of two classes whose whole
signatures agree in ``AGREE`` slots (missed by a pair at 0.8 with a chance below 5 in 100,000, by closer ones less) are
verified in the block, in the first bucket that they share, as long as nothing in the block connects their classes. A
node that shares too little with all members of a class together is similar to none of them and is not compared with
each. No pair leaves its block but links, so a group of thousands of copies costs a few rows a member.

Defined cases: a null text is alone in its class. Texts without words are duplicates only of equal texts. A text of
fewer than five words is one shingle. Repeated rows share a class and each keeps its row. class_id is the smallest id
of the class (null if no row has one). Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import keep, key_columns, returning_memory, steps
from tideloom.llm.components import components
from tideloom.llm.shingles import Shingler, mix

SLOTS, ROWS, BANDS = 512, 4, 20
BLOCK = 256
#: Bytes of text of a block, unless it is one text.
BLOCK_BYTES = 4 << 20
#: Members of a class in a block, from which on their shingles are looked up together first.
TOGETHER = 4
#: Nodes (16 bytes each) that a task remembers so as to sketch equal texts once.
REMEMBERED = 100_000
#: Text that is sketched or compared at a time.
STEP = 512 << 10
#: Slots in which two nodes of a bucket must agree before their texts are compared: 4 deviations below 0.8.
AGREE = 373

_GOLDEN = 0x9E3779B97F4A7C15


def _nth(k: int) -> np.uint64:
    """A constant of its own for each number."""
    return np.uint64(k * _GOLDEN & 0xFFFFFFFFFFFFFFFF)


def bag_min_hash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n, slots) of the multisets (owner, shingle, weight); 0 where a multiset is empty."""
    doc, seed, width, base, top = [], [], [], [], []
    octave, low, span = 0, 0, 1
    rest = np.arange(len(owner))
    while len(rest):
        doc.append(owner[rest])
        seed.append(mix(shingle[rest] + _nth(octave)))
        width.append(np.full(len(rest), span))
        base.append(np.full(len(rest), low))
        top.append(weight[rest])
        low, span, octave = low + span, (span if octave == 0 else 2 * span), octave + 1
        rest = rest[weight[rest] > low]
    doc, seed, width, base, top = map(np.concatenate, (doc, seed, width, base, top)) if doc else [np.zeros(0, int)] * 5
    times = np.full(n * slots, np.inf)
    marks = np.zeros(n * slots, np.uint64)
    now, drawn = np.zeros(len(doc)), 0
    while len(doc):
        drawn += 1
        point = mix(seed + _nth(2 * drawn))
        other = mix(seed + _nth(2 * drawn + 1))
        now = now - np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        place = doc * slots + ((other >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
        unit = base + (((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * width).astype(np.int64)
        covered = unit < top
        place, when, mark = place[covered], now[covered], other[covered]
        np.minimum.at(times, place, when)
        first = times[place] == when
        marks[place[first]] = mark[first]
        latest = times.reshape(n, slots).max(axis=1)
        going = now < latest[doc]
        doc, seed, width, base, top, now = doc[going], seed[going], width[going], base[going], top[going], now[going]
    return marks.reshape(n, slots)


SKETCH = "node binary, bands array<bigint>, signature binary, size int"


def _first_seen(nodes: pa.Array, seen: set) -> pa.Array:
    """Rows whose node is not in ``seen`` (which then holds it); the set starts anew when it is full."""
    rows = []
    for i, node in enumerate(nodes.to_pylist()):
        if node not in seen:
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(node)
            rows.append(i)
    return pa.array(rows, pa.int64())


@returning_memory
def _sketch(batches):
    """(node, text) -> sketches; copies that a task meets again are left out, those of other tasks are merged later."""
    shingler, seen = Shingler(), set()
    for batch in batches:
        batch = batch.take(_first_seen(batch.column(0), seen))
        nodes, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for start, end in steps([len(t.as_buffer()) for t in texts], STEP):
            some = [t.as_py() for t in texts.slice(start, end - start)]
            signatures = bag_min_hash(*shingler.multisets(some), len(some))
            has = np.flatnonzero(signatures.any(axis=1))
            signatures, sizes = signatures[has], np.array([len(t) for t in some], np.int32)[has]
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(has), BANDS)).copy()
            for r in range(ROWS):
                band = mix(band * _nth(1) + signatures[:, r : BANDS * ROWS : ROWS])
            rows = pa.array(band.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    nodes.slice(start, end - start).take(pa.array(has)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), rows),
                    pa.array([s.tobytes() for s in signatures.astype(np.uint16)], pa.binary()),
                    pa.array(sizes),
                ],
                names=["node", "bands", "signature", "size"],
            )


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Weights of the intersection and of the union of two multisets (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both, int(a[1].sum() + b[1].sum()) - both


@returning_memory
def _verify(batches, similarity: float):
    """(a, part, b, text) sorted by (a, part, b), first the text of ``a`` itself (b is null) -> the pairs at ``similarity``."""
    shingler, kept = Shingler(), None
    split = lambda o, s, w, n: [(s[x:y], w[x:y]) for x, y in zip(*np.searchsorted(o, [range(n), range(1, n + 1)]))]
    for batch in batches:
        b, texts = batch.column("b"), batch.column("text").cast(pa.binary())
        good = np.zeros(len(b), bool)
        for start, end in steps([len(t.as_buffer()) for t in texts], STEP):
            n = end - start
            for k, mine in enumerate(split(*shingler.multisets([t.as_py() for t in texts.slice(start, n)]), n), start):
                if not b[k].is_valid:
                    kept = mine
                else:
                    both, union = overlap(kept, mine)
                    good[k] = union > 0 and both >= similarity * union - 1e-9
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The text of ``a`` goes once to each part of its pairs (:data:`BLOCK` at most), the text of ``b`` to each of its pairs."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), "b")
    every = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = every.select("a", "part", F.lit(None).cast("binary").alias("b"), F.col("a").alias("node"))
    asked = first.unionByName(dealt.withColumn("node", F.col("b")))
    rows = texts.join(asked, "node").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return rows.mapInArrow(lambda batches: _verify(batches, similarity), "a binary, b binary")


def _whole_blocks(batches):
    """Rows sorted by (bucket, x, y) as batches of whole blocks, each with the places where its blocks start and its end."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        marks = np.rec.fromarrays([held.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero(marks[1:] != marks[:-1]) + 1
        if len(cuts):
            yield held.slice(0, cuts[-1]), np.r_[0, cuts]
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


@returning_memory
def _compare_blocks(batches):
    """Rows sorted by (bucket, x, y): pairs of different classes whose signatures agree, block by block."""
    for rows, cuts in _whole_blocks(batches):
        yield _node_pairs(rows, [pair for _, _, pairs in _compare(rows, cuts) for pair in pairs])


@returning_memory
def _link_blocks(batches, similarity: float):
    """The same rows with texts: links enough to connect the classes of each block that have a pair at ``similarity``."""
    shingler = Shingler()
    for rows, cuts in _whole_blocks(batches):
        roots, texts = rows.column("root").to_pylist(), rows.column("text").cast(pa.binary())
        found = []
        for start, end, pairs in _compare(rows, cuts):
            if pairs:
                sets = _multisets(shingler, texts, sorted({i for pair in pairs for i in pair}))
                found += _linked(pairs, sets, roots, Counter(roots[start:end]), similarity)
        yield _node_pairs(rows, found)


def _node_pairs(rows: pa.RecordBatch, pairs) -> pa.RecordBatch:
    nodes = rows.column("node")
    both = [sorted((nodes[int(i)].as_py(), nodes[int(j)].as_py())) for i, j in pairs]
    a, b = zip(*both) if both else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _compare(rows: pa.RecordBatch, cuts: np.ndarray):
    """For each block (start, end, pairs of rows of different classes whose signatures agree)."""
    roots = rows.column("root").dictionary_encode().indices.to_numpy()
    x, y, side, band = (rows.column(c).to_numpy() for c in ("x", "y", "side", "band"))
    signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS)
    bands = np.stack(rows.column("bands").to_pylist())
    for start, end in zip(cuts[:-1], cuts[1:]):
        out = []
        for i in range(start, end):
            # within a block: each pair once; between two blocks: pairs across only
            if x[i] != y[i] and side[i] != x[i]:
                continue
            others = np.arange(i + 1, end) if x[i] == y[i] else (start + np.flatnonzero(side[start:end] == y[i]))
            others = others[roots[others] != roots[i]]
            others = others[(signatures[others] == signatures[i]).sum(axis=1) >= AGREE]
            # given by the first bucket of both
            others = others[~(bands[others, : band[i]] == bands[i, : band[i]]).any(axis=1)]
            out += [(i, j) for j in others.tolist()]
        yield start, end, out


def _multisets(shingler: Shingler, texts: pa.Array, wanted: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row -> (sorted shingles, counts), for the rows ``wanted``."""
    sets = {}
    for start, end in steps([len(texts[i].as_buffer()) for i in wanted], STEP):
        owner, shingle, weight = shingler.multisets([texts[i].as_py() for i in wanted[start:end]])
        cuts = np.searchsorted(owner, np.arange(end - start + 1))
        sets |= {i: (shingle[x:y], weight[x:y]) for i, x, y in zip(wanted[start:end], cuts[:-1], cuts[1:])}
    return sets


def _union(sets) -> tuple[np.ndarray, np.ndarray]:
    """The least multiset that holds each of some: sorted shingles, greatest counts."""
    shingle, weight = (np.concatenate(x) for x in zip(*sets))
    order = np.argsort(shingle)
    shingle, weight = shingle[order], weight[order]
    first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    return shingle[first], np.maximum.reduceat(weight, first)


def _linked(pairs, sets, roots, company: Counter, similarity: float) -> list[tuple[int, int]]:
    """Pairs at ``similarity`` among the candidates of a block, one at most for classes that others connect already.

    The candidates of a node in one class are first compared with the node as one multiset, their union.
    """
    leads: dict = {}

    def lead(root):
        while leads.get(root, root) != root:
            root = leads[root]
        return root

    by: dict[tuple, list[int]] = {}
    for i, j in pairs:
        if (company[roots[i]], roots[i]) > (company[roots[j]], roots[j]):
            i, j = j, i
        by.setdefault((i, roots[j]), []).append(j)
    members: dict = {}
    for (_, root), some in by.items():
        members.setdefault(root, set()).update(some)
    weights = {i: int(weight.sum()) for i, (_, weight) in sets.items()}
    unions: dict = {}
    out = []
    for (i, root), some in by.items():
        if lead(roots[i]) == lead(root):
            continue
        if len(some) >= TOGETHER:
            if root not in unions:
                unions[root] = _union([sets[j] for j in sorted(members[root])])
            shingle, weight = unions[root]
            at = np.minimum(np.searchsorted(shingle, sets[i][0]), len(shingle) - 1)
            most = int(np.where(shingle[at] == sets[i][0], np.minimum(weight[at], sets[i][1]), 0).sum())
            least = lambda j: weights[i] + weights[j] - min(most, weights[j])
            some = [j for j in some if min(most, weights[j]) >= similarity * least(j) - 1e-9]
        for j in some:
            both, union = overlap(sets[i], sets[j])
            if union > 0 and both >= similarity * union - 1e-9:
                out.append((i, j))
                leads[lead(roots[i])] = lead(root)
                break
    return out


def links(docs: DataFrame, similarity: float) -> DataFrame:
    """Verified pairs (a, b) from rows (node, text), enough of them to connect whatever shares a bucket and is similar."""
    given = docs.filter("text is not null")
    sketches = keep(given.mapInArrow(_sketch, SKETCH).dropDuplicates(["node"]), "sketches")
    buckets = sketches.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = keep(buckets.join(crowded, "bucket"), "members")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = members.select("bucket", "node").join(company, "node").select("bucket", F.struct("company", "node").alias("rank"))
    first = ranked.groupBy("bucket").agg(F.max("rank").alias("first"))
    # the second leader: the best of those who have another company than the first
    second = ranked.join(first, "bucket").filter("rank.company < first.company").groupBy("bucket").agg(F.max("rank").alias("second"))
    leaders = first.join(second, "bucket", "left").select(
        "bucket", F.array_compact(F.array("first.node", "second.node")).alias("leaders")
    )
    pairs = members.join(leaders, "bucket").select(F.explode("leaders").alias("a"), F.col("node").alias("b")).filter("a <> b")
    pairs = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = members.select("node").distinct()
    texts = keep(given.dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "texts")
    stars = keep(_verified(pairs, texts, similarity), "links")
    return stars.unionByName(keep(_between_classes(members, components(stars), sketches, texts, similarity), "links"))


def _between_classes(members: DataFrame, classes: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links of one bucket between what are different classes so far."""
    known = members.join(classes, "node", "left").select(
        "bucket", "band", "n", "size", "node", F.coalesce("root", "node").alias("root")
    )
    # pairs of two nodes were compared already
    held = known.filter("n > 2").groupBy("bucket", "root").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    mixed = held.groupBy("bucket").agg(
        F.max(F.struct("m", "root", "bytes")).alias("main"), F.sum("m").alias("m"), F.sum("bytes").alias("bytes")
    ).filter("main.m < m")
    blocks = lambda m, size: F.greatest(F.ceil(m / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    # the largest class has the first blocks, which need not meet each other
    shape = mixed.select(
        "bucket", F.col("main.root").alias("main"), blocks(F.col("main.m"), F.col("main.bytes")).alias("p"),
        blocks(F.col("m") - F.col("main.m"), F.col("bytes") - F.col("main.bytes")).alias("q"),
    )
    part = lambda n: F.pmod(F.hash("node", F.lit(1)), F.col(n))
    rows = known.join(shape, "bucket").withColumn("first", F.col("root") == F.col("main"))
    rows = rows.withColumn("side", F.when(F.col("first"), part("p")).otherwise(F.col("p") + part("q")))
    met = F.sequence(F.when(F.col("first"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)
    spread = rows.select("bucket", "band", "node", "root", "side", F.explode(met).alias("with")).select(
        "bucket", F.least("side", "with").alias("x"), F.greatest("side", "with").alias("y"), "band", "node", "root", "side"
    )
    spread = spread.join(sketches, "node").join(texts, "node")
    spread = spread.select("bucket", "x", "y", "band", "node", "root", "side", "bands", "signature", "text")
    dealt = spread.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return dealt.mapInArrow(lambda batches: _link_blocks(batches, similarity), "a binary, b binary")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id, ka, kb, class_id, class_size, first).

    ``ka``, ``kb`` are the key of the row (see ``key_columns``); ``first`` marks the row with the least id of its class.
    """
    whole, key = F.col(text), ["id", "ka", "kb"]
    rows = docs.select(F.col(id).alias("id"), *key_columns(F.col(id), whole), F.unhex(F.md5(whole)).alias("node"), whole.alias("text"))
    ids = keep(rows.select(*key, "node"), "ids")
    classes = components(links(rows.select("node", "text"), similarity))
    per_node = ids.filter("node is not null").groupBy("node").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct(*key))).alias("low"), F.min(F.struct("ka", "kb")).alias("any"), F.count("*").alias("n")
    )
    rooted = per_node.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = rooted.groupBy("root").agg(F.min("low").alias("low"), F.min("any").alias("any"), F.sum("n").alias("class_size"))
    named = rooted.select("node", "root").join(low, "root").select("node", "low", "any", "class_size")
    out = ids.join(named, "node", "left")
    alone = F.col("node").isNull()
    # a class of rows without ids is led by its least key
    leads = F.when(F.col("low").isNotNull(), F.struct("ka", "kb") == F.struct("low.ka", "low.kb")).otherwise(F.struct("ka", "kb") == F.col("any"))
    return out.select(
        F.col("id").alias(id),
        "ka",
        "kb",
        F.when(alone, F.col("id")).otherwise(F.col("low.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | leads).alias("first"),
    )
