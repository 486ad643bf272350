"""Mixing sources to target weights: subset-sum budget fitting over length counts.

1. One pass over the texts gives each document's size in words; everything after works on (key, source, size).
2. Targets: each source's share of the total by weight, at most ``max_repeats`` times its own size; what a full source
   leaves is shared again among the others by weight until none is above.
3. Per source, documents are counted by exact length. Whole rounds of the source come first; of the rest, most is filled
   in proportion over the lengths, and a bounded-knapsack dynamic programme over the lengths that are left fits the
   remaining budget. Where that misses the target, the programme sees more: fewer lengths are filled before, and fewer
   rounds, until the target is met or every number of copies of every document was open to it. It then gives the nearest
   sum there is; :data:`WIDEST` bounds its table where the target is still missed.
4. For each (source, length) that many documents are taken in the order of a seeded hash. Crowded lengths are cut into
   hash buckets, so a length (or source) with a third of all rows is ranked in many tasks.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, sorted last.
Repeated rows are separate documents of equal rank: which of them is taken makes no difference to the rows returned.
An empty table gives an empty mix. Other columns of the input are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.llm.common import WORD, keep, key_columns

#: Documents that one ranking task should hold of one length of one source.
BUCKET = 500
#: Words that the dynamic programme's table may span beyond its first attempt (5 bytes of memory each).
WIDEST = 1 << 22


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: list[float], max_repeats: int, total_share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size). Weights repeat along the sorted sources, null last.

    The fill level is found by a few rounds of one small aggregate each; no source is collected. A source of size 0 has
    target 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = keep(_numbered(sources).withColumn("weight", _weight(weights)), "mix-sources")
    limit = F.col("source_size") * F.lit(float(max_repeats))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level, full = None, F.lit(False)
    while True:  # each round fills at least one more source, or is the last
        row = sources.agg(
            F.sum(F.when(full, limit)).alias("used"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n_full"),
        ).first()
        if not row["weight"]:
            level = float("inf")
            break
        new = max(0.0, total - (row["used"] or 0.0)) / row["weight"]
        if level is not None and new <= level:
            break
        level = new
        full = F.col("weight") * F.lit(level) >= limit
        if sources.filter(full).limit(1).isEmpty():
            break
    target = limit if level == float("inf") else F.least(limit, F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"))


def _weight(weights: list[float]) -> Column:
    values = F.array(*[F.lit(float(w)) for w in weights])
    return F.element_at(values, (F.col("number") % len(weights) + 1).cast("int"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Position of each source in code point order, null last: counted per first character, then inside it."""
    first = F.coalesce(F.substring("source", 1, 2), F.lit("")).alias("first")
    some = sources.withColumns({"first": first, "none": F.col("source").isNull()})
    counts = some.groupBy("none", "first").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("none", "first").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("none", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("none", "first").orderBy("source")
    ranked = some.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["none", "first"])
    return ranked.select("source", "source_size", (F.col("inside") + F.col("offset")).alias("number"))


def fit_lengths(lengths, counts, budget: float, copies: int = 1) -> np.ndarray:
    """How many documents of each length to take (each at most ``copies`` times) so that the words are as near
    ``budget`` as possible.

    Proportional filling, of each document once at most, leaves a headroom of a few times the longest document; the
    dynamic programme then sees every document that is left. A missed budget is tried again with a wider headroom.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    best = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return best
    longest, headroom = int(lengths.max()), 3
    while True:
        take = _filled(lengths, counts, budget, headroom * longest, copies)
        if _miss(lengths, take, budget) < _miss(lengths, best, budget):
            best = take
        headroom *= 4
        if _miss(lengths, best, budget) <= 0.5 or 3 * longest >= budget or min(headroom * longest, budget) > WIDEST:
            return best
        if headroom * longest >= 4 * budget:  # nothing was filled before this programme
            return best


def _miss(lengths: np.ndarray, take: np.ndarray, budget: float) -> float:
    return abs(float((lengths * take).sum()) - budget)


def _filled(lengths: np.ndarray, counts: np.ndarray, budget: float, headroom: int, copies: int) -> np.ndarray:
    """Proportional filling up to ``headroom`` below the budget, then the dynamic programme."""
    take = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths)
    share = min(1.0, max(0, budget - headroom) / int((lengths * counts).sum()))
    words = due = 0.0
    for i in order:
        due += share * lengths[i] * counts[i]
        take[i] = min(counts[i], max(0, int((due - words) // lengths[i])))
        words += take[i] * lengths[i]
    rest = budget - int((take * lengths).sum())
    # short documents first, and second copies only after all first ones
    order = order[::-1]
    left = np.concatenate([(counts - take)[order]] + [counts[order]] * (copies - 1))
    more = _knapsack(np.tile(lengths[order], copies), left, rest).reshape(copies, -1).sum(axis=0)
    take[order] += more
    return take


def fit_copies(lengths, counts, target: float, most: int) -> np.ndarray:
    """How many copies of documents to take of each length, at most ``most`` of a document, for a sum near ``target``.

    As many whole rounds as the target holds come first; fewer are tried where these miss it.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    rounds = min(int(target // int((lengths * counts).sum())), most)
    best = rounds * counts
    for kept in range(rounds, -1, -1):
        rest = target - kept * int((lengths * counts).sum())
        take = kept * counts + (fit_lengths(lengths, counts, rest, most - kept) if kept < most else 0)
        if _miss(lengths, take, target) < _miss(lengths, best, target):
            best = take
        if _miss(lengths, best, target) <= 0.5:
            break
    return best


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Bounded subset sum: how many of each item make the reachable sum nearest to the budget (below it, of two).

    ``item`` remembers the first item that reached each sum; its sum without that item was reached by earlier ones.
    """
    goal = max(0, round(budget))
    top = goal + int(lengths.max())
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    item = np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i, length in enumerate(lengths.tolist()):
        left, power = min(int(counts[i]), top // length), 1
        while left > 0 and not reached[goal]:
            times = min(power, left)
            step = times * length
            new = np.zeros(top + 1, bool)
            new[step:] = reached[:-step]
            new &= ~reached
            item[new] = len(items)
            items.append((i, times))
            reached |= new
            left -= times
            power *= 2
        if reached[goal]:
            break
    take = np.zeros(len(lengths), np.int64)
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, times = items[item[at]]
        take[i] += times
        at -= times * int(lengths[i])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's length counts (as many rows as it has different lengths) -> documents to take by length."""
    rows = rows.sort_values("size")
    take = fit_copies(rows["size"], rows["n"], float(rows["target"].iloc[0]), int(rows["max_repeats"].iloc[0]))
    rows["rounds"], rows["extra"] = take // rows["n"], take % rows["n"]
    return rows[["source", "size", "n", "rounds", "extra"]]


def mix(
    docs: DataFrame,
    weights: list[float],
    *,
    max_repeats: int = 3,
    seed: int = 7,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: (id, ka, kb, source, size, source_size, target, repeats, taken); ka and kb are the row's key.

    ``repeats`` says how often the mix holds the document, ``taken`` = repeats * size.
    """
    chosen = F.xxhash64(F.lit(seed), F.col(id), F.col(text))
    sizes = keep(
        docs.select(F.col(id).alias("id"), *key_columns(F.col(id), F.col(text)), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), chosen.alias("draw")),
        "mix-sizes",
    )
    targets = source_targets(sizes, weights, max_repeats)
    histogram = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    same = F.col("h.source").eqNullSafe(F.col("t.source"))
    rows = histogram.alias("h").join(targets.alias("t"), same).select("h.source", "size", "n", "source_size", "target")
    fitted = rows.withColumn("max_repeats", F.lit(max_repeats)).groupBy("source").applyInPandas(
        _fit_source, "source string, size bigint, n bigint, rounds bigint, extra bigint"
    )
    # buckets of the draw: as many as keep each near BUCKET documents
    fitted = keep(fitted.withColumn("buckets", F.ceil(F.col("n") / BUCKET).cast("bigint")), "mix-plan")
    plan, size = fitted.alias("p"), sizes.alias("s")
    joined = size.join(
        plan, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")), "left"
    ).select("s.*", "rounds", "extra", F.pmod(F.shiftrightunsigned("draw", 20), F.coalesce("buckets", F.lit(1))).alias("bucket"))
    per_bucket = joined.groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"), F.first("extra").alias("extra"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = per_bucket.withColumn("left", F.col("extra") - F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0))).select(
        "source", "size", "bucket", F.greatest(F.lit(0), F.least("in_bucket", "left")).alias("quota")
    )
    j, q = joined.alias("j"), quota.alias("q")
    match = F.col("j.source").eqNullSafe(F.col("q.source")) & (F.col("j.size") == F.col("q.size")) & (F.col("j.bucket") == F.col("q.bucket"))
    ranked = j.join(q, match, "left").select("j.*", "quota").withColumn(
        "rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("draw", "id"))
    )
    repeats = F.coalesce("rounds", F.lit(0)) + F.when(F.col("rank") <= F.coalesce("quota", F.lit(0)), 1).otherwise(0)
    result, t = ranked.withColumn("repeats", F.when(F.col("size") > 0, repeats).otherwise(0)).alias("r"), targets.alias("t")
    return result.join(t, F.col("r.source").eqNullSafe(F.col("t.source")), "left").select(
        F.col("id").alias(id),
        "ka",
        "kb",
        F.col("r.source").alias(source),
        "size",
        "source_size",
        "target",
        "repeats",
        (F.col("repeats") * F.col("size")).alias("taken"),
    )
