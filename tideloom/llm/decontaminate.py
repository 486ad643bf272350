"""Benchmark decontamination with a distributed positional inverted index. DataFrame and SQL functions only.

1. The benchmark is cut into windows of ``width`` consecutive words (a shorter item is one window); equal windows are
   looked up once.
2. One pass over the documents counts how often each benchmark word occurs in them.
3. Each window is anchored at its rarest words (two different offsets). A second pass stores the postings (word,
   document, position) of the anchor words in the shared folder: the index.
4. The lists of a window's two anchors, the second moved back by their distance, are intersected: equal places are
   candidates for an exact phrase, places that differ by at most ``slop`` are proximity matches. A window with a word
   that no document holds cannot occur as a phrase: its places are all proximity matches.
5. A pass over the documents with candidates compares every word of the window, so phrase matches are exact; a candidate
   with other words between or beside its anchors is a proximity match.

A frequent word is looked up only where a window has no two rarer ones. Benchmark tables are broadcast only after a
check of their size; else the same joins shuffle, and adaptive execution splits hot words.

Defined cases: a null or empty text has no words, no hits. A null item_id is an item of its own, written as "". Rows
that repeat an id and a text get equal results, each row its own; rows that share an id but not the text are kept
apart. Empty tables give no hits. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.llm.common import keep, key_columns
from tideloom.operators.joins import broadcast_if_small

# What separates words, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most rows and bytes of a benchmark table that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def words(text: Column) -> Column:
    """Words of a text in order: runs of digits, ASCII letters (lower-cased) and other code points from U+0080."""
    lowered = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, width: int, id: str = "item_id", text: str = "text") -> DataFrame:
    """(window_id, item, phrase, n) for every window of every item; equal phrases share the window_id."""
    listed = items.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")
    ).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("s")
    cut = listed.select("item", "w", starts).select(
        "item", F.array_join(F.slice("w", F.col("s") + 1, F.least(F.lit(width), F.size("w"))), " ").alias("phrase")
    )
    window_id = F.xxhash64("phrase", F.lit("window"))
    return cut.distinct().select("item", "phrase", window_id.alias("window_id"))


def _small(df: DataFrame) -> DataFrame:
    return broadcast_if_small(df, BROADCAST_ROWS, BROADCAST_BYTES)


def _tokens(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of the words of ``vocabulary`` (word) in all documents."""
    listed = docs.select("ka", "kb", F.posexplode(words(F.col("text"))).alias("position", "word"))
    return listed.join(_small(vocabulary), "word")


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The stored index: (word, ka, kb, positions), for the words asked for."""
    postings = _tokens(docs, vocabulary)
    return keep(postings.select("word", "ka", "kb", F.col("position").cast("int")).distinct(), "postings")


def matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    width: int = 10,
    slop: int = 5,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(candidates, windows): candidates (ka, kb, window_id, start, near) with ``near`` null for equal offsets.

    Candidates with ``near`` null still have to be compared word by word; see :func:`decontaminate`. The others are
    proximity matches: the two rarest words of a window, of those that documents hold, at a distance that differs by up
    to ``slop``; 0 only for windows that cannot occur as a whole.
    """
    rows = docs.select(*key_columns(F.col(id), F.col(text)), F.col(text).alias("text"))
    found = keep(windows(items, width, item_id, item_text), "windows")
    phrases = found.select("window_id", "phrase").distinct()
    parts = phrases.select("window_id", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
    counts = _tokens(rows, parts.select("word").distinct()).groupBy("word").agg(F.count("*").alias("n"))
    # a window with a word that no document holds cannot occur as a phrase; its other words may still be near
    rare = Window.partitionBy("window_id").orderBy("n", "word", "offset")
    known = parts.join(counts, "word").withColumn("rank", F.row_number().over(rare))
    whole = known.withColumn("held", F.count("*").over(Window.partitionBy("window_id"))).join(
        phrases.select("window_id", F.size(F.split("phrase", " ")).alias("n_words")), "window_id"
    )
    # one word alone is a phrase or nothing
    ranked = whole.filter("(held = n_words or held > 1) and rank <= 2").groupBy("window_id").agg(
        F.first(F.col("held") == F.col("n_words")).alias("whole"),
        *[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for c in ("word", "offset") for r in (1, 2)]
    )
    # windows of one item share their rarest words: the pair at its distance is looked up once for all of them
    ranked = ranked.withColumn("distance", F.col("offset2") - F.col("offset1"))
    anchors = keep(ranked.withColumn("pair", F.xxhash64("word1", "word2", "distance")), "anchors")
    pairs = anchors.select("pair", "word1", "word2", "distance").distinct()
    looked_up = pairs.select(F.explode(F.array("word1", "word2")).alias("word")).filter("word is not null").distinct()
    postings = index(rows, looked_up)
    place = ("ka", "kb", "pair")
    first = postings.join(_small(pairs), F.col("word") == F.col("word1")).select(
        *place, F.col("position").alias("at"), F.col("word2").isNull().alias("single")
    )
    single = first.filter("single").select(*place, "at", F.lit(None).cast("int").alias("near"))
    # the rarer list, each entry visible in its own bin and the two beside it
    bin_of = lambda c: F.floor(c / (slop + 1))
    bins = F.array(*[bin_of(F.col("at")) + k for k in (-1, 0, 1)])
    left = first.filter("not single").select(*place, "at", F.explode(bins).alias("bin"))
    right = postings.join(_small(pairs), F.col("word") == F.col("word2")).select(
        *place, (F.col("position") - F.col("distance")).alias("at2")
    )
    gap = F.abs(F.col("at") - F.col("at2"))
    both = left.join(right.withColumn("bin", bin_of(F.col("at2"))), [*place, "bin"]).filter(gap <= slop)
    met = both.select(*place, "at", F.when(gap > 0, gap).cast("int").alias("near")).unionByName(single)
    starts = met.join(_small(anchors.select("pair", "window_id", "offset1", "whole")), "pair").select(
        "ka", "kb", "window_id", (F.col("at") - F.col("offset1")).alias("start"),
        F.when(~F.col("whole"), F.coalesce("near", F.lit(0))).otherwise(F.col("near")).alias("near"),
    )
    return starts, found


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    width: int = 10,
    slop: int = 5,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document: id, key (ka, kb), n_words, n_hit, n_items, n_near, items, hits (array of (start, n, phrase)).

    ``n_hit`` counts the words inside occurrences, ``items`` are the sorted item ids, ``n_near`` the windows with a
    proximity match: both anchors near their distance, but not the phrase.
    """
    candidates, found = matches(
        docs, items, width=width, slop=slop, id=id, text=text, item_id=item_id, item_text=item_text
    )
    phrases = found.select("window_id", "phrase").distinct()
    # per window: is it near anywhere, and the places that have to be compared
    each = candidates.groupBy("ka", "kb", "window_id").agg(
        F.max(F.col("near").isNotNull()).alias("sure"), F.collect_set(F.when(F.col("near").isNull(), F.col("start"))).alias("starts")
    )
    compared = each.join(_small(phrases), "window_id").groupBy("ka", "kb").agg(
        F.collect_list(F.when(F.size("starts") > 0, F.struct("starts", "phrase", "sure"))).alias("windows"),
        F.count_if("sure").alias("n_sure"),
    )
    wanted = keep(compared, "candidates")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), *key_columns(F.col(id), F.col(text)))
    # one plan at every size: the candidates grow with the documents and are not to be broadcast
    tokens = rows.join(wanted.hint("merge"), ["ka", "kb"], "left").select("id", "ka", "kb", "n_sure", "windows", words(F.col("text")).alias("w"))
    verified = tokens.select(
        "id", "ka", "kb",
        F.size("w").cast("bigint").alias("n_words"),
        "n_sure",
        F.transform(
            "windows",
            lambda x: F.struct(
                F.filter(x.starts, lambda s: (s >= 0) & (F.array_join(F.slice("w", F.greatest(s, F.lit(0)) + 1, _length(x.phrase)), " ") == x.phrase)).alias("starts"),
                F.size(x.starts).alias("n"), x.phrase.alias("phrase"), x.sure.alias("sure"),
            ),
        ).alias("windows"),
    )
    # a candidate that is no phrase is near; a window counts once
    other = F.size(F.filter("windows", lambda x: ~x.sure & (F.size(x.starts) < x.n)))
    verified = verified.select(
        "id", "ka", "kb", "n_words",
        F.coalesce(F.col("n_sure") + other, F.lit(0)).cast("bigint").alias("n_near"),
        F.array_sort(
            F.flatten(
                F.transform("windows", lambda x: F.transform(x.starts, lambda s: F.struct(s.alias("start"), _length(x.phrase).alias("n"), x.phrase.alias("phrase"))))
            )
        ).alias("hits"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a.end, x.start + x.n).alias("end"),
            (a.n + F.greatest(F.lit(0), x.start + x.n - F.greatest(a.end, x.start))).alias("n"),
        ),
        lambda a: a.n,
    )
    verified = verified.withColumn("n_hit", F.coalesce(F.when(F.size("hits") > 0, covered), F.lit(0)).cast("bigint"))
    return _with_items(verified, found)


def _length(phrase: Column) -> Column:
    return F.regexp_count(phrase, F.lit(" ")) + 1


def _with_items(verified: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the items whose windows occur, per set of phrases: documents with equal sets share the lookup."""
    columns = ("id", "ka", "kb", "n_words", "n_hit")
    listed = keep(verified.withColumn("set", F.array_sort(F.array_distinct(F.transform("hits", lambda x: x.phrase)))), "hits")
    hit = listed.filter(F.size("set") > 0).withColumns({"sa": F.xxhash64("set"), "sb": F.xxhash64(F.lit("set"), "set")})
    sets = hit.groupBy("sa", "sb").agg(F.first("set").alias("set"))
    items = (
        sets.select("sa", "sb", F.explode("set").alias("phrase"))
        .join(_small(found.select("phrase", "item")), "phrase")
        .groupBy("sa", "sb")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    some = hit.join(items, ["sa", "sb"])
    none = listed.filter("size(set) <= 0 or set is null").withColumn("items", F.array().cast("array<string>"))
    result = lambda df: df.select(*columns, F.size("items").cast("bigint").alias("n_items"), "n_near", "items", "hits")
    return result(some).unionByName(result(none))
