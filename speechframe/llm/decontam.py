"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are hashed; at every position each of the fixed masks below hashes the
words it selects and skips the others, so that a substitution in a skipped
place leaves the hash alone.  Training hashes meet the benchmark's in a join;
every hit names an alignment (document, item, offset), along which the overlap
is verified: some window of ``min_words`` words (the whole item, if shorter)
must have at least ``similarity`` of its words equal, whatever the others are.
Items too short for these masks have masks of their own: of weight four for 5 and
6 words, all their words for 1 to 4 (which may not differ in any).  Documents are
hashed by those only where the benchmark has items of that length.

The benchmark's hashes are broadcast only when their size, counted first, is
within ``BROADCAST_BYTES``.  Beyond it narrow hashes of both sides are shuffled
(adaptive execution splits the partition of a hash that very many texts share),
and the words around hits are joined from either table; rows are told apart by
id and a hash of their text, so both ways give the same rows.

Defined results: words are runs of letters and digits, lower-cased; a null or
empty text or item matches nothing; of rows with the same doc_id (null too) or
item_id each is compared with each and the best overlap is returned; an empty table gives
no row.  ``clean`` drops all rows of a contaminated id, null included, and by default
leaves items of fewer than LEAST_CLEAN words aside, as a common word is no leak.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks of weight five: 1 selects a word, 0 skips it. In a window of 7 to 13 words one of them misses any substitutions that 0.8 allows.
MASKS = ("101111", "111011", "111101", "1110011")
#: Words that the windows around a hit must hold: no more than the shortest of these masks.
SPAN = 5
#: Masks by the words of a short item: at 0.8 one of 5 or 6 may have but four words equal, a shorter one must have all.
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("1111", "10111", "11011", "11101"), 6: ("1111", "10111", "11011", "11101")}
#: Bytes of the benchmark's hashes up to which they are broadcast, and of a row: key, item, two counts, words around, and what a hash table adds.
BROADCAST_BYTES = 128 << 20
LEAST_CLEAN = 5


def row_bytes(min_words: int) -> int:
    return 8 * (2 * min_words - SPAN + 4) + 64


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """A row per position and mask: the columns of df, with pos and key. A key depends on its mask, not on the mask's place among others.

    The outer explode keeps the optimiser from testing the array's size first, which would split every text twice.
    """
    at = df.select("*", F.posexplode_outer("h").alias("pos", "word"))
    n = F.size("h")
    keys = [F.when(F.col("pos") + len(m) <= n, F.xxhash64(F.lit(m), *[F.get("h", F.col("pos") + j) for j, c in enumerate(m) if c == "1"])) for m in masks]
    return at.drop("word").withColumn("key", F.explode(F.array(*keys))).where("key is not null")


def around(pos: Column, min_words: int) -> Column:
    """The words of all windows of ``min_words`` that hold the SPAN words at pos, so any that hold a seed there; null past the ends. A short item lies within them from any of its seeds."""
    return F.array(*[F.get("h", pos + j) for j in range(SPAN - min_words, min_words)])


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, min_words: int = 13, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """Contaminated documents of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    Returns a row per document and item: doc_id, item_id, window_words, matched_words (most equal words of a window), item_words.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h"))
    short = sorted(r.n for r in items.select(F.size("h").alias("n")).where(F.col("n").between(1, max(SHORT_MASKS))).distinct().collect())  # six numbers at most
    parts = [seeds(items, masks), *[seeds(items.where(F.size("h") == n), SHORT_MASKS[n]) for n in short]]
    masks = tuple(dict.fromkeys([*masks, *[m for n in short for m in SHORT_MASKS[n]]]))  # of the documents: only the lengths that occur
    narrow = reduce(DataFrame.unionAll, parts).select("key", "item_id", "pos", "h")
    surrounded = lambda df, name: df.select("*", around(F.col("pos"), min_words).alias(name))
    test = surrounded(narrow, "iw").select("key", "item_id", "iw", F.size("h").alias("item_words")).distinct()
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("h"))
    if test.count() * row_bytes(min_words) <= BROADCAST_BYTES:
        # Positions whose hash isn't in the benchmark fall away inside the scan's own stage; only hits carry their surroundings.
        hits = surrounded(seeds(hashed, masks).join(F.broadcast(test), "key"), "w").select("doc_id", "item_id", "iw", "item_words", "w")
    else:
        # A row is its id and a hash of its words: rows that agree in both have the same overlaps.
        told = lambda df, k: df.select(*[F.col(c) for c in df.columns if c != "h"], "h", F.xxhash64("h").alias(k))
        left = seeds(told(hashed, "drow"), masks).select("doc_id", "drow", "pos", "key")
        right = told(narrow, "irow").select("item_id", "irow", F.col("pos").alias("ipos"), "key")
        found = left.join(right, "key").drop("key").distinct()
        rows = lambda df, k, names: told(df, k).distinct().toDF(*names)
        d, i = rows(hashed, "drow", ["__d", "h", "__drow"]), rows(items, "irow", ["__i", "h", "__irow"])
        with_words = surrounded(found.join(d, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("drow") == F.col("__drow"))), "w").select("doc_id", "item_id", "irow", "ipos", "w")
        back = with_words.join(i, F.col("item_id").eqNullSafe(F.col("__i")) & (F.col("irow") == F.col("__irow")))
        hits = surrounded(back.withColumn("pos", F.col("ipos")), "iw").select("doc_id", "item_id", "iw", F.size("h").alias("item_words"), "w")
    width = F.least(F.lit(min_words), F.col("item_words"))
    same = hits.select("doc_id", "item_id", "item_words", width.alias("window_words"), F.zip_with("w", "iw", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))).alias("same"))
    sums = [F.aggregate(F.slice("same", s + 1, F.col("window_words")), F.lit(0), lambda a, x: a + x) for s in range(min_words - SPAN + 1)]
    best = same.groupBy("doc_id", "item_id", "item_words", "window_words").agg(F.max(F.greatest(*sums)).alias("matched_words"))
    verified = best.where(F.col("matched_words") >= F.ceil(F.col("window_words") * F.lit(similarity)))
    return verified.groupBy("doc_id", "item_id").agg(F.max("window_words").alias("window_words"), F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_CLEAN, **options) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns; items of fewer than ``least_words`` words aren't looked for."""
    found = overlaps(docs, benchmark.where(F.size(word_hashes(F.col("text"))) >= least_words), **options).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)
