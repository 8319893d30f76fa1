"""Benchmark decontamination by SimHash windows, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, materialize

#: Words of a shingle and least weighted similarity.
SHINGLE, LEAST = 5, 0.8
#: Fingerprints have 64 bits in 4 blocks of 16. An item's block is entered with all values up to 3 bits away, a window's is
#: looked up with those up to 1 bit away, so by the pigeonhole principle every fingerprint within 4 * 5 - 1 = 19 bits is
#: found; of unlike pairs 15 % meet and 0.1 % are within the radius. At similarity 0.8 the expected distance is 9.7 bits
#: with a deviation of 2.9, so a window just as similar is missed with a chance of 0.0007, and less above.
BLOCKS, BLOCK_BITS, ITEM_FLIPS, WINDOW_FLIPS = 4, 16, 3, 1
RADIUS = BLOCKS * (ITEM_FLIPS + WINDOW_FLIPS + 1) - 1
#: Benchmark shingles up to this number are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_SHINGLES = 1_000_000


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Hash of each k consecutive words; an empty array if there are fewer."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(rows: DataFrame, key: list[str]) -> DataFrame:
    """SimHash of the shingles h of each key: bit b is set if more of them have it than not."""
    sums = rows.groupBy(*key).agg(*[F.sum(F.when(F.getbit("h", F.lit(b)) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(64)])
    bit = lambda b: F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    fp = bit(0)
    for b in range(1, 64):
        fp = fp.bitwiseOR(bit(b))
    return sums.select(*key, fp.alias("fp"))


def _blocks(fps: DataFrame, fp: str, flips: int) -> DataFrame:
    """fps with block and value: a row for each block of fp and each value up to so many bits from the block's."""
    masks = [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(BLOCK_BITS), k)]
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("value")) for i in range(BLOCKS)]))
    each = fps.select("*", own.alias("x")).select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    return each.select(*fps.columns, F.col("x.block").alias("block"), F.col("x.value").bitwiseXOR(F.col("mask")).alias("value"))


def _counted(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key, "h").agg(F.count("*").alias("c"))


def _starts(least: float) -> Column:
    """Starts of all windows of n words that could reach least, from the sorted places at of the shingles that text and items share.

    Of the window's and the item's shingles together, least / (1 + least) have to be shared; as many places in a
    row lie in the windows that start from n - k before the last of them up to the first.
    """
    reach, last = F.col("n") - F.col("k"), F.greatest(F.lit(0), F.col("n_words") - F.col("n"))
    mass = F.least("n", "n_words") + F.col("n") - 2 * F.col("k") + 2
    need = F.greatest(F.lit(1), F.ceil(mass * F.lit(least / (1 + least)) - 1e-9).cast("int"))
    firsts = F.slice("at", F.lit(1), F.greatest(F.lit(0), F.size("at") - need + 1))
    spans = F.zip_with(firsts, F.slice("at", need, F.size(firsts)), lambda first, end: F.struct(F.greatest(F.lit(0), end - reach).alias("low"), F.least(first, last).alias("high")))
    return F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda x: x["low"] <= x["high"]), lambda x: F.sequence(x["low"], x["high"]))))


def leaks(texts: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Passages of texts that are about a benchmark item.

    texts: td (a text's digest), text; benchmark: item_id, text. Windows of an item's number of words
    are laid wherever enough of their shingles, in any order, are among those of the items of that
    number: a window with fewer can't reach least. Windows' and items' SimHash fingerprints meet through
    the Hamming blocks, are held within RADIUS, and then verified by the weighted similarity of the
    shingles (sum of smaller by sum of larger numbers of occurrences). Items with fewer than
    five words count as one shingle of their own length; items without words match nothing.
    Returns td, item_id, start (word), n_words, distance, similarity; one row for each window.
    """
    items = materialize(benchmark.select("item_id", plain_words(F.col("text")).alias("words")).where("size(words) > 0").select("item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct(), "items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE of them
    arrays = items.select("item_id", "n", "k", F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("words"), k)) for k in sizes] or [F.array().cast("array<bigint>")]).alias("sh"))
    item_rows = materialize(arrays.select("item_id", "n", "k", F.posexplode_outer("sh").alias("at", "h")).where("h is not null"), "items")
    wanted = materialize(item_rows.select("k", "n", "h").distinct(), "items")
    few = F.broadcast if wanted.count() <= BROADCAST_SHINGLES else lambda x: x
    hit = None
    words = texts.select("td", plain_words(F.col("text")).alias("words"))
    for k in sizes:
        # The words end before the explosion, which copies what it hands on into every row. An inner explosion would have the
        # optimizer test the array's size on the text, with the words cut out again for every shingle.
        ours = words.select("td", F.size("words").alias("n_words"), shingles(F.col("words"), k).alias("sh")).select("td", "n_words", F.posexplode_outer("sh").alias("pos", "h")).where("h is not null")
        one = ours.join(few(wanted.where(F.col("k") == k).drop("k")), "h").select("td", F.lit(k).alias("k"), "n", "n_words", "pos").distinct()
        hit = one if hit is None else hit.unionByName(one)
    if hit is None:
        return texts.select("td", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("distance"), F.lit(0.0).alias("similarity")).where("false")
    places = hit.groupBy("td", "k", "n", "n_words").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    hit = materialize(places.select("td", "k", "n", F.explode_outer(_starts(least)).alias("start")).where("start is not null"), "windows")
    # Of a text that has a hit, one copy; the partial aggregate takes most copies before the shuffle.
    found = texts.join(hit.select("td").distinct(), "td", "left_semi").groupBy("td").agg(F.first("text").alias("text"))
    # A text's windows go to it as one row for each length, so that its shingles are not copied for every window.
    wide = hit.groupBy("td", "n", "k").agg(F.collect_list("start").alias("starts"))
    cut = None
    for k in sizes:
        arr = found.select("td", plain_words(F.col("text")).alias("words")).select("td", shingles(F.col("words"), k).alias("sh"))
        size = F.col("n") - (k - 1)
        window = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("sh", s + 1, size).alias("sh")))  # noqa: B023
        one = arr.join(wide.where(F.col("k") == k), "td").select("td", "n", "k", F.explode_outer(window).alias("w")).select("td", "n", "k", "w.start", F.explode_outer("w.sh").alias("h")).where("h is not null")
        cut = one if cut is None else cut.unionByName(one)
    key = ["td", "n", "k", "start"]
    cut = materialize(cut, "windows")
    windows = _fingerprints(cut, key)
    ours = _blocks(windows, "fp", WINDOW_FLIPS)
    theirs = _blocks(_fingerprints(item_rows, ["item_id", "n", "k"]).withColumnRenamed("fp", "item_fp"), "item_fp", ITEM_FLIPS)
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # An explosion's rows aren't in the planner's sizes, by which it would broadcast them.
    pairs = ours.join(theirs.hint("merge"), ["n", "k", "block", "value"]).where(distance <= RADIUS).select(*key, "item_id", distance.alias("distance")).distinct()
    mine, its = _counted(cut, key), _counted(item_rows, ["item_id"]).withColumnRenamed("c", "c2")
    both = pairs.join(mine, key).join(its, ["item_id", "h"]).groupBy(*key, "item_id", "distance").agg(F.sum(F.least("c", "c2")).alias("shared"))
    mass = both.join(mine.groupBy(*key).agg(F.sum("c").alias("m1")), key).join(its.groupBy("item_id").agg(F.sum("c2").alias("m2")), "item_id")
    similar = mass.withColumn("similarity", F.col("shared") / (F.col("m1") + F.col("m2") - F.col("shared")))
    return similar.where(F.col("similarity") >= least).select("td", "item_id", "start", F.col("n").alias("n_words"), "distance", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows, start (of the first), similarity (the largest): one row for each document and item it holds.

    Documents without a passage have no row. Null and empty texts hold nothing; very long texts are searched whole; repeated
    rows and null ids each have theirs; other columns play no part; empty tables give no rows.
    """
    texts = docs.select("doc_id", "text", digest(F.col("text")).alias("td"))
    found = leaks(texts.select("td", "text"), benchmark, least).groupBy("td", "item_id").agg(F.count("*").alias("n_windows"), F.min("start").alias("start"), F.max("similarity").alias("similarity"))
    found = materialize(found, "found")  # so that the rows of a text with very many copies can be split
    return texts.select("doc_id", "td").join(found, "td").select("doc_id", "item_id", "n_windows", "start", "similarity")
