"""Benchmark decontamination by SimHash windows, on DataFrame functions only.

A document window of as many words as a benchmark item leaks it when the weighted Jaccard
similarity of their 5-word shingles (weights: multiplicities) is 0.8 or more. With W shingles on
both sides that needs at least 8/9 W common ones, so any W/9 + 1 of an item's shingles (here
those with the longest first words) must meet the window; a document shorter than the item may miss
W/5, and is held against W/5 + 1. The words of every document are looked up among these first words,
and where the whole shingle agrees, every item-sized window that holds it is looked at: the
similarity ignores order, so the shingle may stand anywhere in it.

A hit leaves the scan as a range of window starts. Overlapping ranges of a text and an item are merged, and a text's
shingles are hashed once per merged range, copies of a text together. Running sums say how many shingles of the item every
window holds; windows with too few to reach the similarity go. The SimHash fingerprints of the others (one aggregate over their
shingles) meet the item's through multi-index
blocks: ``radius`` + 1 blocks, so that two fingerprints within ``radius`` bits agree in at least one
(pigeonhole). The pairs within ``radius`` are verified by exact weighted-shingle similarity.

Defined cases: null and empty texts and items leak nothing; an item under five words is one
shingle; a document shorter than an item is one window; texts and items of any length are taken whole; of equally similar
windows the first counts; repeated rows and ids give one row per
distinct (doc_id, text, item); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
MARK_BUCKETS = 256  # of 32,768 bits each
BLOCK_PROBES = 200_000  # probe shingles broadcast at once; more go in further passes


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(w: Column, length: Column | None = None) -> Column:
    """Hash of every shingle of a word array (the whole sequence if it is shorter)."""
    k = F.lit(SHINGLE) if length is None else length
    n = F.greatest(F.size(w) - k, F.lit(0))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i + 1, k))))


def simhash(hashes: Column) -> Column:
    """64-bit fingerprint: a bit is set when more than half of the hashes set it."""
    def bit(b):
        ones = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(b))).otherwise(F.lit(0).cast("bigint"))
    fp = bit(0)
    for b in range(1, 64):
        fp = fp.bitwiseOR(bit(b))
    return fp


def blocks(fp: Column, radius: int) -> Column:
    """(block, value) of ``radius`` + 1 disjoint bit blocks."""
    n, out, low = radius + 1, [], 0
    for k in range(n):
        high = 64 * (k + 1) // n
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        out.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
        low = high
    return F.array(*out)


def items(benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per item: words, shingle hashes, fingerprint and how many shingles a window may miss.

    ``slack`` holds for windows of the item's size, ``short_slack`` for shorter documents.
    """
    w = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("i_words"))
    w = w.where(F.size("i_words") > 0).dropDuplicates()
    w = w.withColumn("i_hashes", shingle_hashes(F.col("i_words")))

    def missing(share):
        return F.floor(F.size("i_hashes") * F.lit(share) + F.lit(1e-9)).cast("int")
    return w.select("item_id", F.xxhash64("item_id", "i_words").alias("i_key"), "i_words", "i_hashes",
                    simhash(F.col("i_hashes")).alias("i_fp"), missing((1 - threshold) / (1 + threshold)).alias("slack"),
                    missing(1 - threshold).alias("short_slack"), F.size("i_words").alias("i_n"))


def probes(it: DataFrame) -> DataFrame:
    """``short_slack`` + 1 shingles of every item, those with the longest first words; the first
    ``slack`` + 1 of them are for all documents, the others for ``short_only``."""
    ranked = F.array_sort(F.transform("i_hashes", lambda h, i: F.struct(
        (-F.length(F.element_at("i_words", i + 1))).alias("l"), i.alias("at"))))
    chosen = it.select("i_key", "i_words", "i_n", "slack",
                       F.posexplode(F.slice(ranked, F.lit(1), F.col("short_slack") + 1)).alias("rank", "p"))
    at = F.col("p.at")
    each = chosen.select("i_key", "i_n", (F.col("rank") > F.col("slack")).alias("short_only"),
                         F.element_at("i_words", at + 1).alias("first"),
                         F.concat_ws(" ", F.slice("i_words", at + 1, SHINGLE)).alias("shingle"))
    return each.groupBy("i_key", "i_n", "first", "shingle").agg(F.min("short_only").alias("short_only"))  # equal ones once


def probe_hits(docs: DataFrame, it: DataFrame, n_probes: int) -> DataFrame:
    """``doc_id, text_key, i_key, low, high``: the window starts around every probe, one row per distinct range.

    The probes are broadcast in blocks of about ``BLOCK_PROBES``; the documents'
    words stay inside one code-generated stage, only ranges leave it.
    """
    src = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.select("doc_id", F.md5("text").alias("text_key"), words(F.col("text")).alias("ws"))
    passes = max(1, math.ceil(n_probes / BLOCK_PROBES))
    out = None
    for k in range(passes):
        part = it if passes == 1 else it.where(F.pmod("i_key", F.lit(passes)) == k)
        rows = src.select("doc_id", "text_key", "ws", F.posexplode("ws").alias("pos", "word"))
        size = F.least(F.lit(SHINGLE), F.col("i_n"))
        hit = rows.join(F.broadcast(probes(part)), (F.col("word") == F.col("first"))
                        & (~F.col("short_only") | (F.size("ws") < F.col("i_n")))
                        & (F.concat_ws(" ", F.slice("ws", F.col("pos") + 1, size)) == F.col("shingle")))
        # every start whose window holds the probe; a document shorter than the item has one window
        last = F.greatest(F.size("ws") - F.col("i_n"), F.lit(0))
        low = F.least(F.greatest(F.col("pos") + size - F.col("i_n"), F.lit(0)), last)
        hit = hit.select("doc_id", "text_key", "i_key", low.alias("low"), F.least(F.col("pos"), last).alias("high"))
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def merged_ranges(hits: DataFrame) -> DataFrame:
    """``text_key, i_key, low, high``: disjoint ranges of starts of a text for an item."""
    each = hits.select("text_key", "i_key", "low", "high").distinct()
    order = Window.partitionBy("text_key", "i_key").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("fresh", F.when(before >= F.col("low") - 1, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("text_key", "i_key", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def marked(text: DataFrame, ranges: DataFrame) -> DataFrame:
    """The texts whose key's bit is set in a bitmap of the ranges' keys, so that few others enter the join. The bitmap is
    broadcast: at most ``MARK_BUCKETS`` rows of 4 kB, whatever the number of keys."""
    def place(key):
        return F.pmod(F.xxhash64(key), F.lit(MARK_BUCKETS * 32_768))
    bits = ranges.select(place("text_key").alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    each = text.withColumn("at", place("text_key")).withColumn("bucket", F.bitmap_bucket_number("at")).withColumn("bit", F.bitmap_bit_position("at"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
    held = each.join(F.broadcast(bits), "bucket").withColumn("byte", byte)
    return held.where("(shiftright(byte, cast(bit % 8 as int)) & 1) = 1").select("text", "text_key")


def shingle_rows(docs: DataFrame, ranges: DataFrame, it: DataFrame) -> DataFrame:
    """``rid, pos, h, m, size, i_size``: the shingles of every range, hashed once, with the item's multiplicity of each (null: none)."""
    text = docs.select(F.col("text").cast("string").alias("text")).withColumn("text_key", F.md5("text"))
    held = marked(text, ranges).dropDuplicates(["text_key"])  # no semi-join here: it would be pushed below the bitmap
    known = it.select("i_key", "i_n", F.size("i_hashes").alias("i_size"))
    part = held.withColumn("ws", words(F.col("text"))).join(ranges, "text_key").join(known, "i_key")
    ctx = F.slice("ws", F.col("low") + 1, F.col("high") - F.col("low") + F.col("i_n"))
    hashed = part.select("rid", "i_key", "i_size", shingle_hashes(ctx, F.least(F.lit(SHINGLE), F.col("i_n"))).alias("c"))
    rows = hashed.select("rid", "i_key", "i_size", F.least(F.size("c"), F.col("i_size")).alias("size"), F.posexplode("c").alias("pos", "h"))
    grams = it.select("i_key", F.explode("i_hashes").alias("h")).groupBy("i_key", "h").agg(F.count(F.lit(1)).alias("m"))
    return rows.join(grams, ["i_key", "h"], "left").select("rid", "pos", "h", "m", "size", "i_size")


def full_windows(rows: DataFrame, threshold: float) -> DataFrame:
    """``rid, s, size, i_size``: the starts whose window holds enough shingles of the item, from running sums."""
    upto = Window.partitionBy("rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    one = F.col("m").isNotNull().cast("int")
    sums = rows.select("rid", "pos", "size", "i_size", F.sum(one).over(upto).alias("upto"), one.alias("one"))
    ends = sums.select("rid", F.col("pos").alias("e"), F.col("upto").alias("at_end"))
    starts = sums.select("rid", F.col("pos").alias("s"), "size", "i_size", (F.col("upto") - F.col("one")).alias("ahead"),
                         (F.col("pos") + F.col("size") - 1).alias("e"))
    need = F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("i_size")) - F.lit(1e-9)
    return starts.join(ends, ["rid", "e"]).where(F.col("at_end") - F.col("ahead") >= need).select("rid", "s", "size", "i_size")


def fingerprints(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rid, s, size, i_size, fp, common``: fingerprint of every window, and its shingles in common with the item."""
    each = starts.select("rid", "s", "size", "i_size", F.explode(F.sequence("s", F.col("s") + F.col("size") - 1)).alias("pos"))
    counted = each.join(rows.select("rid", "pos", "h", "m"), ["rid", "pos"]).groupBy("rid", "s", "size", "i_size", "h").agg(
        F.count(F.lit(1)).alias("c"), F.first("m").alias("m"))
    ones = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1)) * F.col("c")).alias(f"b{b}") for b in range(64)]
    sums = counted.groupBy("rid", "s", "size", "i_size").agg(F.sum(F.least("c", F.coalesce("m", F.lit(0)))).alias("common"), *ones)
    fp = F.lit(0).cast("bigint")
    for b in range(64):
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(b))
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("size"), bit).otherwise(F.lit(0).cast("bigint")))
    return sums.select("rid", "s", "size", "i_size", "common", fp.alias("fp"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_key, item_id, start, similarity, distance``: the best window of every leak."""
    it = items(benchmark, threshold)
    n_probes = it.agg(F.sum(F.col("short_slack") + 1)).first()[0] or 0  # bounds what one pass broadcasts
    hits = stash(probe_hits(docs, it, n_probes))
    ranges = stash(merged_ranges(hits).withColumn("rid", F.monotonically_increasing_id()))
    rows = stash(shingle_rows(docs, ranges, it))
    w = fingerprints(rows, full_windows(rows, threshold)).join(ranges.select("rid", "text_key", "i_key", "low"), "rid")
    left = w.withColumn("b", F.explode(blocks(F.col("fp"), radius)))
    right = it.select("item_id", F.col("i_key").alias("r_key"), "i_fp", F.explode(blocks(F.col("i_fp"), radius)).alias("rb"))
    pairs = left.join(right, (left.i_key == right.r_key) & (F.col("b.block") == F.col("rb.block"))
                      & (F.col("b.value") == F.col("rb.value")))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("i_fp")))
    score = F.col("common") / (F.col("size") + F.col("i_size") - F.col("common"))
    near = pairs.where(apart <= radius).select("text_key", "item_id", (F.col("low") + F.col("s")).alias("start"),
                                               apart.alias("distance"), score.alias("similarity")).where(F.col("similarity") >= threshold)
    best = near.groupBy("text_key", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("distance")).alias("d"))).alias("m"))
    owners = hits.select("doc_id", "text_key").distinct()
    return owners.join(best, "text_key").select("doc_id", "text_key", "item_id", (-F.col("m.s")).cast("long").alias("start"),
                                                F.col("m.similarity").alias("similarity"), (-F.col("m.d")).cast("int").alias("distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept."""
    bad = find_leaks(docs, benchmark).select("text_key").distinct()
    return docs.join(bad, F.md5(docs["text"].cast("string")) == bad.text_key, "left_anti")
