"""SimHash near-duplicates by vantage-point trees.

Fingerprints: XXH64 (seed 42) of every k-word shingle, a bit is set when more
than half of the shingles set it. Distinct fingerprints are partitioned by a small
vantage-point tree: at a node a fingerprint goes left or right of the median Hamming
distance to the node's point; as a *visitor* it also goes to the other side when its distance is
within ``radius`` of the border, since only there can the triangle bound admit a partner (of two
residents the right one visits, so each border is crossed once). In
a shard, residents and visitors are matched by further vantage points (rings of
equal distance; rings more than ``radius`` apart are pruned) down to an exact
comparison. Linked fingerprints are joined per shard into forests, so that a dense
group gives as many edges as members, and the forests into components by
alternating large-star / small-star rounds on Spark.

Defined cases: a null or empty text has fingerprint zero, linked like any other; equal
texts share a fingerprint; rows with null ids take part, and a component's id is its smallest
non-null doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_bytes

SHINGLE = 4
RADIUS = 4
SEED = 42
SAMPLE = 20_000  # fingerprints that the tree's points and medians are taken from
SHARD = 100_000  # residents aimed at per shard (a few MB with their visitors)
BLOCK = 1 << 21  # comparisons held at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text."""
    import xxhash
    words = text_bytes(text).translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total, bits = 0, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):
        top = min(n, at + 65_536)
        h = np.fromiter((digest(b" ".join(words[i:i + shingle]), SEED) for i in range(at, top)), np.uint64, top - at)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += top - at
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.uint64)[0])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _fingerprint_task(shingle):
    def run(batches):
        for batch in batches:
            fps = pa.array([_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (fp as signed 64-bit) of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_fingerprint_task(shingle), "doc_id long, fp long")


def distance(a, b):
    return np.bitwise_count(a ^ b)


def build_tree(sample: np.ndarray, depth: int, rng) -> list:
    """Heap-ordered (point, border) of a tree of ``depth`` levels, fitted on a bounded sample."""
    nodes: list = [None] * (2 ** depth - 1)
    todo = [(0, sample)]
    while todo:
        k, own = todo.pop()
        if k >= len(nodes):
            continue
        pool = own if len(own) else sample
        tries = rng.choice(pool, min(8, len(pool)), replace=False)
        # the point with the widest spread of distances prunes most
        point = max(tries, key=lambda p: float(np.var(distance(pool, p))))
        d = distance(pool, point)
        border = int(np.median(d))
        nodes[k] = (int(point), border)
        todo += [(2 * k + 1, own[distance(own, point) <= border]), (2 * k + 2, own[distance(own, point) > border])]
    return nodes


def shards_of(fps: np.ndarray, nodes: list, radius: int):
    """(index, shard, resident) for every shard a fingerprint lives in or visits."""
    idx, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    depth = (len(nodes) + 1).bit_length() - 1
    points = np.array([n[0] for n in nodes], np.uint64)
    borders = np.array([n[1] for n in nodes], np.int64)
    for _ in range(depth):
        d = distance(fps[idx], points[node]).astype(np.int64)
        left = d <= borders[node]
        # a partner may be across a border that is within the radius; of two residents only the
        # right one has to visit, a visitor (which looks for residents) goes both ways
        cross = np.where(left, ~home & (d + radius > borders[node]), d - radius <= borders[node])
        own, other = np.where(left, 2 * node + 1, 2 * node + 2), np.where(left, 2 * node + 2, 2 * node + 1)
        idx = np.concatenate([idx, idx[cross]])
        node = np.concatenate([own, other[cross]])
        home = np.concatenate([home, np.zeros(int(cross.sum()), bool)])
    return idx, node - len(nodes), home


class Forest:
    """Union-find over 0..n-1, filled with arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self):
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                return p
            p = self.parent = q

    def link(self, a: np.ndarray, b: np.ndarray):
        while len(a):
            p = self.roots()
            ra, rb = p[a], p[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def match(fps: np.ndarray, visitors: np.ndarray, residents: np.ndarray, radius: int, forest: Forest, level: int = 0):
    """Link every visitor and resident (indices) within ``radius``; exact."""
    todo = [(visitors, residents, level)]
    while todo:
        v, r, level = todo.pop()
        if not len(v) or not len(r):
            continue
        if len(v) * len(r) <= BLOCK // 8 or level >= 24:
            step = max(1, BLOCK // len(r))
            for at in range(0, len(v), step):
                part = v[at:at + step]
                i, j = np.nonzero(distance(fps[part][:, None], fps[r][None, :]) <= radius)
                forest.link(part[i], r[j])
            continue
        point = fps[r[(level * 7919) % len(r)]]
        dv, dr = distance(fps[v], point).astype(int), distance(fps[r], point).astype(int)
        by_v, by_r = np.argsort(dv, kind="stable"), np.argsort(dr, kind="stable")
        dv, dr, v, r = dv[by_v], dr[by_r], v[by_v], r[by_r]
        for ring in np.unique(dv):
            own = v[np.searchsorted(dv, ring):np.searchsorted(dv, ring, "right")]
            near = r[np.searchsorted(dr, ring - radius):np.searchsorted(dr, ring + radius, "right")]
            todo.append((own, near, level + 1))


def _match_shard(radius):
    def run(table: pa.Table) -> pa.Table:
        fps, home = table.column("fp").to_numpy(), table.column("home").to_numpy()
        u = fps.view(np.uint64)
        forest = Forest(len(u))
        residents = np.flatnonzero(home)
        match(u, np.arange(len(u)), residents, radius, forest)
        root = forest.roots()
        keep = root != np.arange(len(u))
        return pa.table({"a": fps[keep], "b": fps[root[keep]]})
    return run


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Forest edges ``a, b`` whose closure equals that of all pairs within ``radius``.

    ``distinct`` has one row per fingerprint. The tree is fitted on at most ``sample``
    fingerprints (the lowest hashes); every fingerprint is placed and compared exactly.
    """
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / shard)))))
    if n < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    share = min(1.0, sample / n)
    rows = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample)
    got = np.array([r[0] for r in rows.collect()], np.int64)
    got = got if len(got) else np.array([r[0] for r in distinct.limit(64).collect()], np.int64)
    nodes = build_tree(np.sort(got).view(np.uint64), depth, np.random.default_rng(SEED)) if depth else []

    def place(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            if depth:
                idx, s, home = shards_of(fps.view(np.uint64), nodes, radius)
            else:
                idx, s, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
            yield pa.RecordBatch.from_arrays([pa.array(fps[idx]), pa.array(s), pa.array(home)], names=["fp", "shard", "home"])

    placed = distinct.select("fp").mapInArrow(place, "fp long, shard long, home boolean")
    return placed.groupBy("shard").applyInArrow(_match_shard(radius), "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (a, b) that are not their component's smallest.

    Alternating large-star and small-star.
    Every round only moves edges to smaller nodes; it ends when nothing changes. A node's
    neighbours are reduced by ``min`` and joined back, never collected.
    """
    e = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        e = stash(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Copies meet as one fingerprint (partial aggregation keeps the smallest id and the count), so a
    group of a third of all rows is one row from there on.
    """
    rows = stash(fingerprints(docs, shingle))
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    edges = links(distinct, radius, shard)
    comp = components(edges)
    labelled = distinct.join(comp, distinct.fp == comp.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = labelled.join(lowest, "root").select(F.col("fp").alias("c_fp"), "component_id")
    return rows.join(by_fp, rows.fp == by_fp.c_fp).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of every group of near-duplicates, all columns kept.

    The row with the smallest (doc_id, text hash) stays, null ids last; of wholly repeated (doc_id,
    text) rows one stays. The choice is a ``min`` per component, so a large group is no burden.
    """
    names = docs.columns
    text = F.col("text").cast("string")
    inner = [f"c{i}_" for i in range(len(names))]  # whatever the columns are called, no name clashes
    own = docs.select(*(F.col(c).alias(n) for c, n in zip(names, inner)),
                      F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("id"),
                               F.md5(F.coalesce(text, F.lit(""))).alias("t")).alias("who_"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                      F.md5(F.coalesce(text, F.lit(""))).alias("t"))

    def run(batches):
        for batch in batches:
            fps = pa.array([_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps], names=["id", "t", "fp"])

    rows = stash(src.mapInArrow(run, "id long, t string, fp long").groupBy("id", "t", "fp").agg(F.count(F.lit(1)).alias("n")))
    distinct = stash(rows.select("fp").distinct())
    comp = components(links(distinct, radius))
    who = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("t"))
    rooted = rows.join(comp, rows.fp == comp.node, "left").select(
        F.coalesce("root", "fp").alias("root"), who.alias("who"), F.col("n").alias("copies"))
    chosen = stash(rooted.groupBy("root").agg(F.min(F.struct("who", "copies")).alias("m")).select(
        F.col("m.who").alias("chosen_"), F.col("m.copies").alias("copies_")))
    kept = own.join(chosen, own.who_ == chosen.chosen_)
    single = kept.where("copies_ = 1").select(inner)
    repeated = kept.where("copies_ > 1").dropDuplicates(["chosen_"]).select(inner)
    return single.union(repeated).toDF(*names)
