"""Blocked collaborative scoring: ``pred = (R+ · Sᵀ) / (B+ · |S|ᵀ)`` by tiles.

The prediction for every (user, item) is a sparse matrix product whose
result is close to dense (each user reaches most items through two hops), so
routing every partial product through a shuffle + hash aggregate moves
``sum_j deg(j)`` rows per user. Here the product is tiled instead:

* users are hashed into ``bu`` blocks, target items ``i`` into ``bi`` blocks;
* the positive ratings ``(u, j, r)`` are replicated to the ``bi`` item blocks,
  the similarity rows ``(j, i, s)`` to the ``bu`` user blocks, and every
  ``(user block, item block)`` tile is one cogroup task on integer ids;
* the tile multiplies with NumPy (ragged gather over ``j`` + ``bincount``
  into a dense users x items-of-the-tile array, processed in user chunks so
  memory stays bounded) and emits only each user's top-``n`` unrated items
  of the tile plus the explicitly requested ``(user, item)`` scores.

Block counts are chosen from measured sizes so that the replicated volume
``|R+|·bi + |S|·bu`` is least and each tile's rows and products stay in a fixed budget; the final top-n
per user merges at most ``bi · n`` rows per user with a WindowGroupLimit.

Heavy users. A user with over ``HEAVY_USER`` ratings would sit whole in every tile of its user block. Its ratings are
hashed by rated item instead: a tile ``(rated-item block, item block)`` gives partial ``num`` and ``den`` per
(user, item), which Spark adds before the ranking. Similarity rows meet such tiles once, without copies.

Versions. Several models over the same users and items (one per evaluation seed) share the gather: ratings
and similarities carry one column per version, a tile builds its index once and adds every version's products.

Ranking and tie rule are the same as the relational path: rounded (4 dp)
score descending, then product id (item ids increase with it).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import top_cells

OUT_SCHEMA = "user_id long, iid long, pred double, kind int, version int"
PARTIAL_SCHEMA = "user_id long, iid long, version int, num double, den double"
TOP, WANT = 0, 1
_CHUNK_CELLS = 4_000_000  # dense cells per user chunk inside a tile, over all versions
_GATHER_SLICE = 8_000_000  # products gathered at once
HEAVY_USER = 200_000


def _frame(users, items, pred, kind: int, version: int) -> pd.DataFrame:
    n = len(items)
    return pd.DataFrame({"user_id": users, "iid": np.asarray(items, np.int64), "pred": np.asarray(pred, np.float64),
                         "kind": np.full(n, kind, np.int32), "version": np.full(n, version, np.int32)})


class _Gather:
    """The similarity rows of a tile, by rated item, and the sums over them."""

    def __init__(self, right: pd.DataFrame, sims: list[str]):
        self.items, i_code = np.unique(right["item_i"].to_numpy(dtype=np.int64), return_inverse=True)
        self.rated, j_code = np.unique(right["item_j"].to_numpy(dtype=np.int64), return_inverse=True)
        order = np.argsort(j_code, kind="stable")
        self.s_i = i_code[order]
        self.sims = [right[c].to_numpy(dtype=np.float64)[order] for c in sims]
        self.counts = np.bincount(j_code, minlength=len(self.rated))
        self.offs = np.concatenate([[0], np.cumsum(self.counts)[:-1]])

    def sums(self, user: np.ndarray, j: np.ndarray, values: list[np.ndarray], n_users: int):
        """``num`` and ``den`` of every version, users x items flat; ratings that are not positive add nothing.

        The gathered products are added in slices: neither a hot user nor a hot item sets the memory.
        """
        ni = len(self.items)
        num = [np.zeros(n_users * ni) for _ in values]
        den = [np.zeros(n_users * ni) for _ in values]
        lens = self.counts[j]
        cuts = np.searchsorted(np.cumsum(lens), np.arange(_GATHER_SLICE, int(lens.sum()) + 1, _GATHER_SLICE))
        for part in np.split(np.arange(len(j)), np.unique(cuts)):
            n = self.counts[j[part]]
            tot = int(n.sum())
            if not tot:
                continue
            rep = np.repeat(part, n)
            pos = np.arange(tot) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offs[j[part]], n)
            cell = user[rep] * ni + self.s_i[pos]
            for v, sim in enumerate(self.sims):
                r, s = values[v][rep], sim[pos]
                num[v] += np.bincount(cell, weights=s * r, minlength=n_users * ni)
                den[v] += np.bincount(cell, weights=np.abs(s) if len(values) == 1 else np.abs(s) * (r > 0), minlength=n_users * ni)
        return num, den


def _tile_kernel(top_n: int | None, ratings: tuple = ("r",), sims: tuple = ("sim",)):
    """Top-n and requested scores of a tile. A column ``n`` of the left side is every user's own depth."""
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [_frame(np.zeros(0, np.int64), [], [], TOP, 0)]
        if left.empty:
            return out[0]
        kinds = left["kind"].to_numpy()
        users, u_idx = np.unique(left["user_id"].to_numpy(), return_inverse=True)
        item = left["item"].to_numpy(dtype=np.int64)
        rated, wanted = kinds == TOP, kinds == WANT
        w_user, w_item = u_idx[wanted], item[wanted]
        if right.empty:
            return pd.concat([_frame(users[w_user], w_item, np.zeros(len(w_item)), WANT, v) for v in range(len(sims))])
        depth = np.full(len(users), top_n or 0)
        if "n" in left.columns:
            depth[u_idx[rated]] = left["n"].to_numpy()[rated]
        g = _Gather(right, list(sims))
        i_index = pd.Index(g.items)
        u_rated = u_idx[rated]
        r_j = pd.Index(g.rated).get_indexer(item[rated])
        r_own = i_index.get_indexer(item[rated])
        values = [np.nan_to_num(np.maximum(left[c].to_numpy(dtype=np.float64)[rated], 0.0)) for c in ratings]
        w_at = i_index.get_indexer(w_item)
        ni = len(g.items)
        chunk = max(1, _CHUNK_CELLS // max(ni * len(sims), 1))
        for a in range(0, len(users), chunk):
            b = min(len(users), a + chunk)
            inside = (u_rated >= a) & (u_rated < b)
            own = np.flatnonzero(inside & (r_j >= 0))
            num, den = g.sums(u_rated[own] - a, r_j[own], [x[own] for x in values], b - a)
            asked = (w_user >= a) & (w_user < b)
            known = np.flatnonzero(inside & (r_own >= 0))
            for v in range(len(sims)):
                some = den[v] != 0
                pred = np.divide(num[v], den[v], out=np.zeros_like(num[v]), where=some).reshape(b - a, ni)
                if asked.any():
                    at = w_at[asked]
                    score = np.where(at >= 0, pred[w_user[asked] - a, np.maximum(at, 0)], 0.0)
                    out.append(_frame(users[w_user[asked]], w_item[asked], score, WANT, v))
                if top_n:
                    mine = known[values[v][known] > 0]
                    pred[u_rated[mine] - a, r_own[mine]] = -np.inf  # positively rated items
                    # item ids increase with the product id, so the column order is the tie rule
                    uu, ii = top_cells(pred, depth[a:b], positive=True)
                    out.append(_frame(users[uu + a], g.items[ii], pred[uu, ii], TOP, v))
        return pd.concat(out[1:]) if len(out) > 1 else out[0]
    return run


def _partial_kernel(ratings: tuple = ("r",), sims: tuple = ("sim",)):
    """Partial sums of a tile of (rated-item block, item block): the cells that have any."""
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"user_id": np.zeros(0, np.int64), "iid": np.zeros(0, np.int64), "version": np.zeros(0, np.int32),
                              "num": np.zeros(0), "den": np.zeros(0)})
        if left.empty or right.empty:
            return empty
        users, u_idx = np.unique(left["user_id"].to_numpy(), return_inverse=True)
        g = _Gather(right, list(sims))
        j = pd.Index(g.rated).get_indexer(left["item"].to_numpy(dtype=np.int64))
        values = [np.nan_to_num(np.maximum(left[c].to_numpy(dtype=np.float64), 0.0)) for c in ratings]
        ni = len(g.items)
        chunk, out = max(1, _CHUNK_CELLS // max(ni * len(sims), 1)), [empty]
        for a in range(0, len(users), chunk):
            own = np.flatnonzero((u_idx >= a) & (u_idx < a + chunk) & (j >= 0))
            num, den = g.sums(u_idx[own] - a, j[own], [x[own] for x in values], min(chunk, len(users) - a))
            for v in range(len(sims)):
                cell = np.flatnonzero(den[v])
                out.append(pd.DataFrame({"user_id": users[a + cell // ni], "iid": g.items[cell % ni],
                                         "version": np.full(len(cell), v, np.int32), "num": num[v][cell], "den": den[v][cell]}))
        return pd.concat(out)
    return run


TILE_GATHER = 40_000_000  # products summed in one tile
TILE_ROWS = 2_000_000  # rows of either side in one tile
USERS_PER_BLOCK = 20_000


def block_counts(n_ratings: int, n_users: int, n_sim: int, n_items: int, gather: int) -> tuple[int, int]:
    """(bu, bi): the grid that copies least, ``|R| bi + |S| bu``, with every tile in its budget.

    ``gather`` is the measured number of products over all tiles. For T tiles the copies are least at
    ``bi = sqrt(T |S| / |R|)``, so they grow with the square root of the tile count; the number
    of cores plays no part.
    """
    tiles = max(1, math.ceil(gather / TILE_GATHER))
    bi = max(1, round(math.sqrt(tiles * max(1, n_sim) / max(1, n_ratings))), math.ceil(n_sim / TILE_ROWS))
    bi = min(bi, max(1, n_items))
    bu = max(1, math.ceil(tiles / bi), math.ceil(n_ratings / TILE_ROWS), math.ceil(n_users / USERS_PER_BLOCK))
    return min(bu, max(1, n_users)), bi


def item_dictionary(ratings: DataFrame) -> DataFrame:
    """``(product_id, iid)``: a unique 64-bit id per rated item, increasing in
    ``product_id`` order (range-partitioned sort, then
    ``monotonically_increasing_id``: partition index in the high bits, row in
    the low bits), so integer order is the tie-break order. Meant to be
    checkpointed, since the ids depend on the partition layout."""
    return order_preserving_ids(ratings.select("product_id").distinct(), "product_id")


def order_preserving_ids(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key).withColumn("iid", F.monotonically_increasing_id())


def dense_ids(items: DataFrame) -> DataFrame:
    """The stored ids of ``order_preserving_ids`` without gaps, in the same order: small numbers pack well in lists."""
    part, row = F.shiftrightunsigned("iid", 33), F.col("iid").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in items.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before, pairs = 0, []
    for p, n in sizes:
        pairs.append((p, before))
        before += n
    if not pairs:
        return items
    base = F.broadcast(items.sparkSession.createDataFrame(pairs, "__p long, __before long"))
    return items.withColumn("__p", part).join(base, "__p").withColumn("iid", row + F.col("__before")).drop("__p", "__before")


def _block(col: str, n: int):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(n)).cast("int")


def _copies(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def heavy_sums(rated: DataFrame, sim: DataFrame, ratings: list[str], sims: list[str], m: dict) -> DataFrame:
    """``(user_id, iid, version, num, den)`` of users whose ratings are dealt by rated item."""
    bj = max(1, math.ceil(m["r"] / TILE_ROWS), math.ceil(math.sqrt(m["s"] / TILE_ROWS)))
    bi = max(1, math.ceil(m["s"] / (bj * TILE_ROWS)), math.ceil(m["i"] / _CHUNK_CELLS))
    left = rated.withColumn("jb", _block("item", bj)).withColumn("ib", _copies(bi))
    right = sim.withColumn("jb", _block("item_j", bj)).withColumn("ib", _block("item_i", bi))
    part = left.groupBy("jb", "ib").cogroup(right.groupBy("jb", "ib")).applyInPandas(
        _partial_kernel(tuple(ratings), tuple(sims)), PARTIAL_SCHEMA)
    return part.groupBy("user_id", "iid", "version").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def tiled_products(rated: DataFrame, sim: DataFrame, top_n: int | None = None, wants: DataFrame | None = None,
                   depths: DataFrame | None = None, blocks: tuple[int, int] | None = None, heavy: int | None = None,
                   ratings: list[str] = ("r",), sims: list[str] = ("sim",)) -> DataFrame:
    """``(user_id, iid, predicted_score, kind, version, rank)`` on integer ids.

    ``rated`` is ``(user_id, item, *ratings)``, ``sim`` ``(item_j, item_i, *sims)`` with the unit diagonal, ``wants``
    ``(user_id, item)``, ``depths`` ``(user_id, n)``: every user's own list length in place of ``top_n``.
    """
    from ..session import ship_package
    ship_package(rated.sparkSession)
    heavy = HEAVY_USER if heavy is None else heavy
    ratings, sims = list(ratings), list(sims)
    own = rated.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    u = own.agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("most"), F.sum(F.when(F.col("c") > heavy, F.col("c"))).alias("heavy")).first()
    per_j = rated.groupBy("item").agg(F.count(F.lit(1)).alias("r"))
    deg = sim.groupBy("item_j").agg(F.count(F.lit(1)).alias("s"))
    both = per_j.join(deg, per_j.item == deg.item_j, "full")
    m = {k: v or 0 for k, v in both.agg(F.sum("r").alias("r"), F.sum("s").alias("s"), F.sum(F.col("r") * F.col("s")).alias("g"),
                                        F.count("item_j").alias("i")).first().asDict().items()}
    bu, bi = blocks or block_counts(m["r"], u["n"], m["s"], m["i"], m["g"])
    light, partial = rated, None
    if (u["most"] or 0) > heavy:
        big = own.where(F.col("c") > heavy).select("user_id")
        light = rated.join(big, "user_id", "left_anti")
        partial = heavy_sums(rated.join(big, "user_id", "left_semi"), sim, ratings, sims, {**m, "r": u["heavy"]})
    left = light.withColumn("kind", F.lit(TOP))
    if depths is not None:
        left = left.join(depths.select("user_id", F.col("n").cast("long").alias("n")), "user_id", "left").withColumn("n", F.coalesce("n", F.lit(top_n or 0)))
    left = left.withColumn("ub", _block("user_id", bu)).withColumn("ib", _copies(bi))
    if wants is not None:
        own_wants = wants.select("user_id", "item").distinct()
        light_wants = own_wants if partial is None else own_wants.join(big, "user_id", "left_anti")
        left = left.unionByName(light_wants.withColumn("kind", F.lit(WANT)).withColumn("ub", _block("user_id", bu))
                                .withColumn("ib", _block("item", bi)), allowMissingColumns=True)
    right = sim.withColumn("ib", _block("item_i", bi)).withColumn("ub", _copies(bu))
    out = (left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib"))
           .applyInPandas(_tile_kernel(top_n, tuple(ratings), tuple(sims)), OUT_SCHEMA))
    out = out.withColumn("predicted_score", F.round("pred", 4)).drop("pred")
    if partial is not None:
        from ..session import cut_lineage
        score = F.when(F.col("den") != 0, F.round(F.col("num") / F.col("den"), 4)).otherwise(F.lit(0.0))
        full = cut_lineage(partial.select("user_id", "iid", "version", score.alias("predicted_score")))
        cols = ["user_id", "iid", "kind", "version", "predicted_score"]
        if wants is not None:
            versions = own_wants.join(big, "user_id", "left_semi").select(
                "user_id", F.col("item").alias("iid"), F.explode(F.sequence(F.lit(0), F.lit(len(sims) - 1))).alias("version"))
            found = versions.join(full, ["user_id", "iid", "version"], "left")
            out = out.unionByName(found.select("user_id", "iid", F.lit(WANT).alias("kind"), "version",
                                               F.coalesce("predicted_score", F.lit(0.0)).alias("predicted_score")))
        if top_n:
            seen = rated.join(big, "user_id", "left_semi").select("user_id", F.col("item").alias("iid"), F.posexplode(
                F.array(*[F.col(c) for c in ratings])).alias("version", "r")).where("r > 0").drop("r")
            out = out.unionByName(full.where("predicted_score > 0").join(seen, ["user_id", "iid", "version"], "left_anti")
                                  .withColumn("kind", F.lit(TOP)).select(*cols))
    if not top_n:
        return out.withColumn("rank", F.lit(None).cast("int"))
    top = out.where(F.col("kind") == TOP)
    w = Window.partitionBy("user_id", "version").orderBy(F.col("predicted_score").desc(), F.col("iid").asc())
    top = top.withColumn("rank", F.row_number().over(w))
    if depths is None:
        top = top.where(F.col("rank") <= top_n)
    else:
        top = top.join(depths.select("user_id", "n"), "user_id", "left") \
            .where(F.col("rank") <= F.coalesce("n", F.lit(top_n))).drop("n")
    return top.unionByName(out.where(F.col("kind") == WANT).withColumn("rank", F.lit(None).cast("int")))


def tiled_scores(ratings: DataFrame, neighbours_enc: DataFrame, items: DataFrame, top_n: int | None = None,
                 wants: DataFrame | None = None, users: DataFrame | None = None,
                 blocks: tuple[int, int] | None = None, user_ids: DataFrame | None = None,
                 heavy: int | None = None) -> DataFrame:
    """``(user_id, product_id, predicted_score, kind, rank)``: per user the top-``n``
    unrated items with a positive rounded prediction (``kind = 0``) and the
    score of every requested pair in ``wants`` (``kind = 1``, 0.0 when
    unreachable). ``ratings`` is ``(user_id, product_id, r)``;
    ``neighbours_enc`` is ``(item_j, item_i, sim)`` on ids (unit diagonal
    included) and ``items`` is the id dictionary. ``users`` restricts the users; its column ``n``, if there, is every
    user's own list length. ``user_ids`` is the stored ``(user_id, uid)``."""
    from ..session import cut_lineage
    ids = items.select("product_id", F.col("iid").alias("item"))
    rated = ratings.where(F.col("r") > 0)
    depths = None
    if users is not None:
        if "n" in users.columns:
            depths = users.groupBy("user_id").agg(F.max("n").alias("n"))
        rated = rated.join(users.select("user_id").distinct(), "user_id", "left_semi")
    if user_ids is None:
        user_ids = cut_lineage(rated.select("user_id").distinct().withColumn("uid", F.monotonically_increasing_id()))
    named = user_ids.select("user_id", "uid")
    enc = rated.join(ids, "product_id").join(named, "user_id").select(F.col("uid").alias("user_id"), "item", "r")
    enc_wants = lost = None
    if wants is not None:
        # a pair whose item has no id, or whose user has no rating here, cannot be reached: score 0 (added back below)
        w = wants.select("user_id", "product_id").distinct().join(ids, "product_id", "left") \
            .join(rated.select("user_id").distinct().join(named, "user_id"), "user_id", "left")
        reach = F.col("item").isNotNull() & F.col("uid").isNotNull()
        enc_wants = w.where(reach).select(F.col("uid").alias("user_id"), "item")
        lost = w.where(~reach).select("user_id", "product_id", F.lit(0.0).alias("predicted_score"), F.lit(WANT).alias("kind"),
                                      F.lit(None).cast("int").alias("rank"))
    if depths is not None:
        depths = depths.join(named, "user_id").select(F.col("uid").alias("user_id"), "n")
    out = tiled_products(enc, neighbours_enc.select("item_j", "item_i", "sim"), top_n, enc_wants, depths, blocks, heavy)
    out = out.withColumnRenamed("user_id", "uid").join(named, "uid").join(items.select("product_id", "iid"), "iid") \
        .select("user_id", "product_id", "predicted_score", "kind", "rank")
    return out if lost is None else out.unionByName(lost)
