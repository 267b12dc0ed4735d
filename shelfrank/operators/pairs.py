"""Skew-safe pair generation for sparse self-products (co-occurrence).

``co_occurrence`` computes, for a long table ``(group, item, w)`` with one row
per (group, item), the sparse Gram matrix ``G(i, j) = sum_g w(g,i) * w(g,j)``
over unordered item pairs ``i < j``. It is the relational form of ``XᵀX``
(item-item through users, document-document through terms).

A naive self-join on ``group`` puts the whole quadratic pair set of a group
in one task. Here every group is cut into ``nb = ceil(n / block_rows)`` item
blocks (by item hash) and the join key is ``(group, left_block, right_block)``
over the upper triangle of block pairs, so no task sees more than
``block_rows²`` pairs however large a group is; small groups (nb = 1) are not
replicated at all. A hot group's size reaches its rows by broadcast, not by a join on the
group, so its rows are split before any shuffle. The sum is then a regular hash aggregate with map-side
partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import attach_row

DEFAULT_BLOCK_ROWS = 512
HOT_SHARE = 100


def with_group_stats(rows: DataFrame, group: str, stats: DataFrame, may_be_hot, size: str | None = None) -> DataFrame:
    """``rows`` joined with the one row per group of ``stats``.

    Groups with over 1/``HOT_SHARE`` of all rows are fewer than ``HOT_SHARE``: their statistics are broadcast, so their rows
    never meet on one join key. ``size`` names the column of ``stats`` that counts a group's rows, if it has one.
    """
    if size is None:
        size = "__n"
        stats = stats.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), group)
    hot = attach_row(stats, rows.agg(F.count(F.lit(1)).alias("__all"))).where(
        (F.col(size) * HOT_SHARE > F.col("__all")) & may_be_hot).drop("__all")
    return rows.join(F.broadcast(hot), group).unionByName(rows.join(F.broadcast(hot.select(group)), group, "left_anti").join(stats.hint("merge"), group))


def co_occurrence(df: DataFrame, group: str, item: str, weight: str | list[str],
                  block_rows: int = DEFAULT_BLOCK_ROWS, out_i: str = "item_i",
                  out_j: str = "item_j", out_v: str | list[str] = "dot", touched: str | None = None) -> DataFrame:
    """Sums of products per item pair. With lists of ``weight`` and ``out_v`` one pass gives one Gram matrix per
    weight column; null weights add nothing. With ``touched`` (a boolean column) only pairs with a touched row are multiplied."""
    weights, outs = ([weight], [out_v]) if isinstance(weight, str) else (list(weight), list(out_v))
    marks = [F.col(touched).alias("__t")] if touched else []
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    d = (with_group_stats(df.select(group, item, *weights, *marks), group, sizes, F.col("__n") > block_rows, size="__n")
         .withColumn("__nb", F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(block_rows))).cast("int"))
         .withColumn("__blk", F.pmod(F.xxhash64(F.col(item)), F.col("__nb")).cast("int")))
    left = d.select(F.col(group).alias("__g"), F.col("__blk").alias("__lb"),
                    F.explode(F.sequence(F.col("__blk"), F.col("__nb") - 1)).alias("__rb"),
                    F.col(item).alias("__li"), *[F.col(w).alias(f"__lw{i}") for i, w in enumerate(weights)],
                    *([F.col("__t").alias("__lt")] if touched else []))
    right = d.select(F.col(group).alias("__g"),
                     F.explode(F.sequence(F.lit(0), F.col("__blk"))).alias("__lb"),
                     F.col("__blk").alias("__rb"),
                     F.col(item).alias("__ri"), *[F.col(w).alias(f"__rw{i}") for i, w in enumerate(weights)],
                     *([F.col("__t").alias("__rt")] if touched else []))
    pairs = left.join(right, ["__g", "__lb", "__rb"]).where(
        (F.col("__lb") < F.col("__rb")) | (F.col("__li") < F.col("__ri")))
    if touched:
        pairs = pairs.where(F.col("__lt") | F.col("__rt"))
    return (pairs.select(F.least("__li", "__ri").alias(out_i), F.greatest("__li", "__ri").alias(out_j),
                         *[(F.col(f"__lw{i}") * F.col(f"__rw{i}")).alias(f"__p{i}") for i in range(len(weights))])
            .groupBy(out_i, out_j).agg(*[F.sum(f"__p{i}").alias(v) for i, v in enumerate(outs)]))


def mirror(pairs: DataFrame, i: str = "item_i", j: str = "item_j", v: str = "sim") -> DataFrame:
    """Upper-triangle pairs -> both orientations (``i -> j`` and ``j -> i``)."""
    return pairs.select(i, j, v).unionByName(pairs.select(F.col(j).alias(i), F.col(i).alias(j), v))
