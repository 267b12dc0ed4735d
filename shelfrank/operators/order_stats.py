"""Exact order statistics without a sort in one task.

A bounded sketch (``percentile_approx``) gives a band of values that must hold the wanted
ranks; one count says how many rows lie below the band, and only the band's distinct values
(about ``4 / ACCURACY`` of the rows, plus one value on either side) are accumulated in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .catalog import attach_row

ACCURACY = 10_000  # the sketch's rank error is at most 1 / ACCURACY of the rows


def exact_percentiles(df: DataFrame, col, qs: list[float]) -> DataFrame:
    """One row ``p0, p1, ...``: linearly interpolated percentiles of a numeric column, null for none.

    Nulls are ignored. The same value as ``percentile``, at position ``(n - 1) q``. The one column is
    materialised first, as it is read three times and what is upstream may be long.
    """
    values = cut_lineage(df.select((F.col(col) if isinstance(col, str) else col).cast("double").alias("v")).where("v IS NOT NULL"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    slack = 2.0 / ACCURACY
    band = values.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [max(0.0, q - slack) for q in qs], ACCURACY).alias("lo"),
        F.percentile_approx("v", [min(1.0, q + slack) for q in qs], ACCURACY).alias("hi"))
    marked = attach_row(counts, band)
    one = []
    for i, q in enumerate(qs):
        lo, hi = F.col("lo")[i], F.col("hi")[i]
        one += [F.max(F.when(F.col("v") < lo, F.col("v"))).alias(f"lo{i}"), F.min(F.when(F.col("v") > hi, F.col("v"))).alias(f"hi{i}")]
    # one more distinct value on either side, as a position may lie between two ranks
    edges = attach_row(band, marked.agg(*one)).select(
        "n", F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q"), F.coalesce(f"lo{i}", F.col("lo")[i]).alias("lo"),
                                F.coalesce(f"hi{i}", F.col("hi")[i]).alias("hi")) for i, q in enumerate(qs))).alias("bands"))
    tagged = attach_row(counts, edges)
    inside = tagged.select("v", "c", "n", F.explode("bands").alias("b")).where("v <= b.hi")
    below = inside.where("v < b.lo").groupBy("b.i").agg(F.sum("c").alias("below")).withColumnRenamed("i", "below_i")
    held = inside.where("v >= b.lo").select("v", "c", "n", "b.i", "b.q")
    run = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("cum", F.sum("c").over(run)).join(F.broadcast(below), F.col("i") == F.col("below_i"), "left")
    ranked = ranked.withColumn("cum", F.col("cum") + F.coalesce("below", F.lit(0)))
    pos = (F.col("n") - 1) * F.col("q")
    picked = ranked.groupBy("i").agg(
        F.first(pos).alias("pos"),
        F.min(F.when(F.col("cum") > F.floor(pos), F.col("v"))).alias("low"),
        F.min(F.when(F.col("cum") > F.ceil(pos), F.col("v"))).alias("high"))
    part = F.col("pos") - F.floor("pos")
    value = F.when(part == 0, F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    return picked.agg(*(F.max(F.when(F.col("i") == i, value)).alias(f"p{i}") for i in range(len(qs))))


def rows_at(df: DataFrame, order_col: str, tie: str, first: int, last: int, total: int) -> DataFrame:
    """The rows at positions ``first..last`` (1-based) in (``order_col``, ``tie``) order, with ``__pos``.

    The sketch bounds the page's ``order_col`` values; only rows in that band are ranked, after
    the count of the rows before it. ``order_col`` is numeric and not null.
    """
    slack = 2.0 / ACCURACY
    at = [max(0.0, (first - 1) / total - slack), min(1.0, last / total + slack)]
    band = df.agg(F.percentile_approx(F.col(order_col).cast("double"), at, ACCURACY).alias("__band"))
    tagged = attach_row(df, band)
    key = F.col(order_col).cast("double")
    before = tagged.where(key < F.col("__band")[0]).agg(F.count(F.lit(1)).alias("__before"))
    near = attach_row(tagged.where(key.between(F.col("__band")[0], F.col("__band")[1])), before)
    w = Window.orderBy(F.col(order_col).asc(), F.col(tie).asc())  # over the band only
    ranked = near.withColumn("__pos", F.row_number().over(w) + F.col("__before"))
    return ranked.where(F.col("__pos").between(first, last)).drop("__band", "__before")
