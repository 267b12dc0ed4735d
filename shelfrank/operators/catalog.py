"""Catalog ETL: schema mapping, keep-first dedup, imputation, clamps, text norm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import (COLUMN_ALIASES, DEFAULT_CATEGORY, DEFAULT_DESCRIPTION, DEFAULT_PRICE,
                       DEFAULT_RATING, STANDARD_COLUMNS, STANDARD_TYPES)


def map_schema(df: DataFrame, custom_mapping: dict | None = None) -> DataFrame:
    """Rename source columns through the alias map (custom entries win), add
    missing standard columns as typed nulls, keep every other column.

    Names are matched case-sensitively in Python over ``df.columns``. Two
    source columns mapping to one target raise ``ValueError``.
    """
    mapping = dict(COLUMN_ALIASES)
    mapping.update(custom_mapping or {})
    targets = [mapping.get(c, c) for c in df.columns]
    dup = {t for t in targets if targets.count(t) > 1}
    if dup:
        raise ValueError(f"Several source columns map to {sorted(dup)}")
    cols = [F.col(f"`{c}`").alias(t) for c, t in zip(df.columns, targets)]
    present = set(targets)
    cols += [F.lit(None).cast(STANDARD_TYPES[c]).alias(c) for c in STANDARD_COLUMNS if c not in present]
    return df.select(*cols)


def dedup_first(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Keep the first row (smallest ``ordinal``) of every ``key`` value; nulls
    form one group.

    ``min(ordinal)`` per key is a hash aggregate with map-side partial aggregation, so a hot key
    collapses before the shuffle; the rows themselves are then picked by a semi-join.
    """
    first = df.groupBy(F.col(key).alias("__key")).agg(F.min(ordinal).alias("__first"))
    on = df[key].eqNullSafe(first["__key"]) & (df[ordinal] == first["__first"])
    return df.join(first, on, "left_semi")


def remove_duplicates(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Sequential keep-first dedup on raw values: by product_id, then product_name."""
    if "product_id" in df.columns:
        df = dedup_first(df, "product_id", ordinal)
    if "product_name" in df.columns:
        df = dedup_first(df, "product_name", ordinal)
    return df


def to_double(df: DataFrame, col: str):
    """Numeric coercion: numbers cast, strings ``try_cast`` (unparsable -> null),
    NaN -> null (pandas treats NaN as missing; Spark orders NaN above all)."""
    dtype = dict(df.dtypes)[col]
    c = F.col(col).cast("double") if dtype != "string" else F.expr(f"try_cast(`{col}` as double)")
    return F.nanvl(c, F.lit(None).cast("double"))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (a global aggregate) to every row.

    Equi-join on a constant key against the broadcast one-row side: the
    broadcast size is bounded by construction (exactly one row).
    """
    return (df.withColumn("__one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("__one", F.lit(1))), "__one")
            .drop("__one"))


def positive_price_median(df: DataFrame) -> DataFrame:
    """One-row frame with the exact median of positive prices (linear interpolation)."""
    from .order_stats import exact_percentiles
    return exact_percentiles(df.where(F.col("__price") > 0), "__price", [0.5]).withColumnRenamed("p0", "__median")


def clean_catalog(raw: DataFrame, ordinal: str = "ordinal", keep_ordinal: bool = False, default_price: float = DEFAULT_PRICE,
                  default_rating: float = DEFAULT_RATING, default_category: str = DEFAULT_CATEGORY,
                  default_description: str = DEFAULT_DESCRIPTION) -> DataFrame:
    """Mapped raw catalog -> clean catalog, in the fixed order: dedup ->
    impute (text clean, defaults, median price, default rating) -> clamp
    (negative price -> 0, rating to [0, 5]) -> id / category normalisation ->
    standard projection.

    ``raw`` must already carry standard names (see ``map_schema``) and an
    ``ordinal`` column giving the source row order. Null ids stay null.
    """
    if ordinal not in raw.columns:
        raw = raw.withColumn(ordinal, F.monotonically_increasing_id())
    df = remove_duplicates(raw, ordinal)
    df = df.withColumns({
        "product_name": tx.clean_name("product_name"),
        "category": tx.clean_category("category", default_category),
        "description": tx.clean_description("description", default_description),
        "image_url": tx.clean_image_url("image_url"),
        "__price": to_double(df, "price"),
        "__rating": to_double(df, "rating"),
    })
    med = positive_price_median(df)
    fill = F.coalesce(F.col("__median"), F.lit(float(default_price)))
    df = attach_row(df, med)
    price = F.coalesce(F.col("__price"), fill)
    price = F.when(price < 0, F.lit(0.0)).otherwise(price)
    rating = F.coalesce(F.col("__rating"), F.lit(float(default_rating)))
    rating = F.least(F.greatest(rating, F.lit(0.0)), F.lit(5.0))
    df = df.withColumns({
        "price": price,
        "rating": rating,
        "product_id": tx.norm_id("product_id"),
        "category": tx.title_case("category"),
    })
    cols = [c for c in STANDARD_COLUMNS if c in df.columns]
    if keep_ordinal:
        cols.append(ordinal)
    return df.select(*cols)
