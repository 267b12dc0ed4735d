"""Catalog browsing: category / keyword filters, pagination and id lookups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_term, norm_id
from .order_stats import rows_at

BROWSE_COLUMNS = ["product_id", "product_name", "category", "description", "price", "rating", "image_url"]


INDEX_PARTS = 64


def _searched():
    return F.lower(F.concat_ws("\n", F.coalesce("product_name", F.lit("")), F.coalesce("description", F.lit(""))))


def keyword_index(catalog: DataFrame) -> DataFrame:
    """Trigram postings ``(part, gram, product_id)`` of names and descriptions, lower-cased. Stored partitioned by ``part``, a
    search reads the parts and row groups of its own grams only (``save_index``)."""
    t = _searched()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, 3)))
    rows = catalog.select("product_id", F.explode(grams).alias("gram")).where(F.length("gram") == 3)
    return rows.select(_part(F.col("gram")).alias("part"), "gram", "product_id")


def _part(gram):
    return F.pmod(F.hash(gram), F.lit(INDEX_PARTS)).cast("int")


def save_index(index: DataFrame, path: str) -> None:
    """A hot gram's postings are dealt over several files of its part."""
    index.repartition("part", F.pmod(F.xxhash64("product_id"), F.lit(4))).sortWithinPartitions("part", "gram") \
        .write.mode("overwrite").partitionBy("part").parquet(path)


def indexed_matches(index: DataFrame, term: str) -> DataFrame | None:
    """Ids that hold every trigram of a literal term; None if the term is too short for the index."""
    low = term.lower()
    grams = sorted({low[i:i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    spark = index.sparkSession
    parts = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_part(F.col("gram"))).distinct().collect()]
    hits = index.where(F.col("part").isin(parts) & F.col("gram").isin(grams))
    return hits.groupBy("product_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("product_id")


def filter_catalog(catalog: DataFrame, category: str | None = None, search: str | None = None,
                   regex: bool = False, index: DataFrame | None = None) -> DataFrame:
    """Case-insensitive category equality (``all`` = no filter) and a keyword
    predicate on name or description (literal by default, regex on request);
    both push down to the scan as plain column predicates. With a ``keyword_index`` a literal term first picks the products
    that hold its trigrams; the predicate verifies them."""
    df = catalog
    if category and category.lower() != "all":
        df = df.where(F.lower(F.col("category")) == F.lit(category.lower()))
    if search and search.strip():
        t = search.strip()
        some = indexed_matches(index, t) if index is not None and not regex else None
        df = df if some is None else df.join(some, "product_id", "left_semi")
        df = df.where(contains_term("product_name", t, regex) | contains_term("description", t, regex))
    return df


def get_products(catalog: DataFrame, category: str | None = None, search: str | None = None,
                 page: int = 1, limit: int = 12, regex: bool = False, order_col: str = "ordinal",
                 max_limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """One page of the filtered catalog in catalog order, with the pagination
    fields ``total_items, page, limit, total_pages`` on every row.

    ``limit`` is at least 1 (``max_limit`` is a ceiling on request), ``page`` within [1, total_pages]. The total
    is one scalar count; the page's rows are found by position (``order_stats.rows_at``): a
    deep page costs what the first one does.
    """
    limit = max(1, int(limit or 12))
    if max_limit is not None:
        limit = min(limit, max_limit)
    df = filter_catalog(catalog, category, search, regex, index)
    total = df.count()
    total_pages = max(1, math.ceil(total / limit))
    page = max(1, min(int(page or 1), total_pages))
    rows = rows_at(df, order_col, "product_id", (page - 1) * limit + 1, min(page * limit, total), total) if total else df
    return rows.select(*BROWSE_COLUMNS).withColumns({
        "total_items": F.lit(total).cast("long"), "page": F.lit(page), "limit": F.lit(limit),
        "total_pages": F.lit(total_pages)})


def pages_by_category(catalog: DataFrame, page: int = 1, limit: int = 12, order_col: str = "ordinal") -> DataFrame:
    """Page ``page`` of every category at once (category compared lower-case),
    with per-category totals; ``row_number() <= page * limit`` is planned as a
    WindowGroupLimit, so a hot category ships at most that many rows."""
    key = F.lower(F.col("category"))
    w = Window.partitionBy(key).orderBy(F.col(order_col).asc(), F.col("product_id").asc())
    hi, lo = page * limit, (page - 1) * limit
    ranked = catalog.withColumn("__pos", F.row_number().over(w)).where(F.col("__pos") <= hi)
    totals = catalog.groupBy(key.alias("category_key")).agg(F.count(F.lit(1)).alias("total_items"))
    out = ranked.where(F.col("__pos") > lo).withColumn("category_key", key).join(totals, "category_key")
    return out.select("category_key", (F.col("__pos") - lo).cast("int").alias("position"), *BROWSE_COLUMNS,
                      "total_items", F.lit(page).alias("page"), F.lit(limit).alias("limit"),
                      F.greatest(F.lit(1), F.ceil(F.col("total_items") / limit)).cast("int").alias("total_pages"))


def lookup_products(catalog: DataFrame, ids: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Point lookups by normalised id; unknown ids come back with ``found = false``.
    The catalog side keeps its first row per id (dedup keep-first)."""
    q = ids.select(F.col(id_col).alias("query_id"), norm_id(id_col).alias("product_id"))
    cat = catalog.select(*BROWSE_COLUMNS, "ordinal")
    first = cat.groupBy("product_id").agg(F.min(F.struct("ordinal", *BROWSE_COLUMNS[1:])).alias("__r"))
    first = first.select("product_id", *[F.col(f"__r.{c}").alias(c) for c in BROWSE_COLUMNS[1:]])
    j = q.join(first, "product_id", "left")
    return j.select("query_id", "product_id", F.col("product_name").isNotNull().alias("found"), *BROWSE_COLUMNS[1:])
