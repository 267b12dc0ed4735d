"""Readers for the driver's parquet tables and the derived catalog views.

The recommendation engine works on two logical tables, a product *catalog* and
a user-product *interaction* log. On the test data they are derived from the
TPC-H-like tables by column expressions only, so every operator's work grows
with the scale factor:

* ``catalog``       one row per ``part``
* ``raw_catalog``   ``catalog`` under source alias names, with injected dirt
* ``interactions``  ``orders`` joined to ``lineitem`` (one row per line)
* ``vectors``       ``embeddings`` keyed by product id (text and image space)
* ``requests``      one hybrid request per ``customer``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pid(col) -> F.Column:
    return F.concat(F.lit("P"), F.col(col).cast("string"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean catalog with ``ordinal`` (natural row order = ``p_partkey``). Joins with it are merge joins: its file is far smaller
    than its rows, so Spark would broadcast a catalog of a million products through the driver."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        _pid("p_partkey").alias("product_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "), k.cast("string")).alias("product_name"),
        F.col("p_type").alias("category"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "), F.col("p_type"),
                 F.lit(" size "), F.col("p_size").cast("string")).alias("description"),
        F.col("p_retailprice").cast("double").alias("price"),
        (F.lit(2.5) + F.pmod(k, F.lit(26)).cast("double") / 10.0).alias("rating"),
        F.concat(F.lit("https://images.example.com/p"), k.cast("string"), F.lit(".jpg")).alias("image_url"),
        k.alias("ordinal"),
    ).hint("merge")


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``catalog`` under alias column names with deterministic dirt.

    ``k % 17 = 0`` null price, ``% 13`` negative price, ``% 11`` rating 6.5,
    ``% 7`` null category, ``% 5`` name wrapped in spaces and ``<b>`` tags,
    ``% 31`` name reduced to ``p_name`` (name duplicates), ``% 19`` bad image
    path, ``% 23`` empty description, ``% 50`` an exact duplicate row.
    """
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base_name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "), k.cast("string"))
    name = (F.when(F.pmod(k, F.lit(31)) == 0, F.col("p_name"))
            .when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit("  "), base_name, F.lit(" <b>Sale</b> ")))
            .otherwise(base_name))
    price = (F.when(F.pmod(k, F.lit(17)) == 0, F.lit(None).cast("double"))
             .when(F.pmod(k, F.lit(13)) == 0, -F.col("p_retailprice"))
             .otherwise(F.col("p_retailprice")))
    rows = p.select(
        _pid("p_partkey").alias("item_id"),
        name.alias("product_title"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.lit(None).cast("string")).otherwise(F.lower(F.col("p_type")))
        .alias("product_category"),
        F.when(F.pmod(k, F.lit(23)) == 0, F.lit(""))
        .otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" size "),
                            F.col("p_size").cast("string"))).alias("product_description"),
        price.alias("unit_price"),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit(6.5))
        .otherwise(F.lit(2.5) + F.pmod(k, F.lit(26)).cast("double") / 10.0).alias("stars"),
        F.when(F.pmod(k, F.lit(19)) == 0, F.lit("invalid_path"))
        .otherwise(F.concat(F.lit("https://images.example.com/p"), k.cast("string"), F.lit(".jpg"))).alias("imageURL"),
        k.alias("ordinal"),
    )
    dups = rows.where(F.pmod(F.col("ordinal"), F.lit(50)) == 0) \
        .withColumn("ordinal", F.col("ordinal") + F.lit(10 ** 9))
    return rows.unionByName(dups)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, product_id, user_rating)``; rating ``1 + floor((qty-1)/10)``."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("user_id"),
        _pid("l_partkey").alias("product_id"),
        (F.lit(1.0) + F.floor((F.col("l_quantity") - 1) / 10).cast("double")).alias("user_rating"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(product_id, category, embedding)`` from ``embeddings``."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(_pid("vec_id").alias("product_id"),
                    F.col("label").cast("string").alias("category"),
                    F.col("embedding"))


def event_ratings(events: DataFrame) -> DataFrame:
    """``(user_id, product_id, user_rating, slice)`` of clicks, views and purchases, batch or stream.

    The product is the number in ``props``, the rating ``1 + floor(value) % 5``; ``slice`` is the third of the month (0 to 2).
    """
    kinds = F.col("event_type").isin("click", "view", "purchase")
    return events.where(kinds).select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("P"), F.get_json_object("props", "$.k")).alias("product_id"),
        (F.lit(1) + F.pmod(F.floor("value"), F.lit(5))).cast("double").alias("user_rating"),
        F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int").alias("slice"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hybrid request per customer, mixing request shapes by ``c_custkey``.

    kind = key % 4: 0 user only, 1 user + product, 2 product + query,
    3 user + product + query. Every 7th user id is unknown (cold start).
    Weights rotate over default / collaborative-heavy / NLP-heavy / null
    (= defaults) / invalid (sum != 1) by key % 5. The reference product is
    ``P{key}``; the query is that product's name. Every 11th request asks for 40 products, the others for 5 to 15. ``query_vec`` is null here: vectors
    come from the text (``operators.encode``) or from the caller.
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    kind = F.pmod(k, F.lit(4))
    wsel = F.pmod(k, F.lit(5))
    uid = F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("U"), (k + F.lit(10 ** 7)).cast("string"))) \
        .otherwise(F.concat(F.lit("U"), k.cast("string")))

    def w(a, b, c_, d, e):
        return (F.when(wsel == 0, F.lit(a)).when(wsel == 1, F.lit(b)).when(wsel == 2, F.lit(c_))
                .when(wsel == 3, F.lit(None).cast("double")).otherwise(F.lit(e)))

    base = c.select(
        k.cast("long").alias("request_id"),
        F.when(kind != 2, uid).alias("user_id"),
        F.when(kind != 0, _pid("c_custkey")).alias("product_id"),
        F.when(F.pmod(k, F.lit(11)) == 5, F.lit(40)).otherwise(F.lit(5) + F.pmod(k, F.lit(3)) * 5).cast("int").alias("top_k"),
        w(0.25, 0.15, 0.15, None, 0.9).alias("w_content"),
        w(0.35, 0.55, 0.25, None, 0.9).alias("w_collaborative"),
        w(0.25, 0.20, 0.50, None, 0.1).alias("w_nlp"),
        w(0.15, 0.10, 0.10, None, 0.1).alias("w_image"),
        kind.alias("_kind"),
    )
    qsrc = catalog(spark, sf_dir).select(F.col("product_id").alias("_qpid"), F.col("product_name").alias("_qname"))
    with_q = base.join(qsrc, F.concat(F.lit("P"), F.col("request_id").cast("string")) == F.col("_qpid"), "left")
    has_q = F.col("_kind") >= 2
    return with_q.select(
        "request_id", "user_id", "product_id",
        F.when(has_q, F.col("_qname")).alias("query"),
        F.lit(None).cast("array<float>").alias("query_vec"),
        "top_k", "w_content", "w_collaborative", "w_nlp", "w_image",
    )
