from pyspark.sql import functions as F

from shelfrank.operators import browse
from shelfrank.operators.requests import normalize_requests, parse_request_json, request_outcomes


def test_get_products_pagination(small_catalog):
    small_catalog = small_catalog.withColumn("image_url", F.lit("https://images.example.com/x.jpg"))
    rows = browse.get_products(small_catalog, category="electronics", page=9, limit=2).collect()
    # 3 electronics products -> 2 pages; page clamps to 2, which holds the third product
    assert [r.product_id for r in rows] == ["P104"]
    assert (rows[0].total_items, rows[0].page, rows[0].total_pages) == (3, 2, 2)
    hits = browse.get_products(small_catalog, search="BLUETOOTH", limit=100).collect()
    assert sorted(r.product_id for r in hits) == ["P101", "P102", "P104"]


def test_parse_and_validate_request_json(spark):
    bodies = spark.createDataFrame([
        (1, '{"user_id": " u1 ", "top_k": "99", '
            '"weights": {"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15}}'),
        (2, '{"weights": {"content": 0.9, "collaborative": 0.9, "nlp": 0.1, "image": 0.1}}'),
        (3, "{not json"),
        (4, '{"top_k": "many"}'),
        (5, '{"top_k": "-4", "weights": {"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15, "x": 0}}'),
        (6, '{"top_k": "-4"}'),
    ], "request_id long, body string")
    ok, bad = parse_request_json(bodies)
    assert [(b.request_id, b.code) for b in bad.collect()] == [(3, "INVALID_JSON")]
    r = {row.request_id: row for row in normalize_requests(ok).collect()}
    assert r[1].user_id == "U1" and r[1].top_k == 99 and r[1].status == "accepted"
    assert r[2].status == "rejected" and r[2].code == "INVALID_WEIGHTS"
    assert r[4].top_k == 10 and r[6].top_k == 1
    assert r[5].code == "INVALID_WEIGHTS"  # a key that is no signal
    assert normalize_requests(ok, max_top_k=50).where("request_id = 1").first().top_k == 50


def test_request_outcomes(spark, small_catalog):
    w = '"weights": {"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15}'
    bodies = spark.createDataFrame([
        (1, '{"query": "  "}', "search"), (2, '{"query": "x"}', "search"), (3, '{"product_id": "p101"}', "similar"),
        (4, '{"product_id": "P999"}', "similar"), (5, '{%s}' % w, "hybrid"), (6, '{"weights": {"content": 1.0}}', "hybrid"),
        (7, "[", "hybrid"), (8, '{}', "similar")], "request_id long, body string, endpoint string")
    got = {r.request_id: r.code for r in request_outcomes(bodies, small_catalog).collect()}
    assert got == {1: "MISSING_QUERY", 2: None, 3: None, 4: "PRODUCT_NOT_FOUND", 5: None, 6: "INVALID_WEIGHTS",
                   7: "INVALID_JSON", 8: "PRODUCT_NOT_FOUND"}


def test_page_limit_has_no_hidden_ceiling(spark):
    cat = spark.range(1, 301).select(F.concat(F.lit("P"), F.col("id")).alias("product_id"), F.lit("n").alias("product_name"),
                                     F.lit("c").alias("category"), F.lit("d").alias("description"), F.lit(1.0).alias("price"),
                                     F.lit(1.0).alias("rating"), F.lit("u").alias("image_url"), F.col("id").alias("ordinal"))
    assert browse.get_products(cat, limit=250).count() == 250
    assert browse.get_products(cat, limit=250, max_limit=100).count() == 100
    deep = browse.get_products(cat, page=29, limit=10)
    assert sorted(int(r.product_id[1:]) for r in deep.collect()) == list(range(281, 291))
    assert browse.get_products(cat, search="nowhere").count() == 0
