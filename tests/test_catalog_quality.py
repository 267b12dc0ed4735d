from pyspark.sql import functions as F

from shelfrank.functions import text as tx
from shelfrank.operators import catalog as cat_ops
from shelfrank.operators import quality


def test_clean_html(spark):
    df = spark.createDataFrame([("  <h1>Wireless Earbuds</h1> <br> <p>High Quality</p>  ",), (None,)], "s string")
    out = [r[0] for r in df.select(tx.clean_html("s")).collect()]
    assert out == ["Wireless Earbuds High Quality", ""]


def test_title_case_matches_python(spark):
    samples = ["t-shirt men's", "home & kitchen", "3rd-party éclair", "ALL CAPS"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(tx.title_case("s")).collect()]
    assert got == [s.title() for s in samples]


def test_alias_mapping(spark):
    df = spark.createDataFrame([("A100", "Some Title", "Cat", 4.5, "x.jpg")],
                               "asin string, title string, categories string, overall double, imUrl string")
    m = cat_ops.map_schema(df)
    r = m.first()
    assert {"product_id", "product_name", "category", "description", "price", "rating", "image_url",
            "user_id", "user_rating"} <= set(m.columns)
    assert r["product_id"] == "A100" and r["rating"] == 4.5


def test_clean_catalog_reference_fixture(dirty_raw):
    out = cat_ops.clean_catalog(cat_ops.map_schema(dirty_raw), keep_ordinal=True).orderBy("ordinal").collect()
    assert [r.product_id for r in out] == ["P001", "P002", "P003"]
    p1, p2, p3 = out
    assert p1.product_name == "Wireless Bluetooth Earbuds Best Quality"
    assert p1.category == "Electronics" and p1.price == 49.99 and p1.rating == 4.5
    assert p2.category == "Uncategorized" and p2.description == "No description available."
    assert p2.price == 0.0 and p2.rating == 5.0
    assert p2.product_name == "Cotton Graphic T-Shirt"
    assert p3.price == 49.99 and p3.rating == 3.5 and p3.category == "Home & Kitchen"


def test_dedup_keeps_first_by_ordinal(spark):
    df = spark.createDataFrame([("A", "x", 5), ("A", "y", 1), ("B", "x", 3)], "product_id string, product_name string, ordinal long")
    out = cat_ops.remove_duplicates(df).orderBy("ordinal").collect()
    # by id: A keeps ordinal 1 (y), B keeps 3 (x); then by name both survive
    assert [(r.product_id, r.product_name) for r in out] == [("A", "y"), ("B", "x")]


def test_validation_counts(spark):
    clean = spark.createDataFrame([("P1", "Name", "Cat", "Desc", 10.0, 4.0, "http://x/a.jpg")],
                                  "product_id string, product_name string, category string, description string, "
                                  "price double, rating double, image_url string")
    r = quality.validate_dataset(clean).first()
    assert r.passed and r.duplicate_product_ids == 0 and r.invalid_prices == 0
    bad = spark.createDataFrame([("P1", "A", "C", "ok", 10.0, 4.0, "http://x/a.jpg"),
                                 ("P1", "B", "C", "", -10.0, 7.0, "invalid_url")], clean.schema)
    r = quality.validate_dataset(bad).first()
    assert not r.passed
    assert (r.duplicate_product_ids, r.invalid_prices, r.invalid_ratings, r.empty_descriptions,
            r.invalid_image_urls) == (1, 1, 1, 1, 1)


def test_validation_empty_and_missing_columns(spark):
    df = spark.createDataFrame([], "product_id string, price double")
    r = quality.validate_dataset(df).first()
    assert not r.passed and r.total_rows == 0
    assert set(r.missing_columns) == {"product_name", "category", "rating"}


def test_validation_details_rows(spark):
    df = spark.createDataFrame([], "product_id string, price double")
    got = {(r.check, r.message) for r in quality.validation_details(quality.validate_dataset(df)).collect()}
    assert got == {("missing_columns", "ERROR: Missing required schema columns: ['product_name', 'category', 'rating']"),
                   ("total_rows", "ERROR: DataFrame is empty.")}


def test_exact_percentiles(spark):
    import random
    from shelfrank.operators.order_stats import exact_percentiles
    r = random.Random(4)
    for n in (1, 2, 5, 6, 97, 40_000):
        x = [r.choice([r.gauss(0, 1), 1.5, float(r.randrange(50))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double").repartition(5)
        qs = [0.0, 0.25, 0.5, 0.9, 1.0]
        want = df.agg(*(F.percentile("v", F.lit(q)).alias(f"p{i}") for i, q in enumerate(qs))).first()
        assert [round(v, 9) for v in exact_percentiles(df, "v", qs).first()] == [round(v, 9) for v in want]
    empty = exact_percentiles(df.where("false"), "v", [0.5]).collect()
    assert [tuple(e) for e in empty] == [(None,)]


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    import pytest
    from shelfrank import session

    class Conf(dict):
        def get(self, k, d=None):
            return d

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "v double")
    h = {r.bin: r.n for r in quality.histogram(df, "v", 5).collect()}
    assert sum(h.values()) == 6 and h[4] == 1 and h[0] == 2


def test_column_profile(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0)], "s string, d double")
    rows = {r.column_name: r for r in quality.column_profile(df).collect()}
    assert rows["s"].missing == 1 and rows["d"].missing_pct == 50.0
