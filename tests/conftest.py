import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shelfrank.session import DEFAULT_CONF, ensure_checkpoint_dir
    b = (SparkSession.builder.master("local[4]").appName("shelfrank-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="shelfrank-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture()
def dirty_raw(spark):
    """Four dirty raw rows: duplicate id, HTML, null category, negative price,
    rating above 5, null price and rating (source alias names)."""
    rows = [
        ("P001", "  Wireless Bluetooth Earbuds <p>Best Quality</p> ", "electronics",
         "Crystal clear sound with noise reduction.", 49.99, 4.5, "http://images.example.com/p001.jpg", 0),
        ("P001", "  Wireless Bluetooth Earbuds <p>Best Quality</p> ", "electronics",
         "Crystal clear sound with noise reduction.", 49.99, 4.5, "http://images.example.com/p001.jpg", 1),
        ("P002", "Cotton Graphic T-Shirt", None, "", -12.0, 6.2, "invalid_path", 2),
        ("P003", "Stainless Steel Water Bottle", "Home & Kitchen", "1 Litre insulated water flask.", None, None,
         "https://images.example.com/p003.jpg", 3),
    ]
    schema = ("item_id string, product_title string, product_category string, product_description string, "
              "unit_price double, stars double, imageURL string, ordinal long")
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def small_catalog(spark):
    rows = [
        ("P101", "Wireless Noise Cancelling Headphones", "Electronics",
         "Over-ear bluetooth headphones with active noise cancellation", 199.0, 4.5, 0),
        ("P102", "Bluetooth Earbuds Pro", "Electronics", "In-ear wireless earbuds with noise cancellation", 129.0, 4.2, 1),
        ("P103", "Cotton Hoodie", "Apparel", "Soft fleece lined cotton hoodie", 49.0, 4.0, 2),
        ("P104", "Wireless Speaker", "Electronics", "Portable bluetooth speaker with deep bass", 89.0, 4.8, 3),
    ]
    return spark.createDataFrame(rows, "product_id string, product_name string, category string, "
                                       "description string, price double, rating double, ordinal long")


@pytest.fixture()
def small_interactions(spark):
    rows = [("U1", "P101", 5.0), ("U1", "P102", 4.0), ("U2", "P101", 4.5), ("U2", "P103", 5.0),
            ("U3", "P102", 4.0), ("U3", "P103", 4.0), ("U3", "P104", 5.0)]
    return spark.createDataFrame(rows, "user_id string, product_id string, user_rating double")
