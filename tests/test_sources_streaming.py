import os
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from shelfrank.sources import images, store
from shelfrank.streaming import ingest


def _png(w, h, rgb=(10, 20, 30)):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))
    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_audit_and_coverage(spark, small_catalog):
    d = tempfile.mkdtemp(prefix="imgs-")
    for name, data in [("p101.png", _png(4, 3)), ("copy.png", _png(4, 3)), ("other.png", _png(2, 2, (1, 2, 3))),
                       ("p102.jpg", b"not really an image")]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    files = images.image_files(spark, d)
    dup = images.image_duplicates(files).collect()
    assert sorted(r.name for r in dup) == ["copy.png", "p101.png"] and {r.n_files for r in dup} == {2}
    s = images.image_summary(files).first()
    assert (s.total_images_scanned, s.unique_image_hashes, s.exact_duplicate_hash_groups) == (4, 3, 1)
    assert set(s.image_formats) == {"PNG", "UNKNOWN"}
    dims = {r.name: (r.width, r.height) for r in images.image_dimensions(spark, d).collect()}
    assert dims["other.png"] == (2, 2) and dims["p102.jpg"] == (-1, -1)
    cov = {r.product_id: r.status for r in images.image_coverage(
        small_catalog.withColumn("image_url", F.lit("https://x/y.jpg")), files).collect()}
    assert cov["P102"] == "present" and cov["P101"] == "url"


def test_artifact_store_roundtrip(spark, small_catalog):
    d = tempfile.mkdtemp(prefix="art-")
    store.save_artifacts(d, catalog=small_catalog)
    assert store.load_artifacts(spark, d, "catalog")["catalog"].count() == 4
    assert store.load_weights(spark, d)["collaborative"] == 0.35  # defaults when none saved
    store.save_weights(spark, d, {"content": .4, "collaborative": .6, "nlp": 0.0, "image": 0.0})
    assert store.load_weights(spark, d)["content"] == 0.4
    try:
        store.load_artifacts(spark, d, "missing")
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass
    with open(os.path.join(tempfile.mkdtemp(prefix="bad-"), "x"), "w") as f:
        f.write("no parquet")
    os.makedirs(os.path.join(os.path.dirname(f.name), "weights"))
    with open(os.path.join(os.path.dirname(f.name), "weights", "part-0.parquet"), "w") as g:
        g.write("damaged")
    with pytest.raises(Exception):  # damage is reported, not replaced by the defaults
        store.load_weights(spark, os.path.dirname(f.name))


def test_csv_catalog_and_interactions(spark, small_catalog):
    d = os.path.join(tempfile.mkdtemp(prefix="csv-"), "c")
    store.write_catalog(small_catalog.drop("ordinal"), d, fmt="csv")
    back = store.read_raw_catalog(spark, d)
    assert back.count() == 4 and back.where("product_id = 'P103'").first().product_name == "Cotton Hoodie"


def test_streaming_ratings_match_batch(spark, small_interactions):
    src = tempfile.mkdtemp(prefix="stream-src-")
    small_interactions.write.mode("overwrite").parquet(os.path.join(src, "part1"))
    spark.createDataFrame([(" u1 ", "p101", 3.0)], small_interactions.schema) \
        .write.mode("overwrite").parquet(os.path.join(src, "part2"))
    stream = spark.readStream.schema(small_interactions.schema).parquet(os.path.join(src, "*"))
    out = tempfile.mkdtemp(prefix="stream-out-")
    q = ingest.write_rating_updates(ingest.streaming_ratings(stream), out, tempfile.mkdtemp(prefix="stream-ckpt-"))
    q.awaitTermination(120)
    got = {(r.user_id, r.product_id): r.r for r in ingest.latest_ratings(spark, out).collect()}
    assert got[("U1", "P101")] == 4.0 and got[("U3", "P104")] == 5.0 and len(got) == 7
