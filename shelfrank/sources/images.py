"""Image-file sources and audits (Spark ``binaryFile`` / ``image`` readers).

* ``image_files``      jpg/png files under a folder as ``(path, name, length, content)``
* ``image_duplicates`` exact duplicates by MD5 of the bytes, grouped
* ``image_summary``    totals, unique hashes, duplicate groups, formats (magic bytes)
* ``image_coverage``   catalog products vs expected ``{lower(id)}.jpg`` files
* ``image_dimensions`` width / height / channels via the ``image`` source
  (undecodable files come back as -1 or are dropped with ``drop_invalid``)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_GLOB = "*.{jpg,JPG,jpeg,JPEG,png,PNG}"


def image_files(spark: SparkSession, folder: str, glob: str = IMAGE_GLOB) -> DataFrame:
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true") \
        .load(folder)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def _format(content) -> F.Column:
    head = F.hex(F.substring(content, 1, 4))
    return (F.when(head.startswith("FFD8FF"), F.lit("JPEG"))
            .when(head == "89504E47", F.lit("PNG")).otherwise(F.lit("UNKNOWN")))


def image_duplicates(files: DataFrame) -> DataFrame:
    """``(md5, n_files, name)``: one row per file whose bytes hash equals at
    least one other file's. Long form on purpose: a hash shared by a large
    share of all files (a placeholder image) is never gathered into one list."""
    h = files.select(F.md5("content").alias("md5"), "name")
    counts = h.groupBy("md5").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") > 1)
    return h.join(counts, "md5").select("md5", "n_files", "name")


def image_summary(files: DataFrame) -> DataFrame:
    h = files.select(F.md5("content").alias("md5"), _format(F.col("content")).alias("fmt"))
    per = h.groupBy("md5").agg(F.count(F.lit(1)).alias("n"))
    a = h.agg(F.count(F.lit(1)).alias("total_images_scanned"),
              F.array_sort(F.collect_set("fmt")).alias("image_formats"))
    b = per.agg(F.count(F.lit(1)).alias("unique_image_hashes"),
                F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("exact_duplicate_hash_groups"))
    from ..operators.catalog import attach_row
    return attach_row(a, b)


def image_dimensions(spark: SparkSession, folder: str, drop_invalid: bool = False) -> DataFrame:
    img = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(folder)
    return img.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"),
                      F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                      F.col("image.nChannels").alias("n_channels"))


def image_coverage(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """Per product: the expected file ``lower(product_id).jpg`` and a status
    ``present`` (file found), ``url`` (no file, but an http image URL) or
    ``missing``."""
    c = catalog.select("product_id", "image_url",
                       F.concat(F.lower("product_id"), F.lit(".jpg")).alias("expected_file"))
    f = files.select(F.col("name").alias("expected_file")).distinct().withColumn("__hit", F.lit(True))
    j = c.join(f, "expected_file", "left")
    status = (F.when(F.col("__hit"), F.lit("present"))
              .when(F.lower(F.col("image_url")).startswith("http"), F.lit("url")).otherwise(F.lit("missing")))
    return j.select("product_id", "expected_file", status.alias("status"))
