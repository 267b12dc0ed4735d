"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.session import ensure_checkpoint_dir, ship_package


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Make the package importable on workers and bound what a Python worker holds at once.

    Spark's default of 10,000 rows a batch is a lot for whole texts; a session that sets its own
    number keeps it.
    """
    ship_package(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, in a prepared session."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor re-reads the table, nothing upstream runs again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/shelfrank-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, key: Column, size: int) -> DataFrame:
    """At most ``size`` rows, about 0.95 ``size`` of a larger table: those whose key hash is low.

    The same rows every time, and no task or driver sees more than the sample.
    """
    n = df.count()
    if n > size:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * 0.95 * size / n))
    return df.limit(size)


def text_bytes(text) -> bytes:
    """UTF-8 of a text; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def texts(column) -> list:
    """Python strings (or None) of an Arrow column."""
    return column.to_pylist()


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; a null value counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def crc_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
