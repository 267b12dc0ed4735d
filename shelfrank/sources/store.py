"""Model artefacts as Parquet tables: versions with a manifest, plain save / load; catalog files with stable row numbers."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.catalog import map_schema
from ..schemas import DEFAULT_WEIGHTS, SIGNALS


def read_raw_catalog(spark: SparkSession, path: str, fmt: str = "csv", custom_mapping: dict | None = None,
                     schema=None) -> DataFrame:
    """Raw catalog scan (CSV with header by default, or parquet/json/orc),
    mapped to the standard names, with the file row order as ``ordinal`` (``number_rows``)."""
    if not path:
        raise ValueError("a catalog path is required")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)
    return map_schema(number_rows(df), custom_mapping)


def number_rows(scan: DataFrame, column: str = "ordinal") -> DataFrame:
    """Number the rows of a file scan by file name and place in the file, from 0 without gaps.

    A split gives its rows consecutive numbers; the rows of the splits before it (a running sum over one row per split) come on
    top. The result does not depend on where the files are split, nor on which splits share a task.
    """
    rows = scan.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
                       F.monotonically_increasing_id().alias("__m"))
    splits = rows.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__lo"))
    before = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.select("__f", "__b", "__lo", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"))
    return rows.join(splits, ["__f", "__b"]).withColumn(column, F.col("__at") + F.col("__m") - F.col("__lo")) \
        .drop("__f", "__b", "__m", "__lo", "__at")


def write_catalog(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a catalog; CSV keeps the blanks around values."""
    w = df.write.mode("overwrite")
    (w.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
     if fmt == "csv" else w.format(fmt).save(path))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, buckets: int = 16) -> int:
    """Write a new version of all tables and make it the current one; its number.

    Tables with an entry in ``keys`` are bucketed and sorted by that column. The version's files are complete before its
    manifest appears under its name (a rename), so a reader sees the old version or the new one, never a mixture.
    """
    version = (current_version(spark, root) or 0) + 1
    folder = f"{root.rstrip('/')}/v{version}-{uuid.uuid4().hex[:8]}"
    described = {}
    for name, df in tables.items():
        key = (keys or {}).get(name)
        if key:
            table = f"shelfrank_{uuid.uuid4().hex}"
            df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}").format("parquet").saveAsTable(table)
            spark.sql(f"DROP TABLE {table}")  # the name only: the files are the version's
        else:
            df.write.parquet(f"{folder}/{name}")
        described[name] = {"path": f"{folder}/{name}", "key": key, "buckets": buckets if key else None,
                           "columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields]}
    half, fs = _fs(spark, f"{root.rstrip('/')}/manifests/.{version}-{uuid.uuid4().hex}")
    out = fs.create(half)
    out.write(bytearray(json.dumps(described).encode()))
    out.close()
    if not fs.rename(half, _fs(spark, f"{root.rstrip('/')}/manifests/{version}.json")[0]):
        raise RuntimeError(f"version {version} of {root} was published by somebody else")
    return version


def current_version(spark: SparkSession, root: str) -> int | None:
    p, fs = _fs(spark, f"{root.rstrip('/')}/manifests")
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=None)


def open_version(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version (default: the current one). Bucketed tables keep their layout: joins and aggregates on the key
    need no shuffle of them."""
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"No published version at {root}")
    text = spark.read.text(f"{root.rstrip('/')}/manifests/{version}.json", wholetext=True).first()[0]
    out = {}
    for name, d in json.loads(text).items():
        if not d["key"]:
            out[name] = spark.read.parquet(d["path"])
            continue
        table = f"shelfrank_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{c}` {t}" for c, t in d["columns"])
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{d['key']}`) SORTED BY (`{d['key']}`) "
                  f"INTO {d['buckets']} BUCKETS LOCATION '{d['path']}'")
        out[name] = spark.table(table)
    return out


def save_artifacts(path: str, **tables: DataFrame) -> None:
    """Write every named table under ``path/<name>`` as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there; any other problem (damage, access) is left to the reader."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_artifacts(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    out = {}
    for n in names:
        p = os.path.join(path, n)
        if not _exists(spark, p):
            raise FileNotFoundError(f"Model artifact not found at {p}")
        out[n] = spark.read.parquet(p)
    return out


def save_weights(spark: SparkSession, path: str, weights: dict) -> None:
    spark.createDataFrame([tuple(float(weights[s]) for s in SIGNALS)], [f"w_{s}" for s in SIGNALS]) \
        .write.mode("overwrite").parquet(os.path.join(path, "weights"))


def load_weights(spark: SparkSession, path: str) -> dict:
    """Stored weights, or the defaults when none were saved."""
    stored = os.path.join(path, "weights")
    if not _exists(spark, stored):
        return dict(DEFAULT_WEIGHTS)
    r = spark.read.parquet(stored).first()
    return {s: r[f"w_{s}"] for s in SIGNALS}
