"""SparkSession construction and lineage helpers.

Everything in the library takes a ``SparkSession`` from the caller; this module
only offers a builder with the settings the operators assume (AQE on, UTC,
ANSI on) and the checkpoint-directory policy: the cluster's
``spark.checkpoint.dir`` is used when set, and a directory is only chosen here
when the session has none (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "shelfrank", extra: dict | None = None) -> SparkSession:
    """Return a session configured for the library (reuses an active one)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("SHELFRANK_DRIVER_MEMORY", "10g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the session's ``spark.checkpoint.dir``; pick one only when it is unset.

    On a cluster the setting names a shared folder and is always honoured; without it
    this raises. The fallback (a fresh folder under the system temp dir) is for
    single-JVM local runs only.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        path = configured
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder they all share")
    else:
        path = fallback or tempfile.mkdtemp(prefix="shelfrank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


# Spark drops the shuffle files of a write when it has ended. Without it they stay until the driver's JVM happens to collect the plan.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the checkpoint folder and return the table.

    Used between the stages of long plans, so that a lost executor re-reads the table, not the scan. A checkpoint
    would hold the same rows uncompressed. Joins with the table are merge joins: a few MB of Parquet can be millions
    of rows, which a broadcast would pass through the driver. The shuffle files of the plan are dropped once the table is there.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfrank-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def stored_in_parts(build, parts: int) -> DataFrame:
    """The union of ``build(0)`` to ``build(parts - 1)``, each stored before the next one starts: the disk that the shuffles of one
    part take is free again for the next."""
    out = cut_lineage(build(0))
    for i in range(1, parts):
        out = out.unionByName(cut_lineage(build(i)))
    return out.hint("merge")


def part_of(key: str, parts: int, part: int):
    """Rows of ``key`` that belong to a part. Seeded: the parts say nothing about the partitions of a shuffle by the same key."""
    return F.pmod(F.xxhash64(F.lit("part"), F.col(key)), F.lit(parts)) == part


def forget(stored: DataFrame) -> None:
    """Delete the files of a table of ``cut_lineage`` that nothing will read again."""
    spark = stored.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


DEAL_ROWS = 5_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by hash of ``key`` in tasks of about ``DEAL_ROWS`` rows, for work that makes many rows of each."""
    return df.repartition(max(1, -(-df.count() // DEAL_ROWS)), key)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shelfrank`` importable in Python workers (pandas UDF kernels are
    pickled by module reference): zip the package once per application and
    register it with ``addPyFile``, which distributes it to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="shelfrank-pkg-"), "shelfrank.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _SHIPPED.add(app)
