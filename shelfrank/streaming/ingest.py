"""Streaming rating ingest: the mean-rating table maintained from a stream.

Interactions arriving on a Structured Streaming source are cleaned exactly
like the batch path (three columns, no nulls, normalised ids) and folded into
per-(user, product) running ``sum`` / ``count`` state with a streaming
aggregation; the mean is the batch ``rating_table`` at every trigger. The
``foreachBatch`` sink writes the changed pairs of each micro-batch into a
Parquet table keyed by the batch id, so a restarted query (state and offsets
in its checkpoint location) replays idempotently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.collab import clean_interactions


def streaming_ratings(stream: DataFrame) -> DataFrame:
    """Streaming ``(user_id, product_id, n, r)``; use output mode ``update``."""
    c = clean_interactions(stream)
    return c.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("user_rating").alias("r"))


def write_rating_updates(ratings_stream: DataFrame, out_path: str, checkpoint: str, trigger_once: bool = True):
    """Start the update stream; each micro-batch's changed pairs are appended
    under ``out_path/batch_id=<id>`` (overwrite of that partition only)."""
    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = ratings_stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def latest_ratings(spark, out_path: str) -> DataFrame:
    """Current mean rating per pair: the row of the latest batch per pair."""
    u = spark.read.parquet(out_path)
    latest = u.groupBy("user_id", "product_id").agg(F.max(F.struct("batch_id", "r", "n")).alias("s"))
    return latest.select("user_id", "product_id", F.col("s.r").alias("r"), F.col("s.n").alias("n"))
