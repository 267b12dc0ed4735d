"""Live collaborative state: running ratings, co-occurrence deltas and answers, kept by a stream.

The running mean of every (user, product) is a streaming aggregation (``ingest.streaming_ratings``, update mode). For every
micro-batch ``foreachBatch`` writes three partitions under the batch's id:

* ``ratings``  the pairs that changed, with their new mean and count;
* ``gram``     what the change adds to ``G(i, j) = sum_u r(u,i) r(u,j)`` (and the diagonal): only pairs of items with at least one
  changed rating of the same user are multiplied, with the new and the old ratings;
* ``answers``  top-k recommendations of the batch's users, from the state up to this batch.

Each partition is computed from partitions of earlier batches and the batch's own rows, and overwritten as a whole: a batch
that runs again after a failure or a restart gives the same files. Every ``COMPACT`` batches the deltas so far are summed to a
``base``; readers take the latest base and the deltas behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cf_blocks import order_preserving_ids, tiled_scores
from ..operators.pairs import co_occurrence, mirror
from ..session import cut_lineage
from .ingest import streaming_ratings

COMPACT = 16
_GRAM = "item_i string, item_j string, dot double, batch_id long"
_RATINGS = "user_id string, product_id string, n long, r double, batch_id long"
_ANSWERS = "user_id string, rank int, product_id string, predicted_score double, batch_id long"


def similarities(gram: DataFrame) -> DataFrame:
    """``(item_i, item_j, sim)``, ``item_i < item_j``, of a Gram matrix."""
    norm = gram.where("item_i = item_j").select(F.col("item_i").alias("item"), F.sqrt("dot").alias("norm")).where("norm > 0")
    a = norm.select(F.col("item").alias("item_i"), F.col("norm").alias("a"))
    b = norm.select(F.col("item").alias("item_j"), F.col("norm").alias("b"))
    return gram.where("item_i < item_j").join(a, "item_i").join(b, "item_j").select(
        "item_i", "item_j", (F.col("dot") / (F.col("a") * F.col("b"))).alias("sim")).where("sim <> 0")


class LiveModel:
    """State tables under ``root``; ``top_k`` answers per user."""

    def __init__(self, spark: SparkSession, root: str, top_k: int = 5, compact: int = COMPACT):
        self.spark, self.root, self.top_k, self.compact = spark, root.rstrip("/"), top_k, compact

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def ratings(self, upto: int | None = None) -> DataFrame:
        """``(user_id, product_id, n, r)`` as of a batch (default: now)."""
        u = self._read("ratings", _RATINGS)
        u = u if upto is None else u.where(F.col("batch_id") <= upto)
        last = u.groupBy("user_id", "product_id").agg(F.max(F.struct("batch_id", "n", "r")).alias("s"))
        return last.select("user_id", "product_id", F.col("s.n").alias("n"), F.col("s.r").alias("r"))

    def gram(self, upto: int | None = None) -> DataFrame:
        """``(item_i, item_j, dot)``, ``item_i <= item_j``, as of a batch."""
        deltas, base = self._read("gram", _GRAM), self._read("base", _GRAM)
        if upto is not None:
            deltas, base = deltas.where(F.col("batch_id") <= upto), base.where(F.col("batch_id") <= upto)
        at = base.agg(F.max("batch_id")).first()[0]
        rows = deltas if at is None else deltas.where(F.col("batch_id") > at).unionByName(base.where(F.col("batch_id") == at))
        return rows.groupBy("item_i", "item_j").agg(F.sum("dot").alias("dot"))

    def similarity(self, upto: int | None = None) -> DataFrame:
        """``(item_i, item_j, sim)``, ``item_i < item_j``."""
        return similarities(self.gram(upto))

    def answers(self) -> DataFrame:
        return self._read("answers", _ANSWERS)

    def _deltas(self, changed: DataFrame, before: DataFrame) -> DataFrame:
        """What ``changed`` (user_id, product_id, r) adds to the Gram matrix over the users' ratings ``before``."""
        new, old = changed.select("user_id", "product_id", F.col("r").alias("new")), before.select("user_id", "product_id", F.col("r").alias("old"))
        rows = new.join(old, ["user_id", "product_id"], "full").select(
            "user_id", "product_id", F.col("new").isNotNull().alias("moved"), F.coalesce("new", "old").alias("now"), F.coalesce("old", F.lit(0.0)).alias("was"))
        both = co_occurrence(rows, "user_id", "product_id", ["now", "was"], out_v=["now", "was"], touched="moved")
        own = rows.where("moved").groupBy(F.col("product_id").alias("item_i")).agg(
            F.sum(F.col("now") * F.col("now") - F.col("was") * F.col("was")).alias("dot"))
        return both.select("item_i", "item_j", (F.col("now") - F.col("was")).alias("dot")).unionByName(
            own.select("item_i", F.col("item_i").alias("item_j"), "dot"))

    def process(self, updates: DataFrame, batch_id: int) -> None:
        """One micro-batch of changed ``(user_id, product_id, n, r)``."""
        self._write(updates.select("user_id", "product_id", "n", "r"), "ratings", batch_id)
        changed = self._read("ratings", _RATINGS).where(F.col("batch_id") == batch_id)
        users = changed.select("user_id").distinct()
        before = self.ratings(batch_id - 1).join(users, "user_id", "left_semi")
        self._write(self._deltas(changed, before), "gram", batch_id)
        if self.compact and batch_id % self.compact == self.compact - 1:
            self._write(self.gram(batch_id), "base", batch_id)
        self._write(self.recommend(users, batch_id), "answers", batch_id)

    def recommend(self, users: DataFrame, upto: int | None = None) -> DataFrame:
        """Ranked unrated items of ``users`` from the state as of a batch.

        Ratings and similarities meet in tiles (``cf_blocks``), so no product of the two is ever a row. The similarities are
        stored once: they hold a row per pair of items rated together, however many users rated them."""
        rated = cut_lineage(self.ratings(upto).join(users.select("user_id").distinct(), "user_id", "left_semi"))
        gram = cut_lineage(self.gram(upto))
        items = cut_lineage(order_preserving_ids(gram.where("item_i = item_j").select(F.col("item_i").alias("product_id")), "product_id"))
        unit = gram.where("item_i = item_j AND dot > 0").select("item_i", "item_j", F.lit(1.0).alias("sim"))
        i, j = (items.select(F.col("product_id").alias(f"item_{x}"), F.col("iid").alias(f"__{x}")) for x in "ij")
        near = mirror(similarities(gram)).unionByName(unit).join(i, "item_i").join(j, "item_j")
        near = cut_lineage(near.select(F.col("__j").alias("item_j"), F.col("__i").alias("item_i"), "sim"))
        return tiled_scores(rated, near, items, top_n=self.top_k).select("user_id", "rank", "product_id", "predicted_score")

    def run(self, interactions: DataFrame, checkpoint: str):
        """Start on a stream of ``(user_id, product_id, user_rating)``; ends when what is there has been read."""
        return (streaming_ratings(interactions).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                .foreachBatch(self.process).trigger(availableNow=True).start())
