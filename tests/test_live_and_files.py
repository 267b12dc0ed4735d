"""Streaming state against batch, restarts; row numbers, versions and the keyword index."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import browse, collab, neighbors
from shelfrank.operators.pairs import co_occurrence
from shelfrank.sources import store
from shelfrank.sources import tables as T
from shelfrank.streaming.live import LiveModel


def _new(prefix):
    return tempfile.mkdtemp(prefix=prefix)


def test_live_state_equals_batch_and_replays(spark):
    rows = [[("u1", "a", 5.0), ("u1", "b", 3.0), ("u2", "a", 4.0)], [("u1", "a", 1.0), ("u2", "c", 2.0), ("u3", "b", 4.0), ("u3", "c", 5.0)],
            [("u2", "b", 5.0), ("u4", "c", 1.0), (None, "c", 1.0)]]
    schema = "user_id string, product_id string, user_rating double"
    root = _new("live-")
    model = LiveModel(spark, f"{root}/state", top_k=3, compact=2)
    seen = []
    for i, part in enumerate(rows):  # every run continues from the checkpoint of the last one
        spark.createDataFrame(part, schema).write.parquet(f"{root}/source/part-{i}")
        model.run(spark.readStream.schema(schema).parquet(f"{root}/source/*"), f"{root}/checkpoint").awaitTermination()
        seen += part
        ratings = collab.rating_table(spark.createDataFrame(seen, schema))
        assert {tuple(r) for r in model.ratings().select("user_id", "product_id", "r").collect()} == {tuple(r) for r in ratings.collect()}
        want = {(r.item_i, r.item_j): r.sim for r in collab.item_similarity(ratings).collect()}
        got = {(r.item_i, r.item_j): r.sim for r in model.similarity().collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert os.path.isdir(f"{root}/state/base/batch_id=1")
    # batch 1 runs again, as after a failure: same state, same answers
    before = {name: sorted(map(str, df.collect())) for name, df in (("g", model.gram()), ("a", model.answers()))}
    updates = spark.read.parquet(f"{root}/state/ratings/batch_id=1").collect()
    model.process(spark.createDataFrame(updates, "user_id string, product_id string, n long, r double"), 1)
    assert before == {name: sorted(map(str, df.collect())) for name, df in (("g", model.gram()), ("a", model.answers()))}
    answered = {(r.batch_id, r.user_id) for r in model.answers().collect()}
    assert (2, "U2") not in answered or all(r.rank <= 3 for r in model.answers().collect())


def test_touched_pairs_only(spark):
    df = spark.createDataFrame([("u", f"i{k}", float(k + 1), k < 2) for k in range(6)], "g string, i string, w double, t boolean")
    got = {(r.item_i, r.item_j) for r in co_occurrence(df, "g", "i", "w", touched="t").collect()}
    assert got == {(f"i{a}", f"i{b}") for a in range(6) for b in range(a + 1, 6) if a < 2}


def test_row_numbers_do_not_depend_on_splits(spark, sf_dir):
    path = _new("csv-") + "/raw"
    store.write_catalog(T.raw_catalog(spark, sf_dir).orderBy("ordinal").drop("ordinal").repartition(3), path, "csv")
    found = []
    for size in ("128m", "2k", "7001"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = store.read_raw_catalog(spark, path)
            if size == "2k":
                assert rows.rdd.getNumPartitions() > 4
            found.append([tuple(r) for r in rows.select("ordinal", "product_id", "product_name").orderBy("ordinal").collect()])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2]
    assert [r[0] for r in found[0]] == list(range(len(found[0])))


def test_versions_swap_whole_and_keep_buckets(spark, small_catalog, small_interactions):
    root, small_catalog = _new("versions-"), small_catalog.withColumn("image_url", F.lit("x.jpg"))
    with pytest.raises(FileNotFoundError):
        store.open_version(spark, root)
    ratings = collab.rating_table(small_interactions)
    assert store.publish(spark, root, {"catalog": small_catalog, "ratings": ratings}, {"catalog": "product_id"}, buckets=4) == 1
    old = store.open_version(spark, root)
    assert store.publish(spark, root, {"catalog": small_catalog.limit(2), "ratings": ratings}, {"catalog": "product_id"}, buckets=4) == 2
    assert store.open_version(spark, root)["catalog"].count() == 2
    assert old["catalog"].count() == store.open_version(spark, root, 1)["catalog"].count() == 4
    assert old["ratings"].count() == ratings.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        found = browse.lookup_products(old["catalog"], spark.createDataFrame([(" p101",), ("x",)], "query_id string"))
        assert {(r.product_id, r.found) for r in found.collect()} == {("P101", True), ("X", False)}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange") == 1, plan  # the asked ids only; the catalog stays in its buckets
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_keyword_index_reads_the_terms_parts(spark, sf_dir):
    cat = T.catalog(spark, sf_dir)
    path = _new("index-") + "/i"
    browse.save_index(browse.keyword_index(cat), path)
    index = spark.read.parquet(path)
    for term in ("bolt", "BRAND", "size 1", "zzzz", "a", "l S", "%"):
        a, b = (sorted(map(tuple, browse.filter_catalog(cat, search=term, index=i).select("product_id").collect())) for i in (None, index))
        assert a == b
    plan = browse.indexed_matches(index, "brand")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "gram" in plan.split("PushedFilters")[1]
    assert browse.indexed_matches(index, "ab") is None


def test_nested_audit(spark, small_catalog):
    vecs = spark.createDataFrame([("P101", [1.0, 0.0]), ("P102", [0.9, 0.1]), ("P103", [0.0, 1.0])], "product_id string, embedding array<float>")
    out = {r.target_product_id: r.top_visual_matches for r in neighbors.visual_query_audit(vecs, small_catalog, 4, 2).collect()}
    assert [m.product_id for m in out["P101"]] == ["P102", "P103"] and out["P104"] == []
    assert out["P101"][0].same_category and not out["P101"][1].same_category


def test_missing_columns_and_empty_table(spark, small_catalog):
    from shelfrank.operators import quality
    r = quality.validate_dataset(small_catalog.drop("price", "rating").where(F.lit(False))).first()
    assert (r.passed, r.total_rows, r.missing_columns) == (False, 0, ["price", "rating"])
