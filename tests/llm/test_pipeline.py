"""The pipeline's stages on planted cases."""

from helpers import no_docs, odd_docs, prose

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stage_order_and_columns(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "benchmark_decontamination", "packing"]
    for make in (odd_docs, no_docs):
        docs = make(spark)
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()


def test_planted_cases(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    passage = prose(700, 60)
    # neighbours of the given documents, so that every stage sees ordinary text as well
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    cols = docs.columns
    planted = [(10_001, prose(1, 150)), (10_002, prose(1, 150)), (10_003, prose(2, 100) + " " + item + " " + prose(3, 100)),
               (10_004, prose(4, 90) + " " + passage), (10_005, prose(5, 90) + " " + passage), (10_006, prose(6, 200))]
    rows = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in planted], docs.schema)
    both = docs.unionByName(rows).select(cols)
    near = P.drop_near_duplicates(spark, both, SF)
    ids = {r["doc_id"] for r in near.select("doc_id").collect()}
    assert {10_001, 10_003, 10_004, 10_005, 10_006} <= ids and 10_002 not in ids
    stripped = {r["doc_id"]: r["text"] for r in P.strip_repeats(spark, rows.where("doc_id <> 10002"), SF).collect()}
    assert passage not in stripped[10_004] + stripped[10_005] and stripped[10_006] == prose(6, 200)
    clean = {r["doc_id"] for r in P.decontaminate_benchmark(spark, rows, SF).collect()}
    assert clean == {10_001, 10_002, 10_004, 10_005, 10_006}
    packed = P.pack_sequences(spark, rows, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in planted}
