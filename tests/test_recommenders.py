import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.operators import collab, content, hybrid, neighbors, popular
from shelfrank.operators.pairs import co_occurrence
from shelfrank.operators.requests import requests_frame, validate_weights


def _cf(small_interactions):
    return collab.CollaborativeModel.fit(small_interactions)


def test_item_similarity_golden(small_interactions):
    m = _cf(small_interactions)
    sim = {(r.item_i, r.item_j): round(r.sim, 4) for r in m.similarity.collect()}
    assert sim[("P101", "P102")] == 0.5256
    assert sim[("P101", "P103")] == 0.5224
    assert ("P101", "P104") not in sim  # zero similarity is absent
    assert sim[("P102", "P104")] == 0.7071
    assert sim[("P103", "P104")] == 0.6247


@pytest.mark.parametrize("method", ["tiled", "relational"])
def test_cf_recommendations_golden(small_interactions, small_catalog, method):
    m = _cf(small_interactions)
    recs = m.recommend(small_catalog, top_k=5, method=method).orderBy("user_id", "rank").collect()
    got = {}
    for r in recs:
        got.setdefault(r.user_id, []).append((r.product_id, r.predicted_score))
    assert got["U1"] == [("P103", 4.5418), ("P104", 4.0)]
    assert got["U2"] == [("P104", 5.0), ("P102", 4.7283)]
    assert got["U3"] == [("P101", 4.0)]


def test_tiled_scores_match_relational_on_sample(spark, sf_dir):
    from shelfrank.sources import tables as T
    m = collab.CollaborativeModel.fit(T.interactions(spark, sf_dir))
    rel = {(r.user_id, r.product_id): r.predicted_score for r in collab.predict_scores(m.ratings, m.neighbours).collect()}
    pairs = m.ratings.select("user_id", "product_id")
    tiled = {(r.user_id, r.product_id): r.predicted_score for r in m.scores(pairs).collect()}
    for k, v in tiled.items():
        assert abs(rel.get(k, 0.0) - v) < 1e-9
    a = m.recommend(T.catalog(spark, sf_dir), 5).select("user_id", "rank", "product_id").collect()
    b = m.recommend(T.catalog(spark, sf_dir), 5, method="relational").select("user_id", "rank", "product_id").collect()
    assert sorted(a) == sorted(b)


def test_cf_against_dense_numpy(spark, small_interactions):
    m = _cf(small_interactions)
    users = ["U1", "U2", "U3"]
    items = ["P101", "P102", "P103", "P104"]
    R = np.zeros((3, 4))
    for r in small_interactions.collect():
        R[users.index(r.user_id), items.index(r.product_id)] = r.user_rating
    n = np.linalg.norm(R, axis=0)
    S = (R.T @ R) / np.outer(n, n)
    for r in m.scores(m.ratings.select("user_id", "product_id")).collect():
        u, i = users.index(r.user_id), items.index(r.product_id)
        rated = R[u] > 0
        expect = round(float((S[i, rated] * R[u, rated]).sum() / np.abs(S[i, rated]).sum()), 4)
        assert r.predicted_score == expect


def test_co_occurrence_hot_group_split(spark):
    # one group with 50 items and block_rows=8 -> 7 blocks; pair set must equal the naive one
    rows = [("g", f"i{k:02d}", float(k + 1)) for k in range(50)] + [("h", "i00", 2.0), ("h", "i01", 3.0)]
    df = spark.createDataFrame(rows, "g string, item string, w double")
    got = {(r.item_i, r.item_j): r.dot for r in co_occurrence(df, "g", "item", "w", block_rows=8).collect()}
    assert len(got) == 50 * 49 // 2
    assert got[("i00", "i01")] == 1.0 * 2.0 + 2.0 * 3.0
    assert got[("i10", "i20")] == 11.0 * 21.0


def test_content_similar_products(small_catalog):
    postings, _ = content.tfidf(small_catalog)
    recs = content.recommend_similar(postings, small_catalog, k=3, targets=small_catalog.where("product_id = 'P101'"))
    rows = recs.orderBy("rank").collect()
    assert all(r.product_id != "P101" for r in rows)
    scores = [r.similarity_score for r in rows]
    assert scores == sorted(scores, reverse=True)
    assert rows[0].product_id in {"P102", "P104"}
    assert rows[0].explanation.startswith("Same category ('Electronics')")


def test_content_zero_fill(spark):
    cat = spark.createDataFrame([("A", "alpha beta", "x", "", 1.0, 1.0, 0), ("B", "gamma delta", "y", "", 1.0, 1.0, 1),
                                 ("C", "epsilon zeta", "z", "", 1.0, 1.0, 2)],
                                "product_id string, product_name string, category string, description string, "
                                "price double, rating double, ordinal long")
    postings, _ = content.tfidf(cat)
    recs = content.recommend_similar(postings, cat, k=2).where("target_id = 'A'").orderBy("rank").collect()
    assert [(r.product_id, r.similarity_score) for r in recs] == [("B", 0.0), ("C", 0.0)]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 8)).astype(np.float32)
    vecs[5] = 0.0  # zero vector scores 0
    df = spark.createDataFrame([(f"P{i:02d}", [float(x) for x in v]) for i, v in enumerate(vecs)],
                               "product_id string, vec array<float>")
    top = neighbors.knn(df.select(F.col("product_id").alias("qid"), "vec"), df, 4, exclude_self=True, block_rows=16)
    got = {}
    for r in top.collect():
        got.setdefault(r.qid, []).append((r.rank, r.product_id))
    v = vecs.astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(np.outer(n, n) > 0, (v @ v.T) / np.outer(n, n), 0.0)
    for q in range(60):
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-round(s[q, j], 4), f"P{j:02d}"))[:4]
        assert [p for _, p in sorted(got[f"P{q:02d}"])] == [f"P{j:02d}" for j in order]


def test_category_bias_matches_pairs(spark):
    vec = [([1.0, 0.0, 0.0], "Electronics"), ([0.9, 0.1, 0.0], "electronics"),
           ([0.0, 1.0, 0.0], "Apparel"), ([0.0, 0.9, 0.1], "Apparel")]
    df = spark.createDataFrame([(f"P{i}", c, v) for i, (v, c) in enumerate(vec)],
                               "product_id string, category string, embedding array<float>")
    r = neighbors.category_bias(df).first()
    assert (r.intra_category_mean, r.inter_category_mean, r.category_bias_delta) == (0.9939, 0.055, 0.9388)


def test_partial_lists_round_like_spark(spark):
    from shelfrank.functions.rounding import round_units, top_cells
    x = [3.03125, 3.0312, -3.03125, 0.00005, 0.00004, 2.9999999999999996, 1 / 3, -0.5, 0.12345, 0.123450000001]
    want = [round(r[0] * 10_000) for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 4)).collect()]
    assert round_units(np.array(x)).tolist() == want
    rows, cols = top_cells(np.array([[3.0312, 3.03125, 3.0], [1.0, 1.0, 1.0], [-np.inf, 0.00004, -1.0]]), 1)
    assert (rows.tolist(), cols.tolist()) == ([0, 1, 2], [1, 0, 1])
    assert top_cells(np.array([[-np.inf, 0.00004, -1.0]]), 1, positive=True)[0].tolist() == []
    rng = np.random.default_rng(8)
    s = np.round(rng.random((40, 60)), 3) + rng.choice([0, 5e-5, -5e-5, 1e-9], (40, 60))
    rows, cols = top_cells(s, 7)
    units = round_units(s)
    for i in range(40):
        assert cols[rows == i].tolist() == sorted(range(60), key=lambda j: (-units[i, j], j))[:7]


def test_knn_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    vecs = rng.integers(0, 3, size=(80, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(f"P{i:02d}", v.tolist()) for i, v in enumerate(vecs)], "product_id string, vec array<float>")
    q = df.select(F.col("product_id").alias("qid"), "vec")
    one, many = (sorted(map(tuple, neighbors.knn(q, df, 5, True, b).select("qid", "rank", "product_id").collect())) for b in (1000, 7))
    assert one == many


def test_tiles_do_not_change_the_answer(spark, sf_dir):
    from shelfrank.operators.cf_blocks import tiled_scores
    from shelfrank.sources import tables as T
    m = collab.CollaborativeModel.fit(T.interactions(spark, sf_dir))
    got = [sorted(map(tuple, tiled_scores(m.ratings, m.neighbours_enc, m.items, top_n=4, blocks=b).collect())) for b in ((1, 1), (3, 5))]
    assert got[0] == got[1]


def test_gather_slices_do_not_change_the_answer():
    import pandas as pd
    from shelfrank.operators import cf_blocks
    r = np.random.default_rng(2)
    # user 0 holds a third of the ratings, item 0 is similar to everything
    left = pd.DataFrame({"user_id": ["u0"] * 40 + [f"u{1 + k % 20}" for k in range(80)], "item": [*range(40), *r.integers(0, 60, 80)],
                         "r": 1.0 + r.integers(0, 5, 120), "kind": 0}).drop_duplicates(["user_id", "item"])
    pairs = {(0, i) for i in range(60)} | {tuple(map(int, r.integers(0, 60, 2))) for _ in range(900)}
    right = pd.DataFrame(sorted(pairs), columns=["item_j", "item_i"]).assign(sim=r.random(len(pairs)))
    whole = cf_blocks._tile_kernel(5)((0, 0), left, right)
    cf_blocks._GATHER_SLICE = 50
    try:
        sliced = cf_blocks._tile_kernel(5)((0, 0), left, right)
    finally:
        cf_blocks._GATHER_SLICE = 8_000_000
    assert (whole[["user_id", "iid"]] == sliced[["user_id", "iid"]]).all().all() and np.allclose(whole.pred, sliced.pred)


def test_grid_copies_grow_with_the_square_root():
    from shelfrank.operators.cf_blocks import TILE_GATHER, block_counts
    small = block_counts(10**6, 10**4, 10**6, 10**4, 16 * TILE_GATHER)
    large = block_counts(10**6, 10**4, 10**6, 10**4, 1600 * TILE_GATHER)
    assert small == (4, 4) and large == (40, 40)


def test_visual_lists_are_full_without_catalog_gaps(spark, small_catalog):
    vecs = spark.createDataFrame([(f"P{i}", [float(i), 1.0]) for i in range(90, 130)], "product_id string, embedding array<float>")
    out = neighbors.visual_neighbours(vecs, small_catalog, k=3).collect()
    assert len(out) == 4 * 3 and {r.product_id for r in out} <= {"P101", "P102", "P103", "P104"}


def test_text_encoder(spark):
    from shelfrank.operators import encode
    df = spark.createDataFrame([("a", "Wireless noise cancelling headphones"), ("b", "wireless NOISE cancelling headphones!"),
                                ("c", "cotton hoodie"), ("d", " ")], "id string, t string")
    v = {r.id: np.array(r.embedding) for r in encode.encode_text(df, "id", "t", "id").collect()}
    assert all(len(x) == 384 for x in v.values()) and (v["a"] == v["b"]).all() and not v["d"].any()
    assert v["a"] @ v["c"] < v["a"] @ v["b"]


def test_unknown_products_are_reported(spark, small_catalog):
    postings, _ = content.tfidf(small_catalog)
    ids = spark.createDataFrame([(" p101 ",), ("P999",), (None,)], "product_id string")
    out = content.recommend_for_products(postings, small_catalog, ids, k=2).collect()
    assert sorted((r.target_id, r.status) for r in out) == [("P101", "ok"), ("P101", "ok"), ("P999", "PRODUCT_NOT_FOUND")]


def test_hot_group_sizes_are_broadcast(spark):
    rows = [("g", f"i{k:03d}", 1.0) for k in range(300)] + [(f"u{k}", "i000", 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "g string, item string, w double")
    assert co_occurrence(df, "g", "item", "w", block_rows=32).count() == 300 * 299 // 2


def test_weight_validation():
    assert validate_weights({"content": .25, "collaborative": .35, "nlp": .25, "image": .15})
    with pytest.raises(ValueError, match="must sum to 1.0"):
        validate_weights({"content": .5, "collaborative": .5, "nlp": .5, "image": .5})
    with pytest.raises(ValueError, match="cannot be negative"):
        validate_weights({"content": -.1, "collaborative": .6, "nlp": .3, "image": .2})


def test_popular_fallback(small_catalog):
    rows = popular.popular_products(small_catalog, 2).collect()
    assert [(r.product_id, r.predicted_score) for r in rows] == [("P104", 4.8), ("P101", 4.5)]
    rows = popular.popular_products(small_catalog, 2, category="nothing").collect()
    assert len(rows) == 2


def _hybrid_model(spark, small_catalog, inter):
    cf = collab.CollaborativeModel.fit(inter)
    postings, _ = content.tfidf(small_catalog)
    vecs = spark.createDataFrame([("P101", [1.0, 0.0]), ("P102", [0.9, 0.1]), ("P103", [0.0, 1.0]),
                                  ("P104", [0.7, 0.7])], "product_id string, embedding array<float>")
    return hybrid.HybridModel(small_catalog, cf, postings, vecs, vecs, n_candidates=30, materialize=False)


def test_hybrid_flow(spark, small_catalog):
    inter = spark.createDataFrame([("U1", "P101", 5.0), ("U1", "P102", 4.0), ("U2", "P102", 4.5),
                                   ("U2", "P103", 5.0)], "user_id string, product_id string, user_rating double")
    model = _hybrid_model(spark, small_catalog, inter)
    req = requests_frame(spark, [
        {"request_id": 1, "user_id": "U1", "product_id": "P101", "query": "wireless", "query_vec": [1.0, 0.2], "top_k": 5},
        {"request_id": 2, "user_id": "UNKNOWN", "top_k": 3},
        {"request_id": 3, "query": "   ", "top_k": 3},
        {"request_id": 4, "user_id": "U2", "top_k": 3,
         "weights": {"content": .9, "collaborative": .9, "nlp": .1, "image": .1}},
    ])
    out = hybrid.hybrid_recommend(model, req).collect()
    by = {}
    for r in out:
        by.setdefault(r.request_id, []).append(r)
    ids1 = [r.product_id for r in sorted(by[1], key=lambda r: r.rank)]
    assert "P101" not in ids1 and "P102" not in ids1 and ids1
    s1 = [r.final_hybrid_score for r in sorted(by[1], key=lambda r: r.rank)]
    assert s1 == sorted(s1, reverse=True)
    for r in by[1]:
        parts = r.content_contribution + r.collaborative_contribution + r.nlp_contribution + r.image_contribution
        assert abs(parts - r.final_hybrid_score) <= 2e-4
    assert len(by[2]) == 3 and len(by[3]) == 3  # popularity fallback
    assert 4 not in by  # invalid weights are rejected


def test_explanation_text(spark):
    from shelfrank.operators.explain import explanation_text
    df = spark.createDataFrame([(0.225, 0.21, 0.20, 0.02, "q", "Ref")],
                               "nlp double, collab double, content double, image double, query string, ref string")
    txt = df.select(explanation_text(F.col("nlp"), F.col("collab"), F.col("content"), F.col("image"),
                                     F.col("query"), F.col("ref"))).first()[0]
    assert txt == ("Strong semantic match with your query 'q' (Score: +0.23) | "
                   "Preferred by users with similar shopping preferences (Score: +0.21) | "
                   "Category & description match reference item 'Ref' (Score: +0.20)")
    assert "Visually" not in txt
