"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables (or views Spark derives from them), so
its work grows with the scale factor. Limits appear only where they are the
feature (top-k lists, a page of a catalog browse, the first-n audit sample).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog as cat_ops
from ..operators import browse, collab, content, encode, evaluate, hybrid, neighbors, popular, quality, semantic
from ..operators import requests as requests_ops
from ..schemas import (ABLATION_CONFIGS, DEFAULT_EVAL_SEEDS, DEFAULT_WEIGHTS, IMAGE_TOGGLE_CONFIGS,
                       NLP_TOGGLE_CONFIGS, SENSITIVITY_CONFIGS)
from ..session import cut_lineage, ensure_checkpoint_dir, ship_package
from ..sources import store
from ..sources import tables as T
from ..streaming.live import LiveModel

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Fitted artefacts (checkpointed) shared by the queries of one application.
_FITTED: dict = {}


def _state(spark: SparkSession, d: str) -> tuple:
    """What the tables' files look like now: a changed file makes every artefact stale."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for t in T.TABLES:
        p = jvm.org.apache.hadoop.fs.Path(f"{d.rstrip('/')}/{t}.parquet")
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            s = fs.getContentSummary(p)
            out.append((t, s.getLength(), s.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return tuple(out)


def fitted(spark: SparkSession, key: tuple, build):
    """``key`` is (name, data folder, ...); built anew when a table of the folder has changed."""
    k = (spark.sparkContext.applicationId, *key, _state(spark, key[1]))
    if k not in _FITTED:
        _FITTED[k] = build()
    return _FITTED[k]


def clear_fitted() -> None:
    _FITTED.clear()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query's own files, under the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


def mapped_raw(spark, d):
    return cat_ops.map_schema(T.raw_catalog(spark, d))


def clean(spark, d):
    return cat_ops.clean_catalog(mapped_raw(spark, d))


# ---------------------------------------------------------------- catalog ETL

@register("schema_map")
def q_schema_map(spark, d):
    return mapped_raw(spark, d)


@register("catalog_dedup")
def q_catalog_dedup(spark, d):
    return cat_ops.remove_duplicates(mapped_raw(spark, d)).select("product_id", "product_name", "ordinal")


@register("catalog_clean")
def q_catalog_clean(spark, d):
    return clean(spark, d)


@register("csv_catalog_dedup")
def q_csv_catalog_dedup(spark, d):
    """The raw catalog through CSV files: rows numbered by their place in the files, then the first of every id and name."""
    def build():
        path = scratch(spark, "raw-csv")
        store.write_catalog(T.raw_catalog(spark, d).orderBy("ordinal").drop("ordinal"), path, "csv")
        return path
    rows = store.read_raw_catalog(spark, fitted(spark, ("raw_csv", d), build))
    return cat_ops.remove_duplicates(rows).select("product_id", "product_name", "ordinal")


@register("catalog_sink")
def q_catalog_sink(spark, d):
    """The clean catalog written and read back."""
    def build():
        path = scratch(spark, "clean-catalog")
        store.write_catalog(clean(spark, d), path)
        return path
    return spark.read.parquet(fitted(spark, ("clean_sink", d), build))


def published(spark, d):
    """Catalog and ratings as a published version: bucketed by product and by user."""
    def build():
        root = scratch(spark, "artefacts")
        store.publish(spark, root, {"catalog": T.catalog(spark, d), "ratings": ratings(spark, d)},
                      {"catalog": "product_id", "ratings": "user_id"})
        return store.open_version(spark, root)
    return fitted(spark, ("published", d), build)


@register("artifact_ratings")
def q_artifact_ratings(spark, d):
    """Ratings per user from the published version: an aggregate on its bucket key."""
    return published(spark, d)["ratings"].groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum("r"), 4).alias("sum_r"))


@register("artifact_lookup")
def q_artifact_lookup(spark, d):
    """``product_lookup`` against the published catalog, which is not shuffled."""
    return browse.lookup_products(published(spark, d)["catalog"], lookup_ids(spark, d))


@register("html_clean_pages")
def q_html_clean_pages(spark, d):
    p = T.read_table(spark, d, "pages")
    return p.select("page_id", tx.clean_html("html").alias("text"))


@register("title_case")
def q_title_case(spark, d):
    """Python-style title case over hyphenated / apostrophe-bearing strings."""
    p = T.read_table(spark, d, "part")
    s = F.concat(F.col("p_name"), F.lit("-"), F.lower("p_type"), F.lit("'s "), F.col("p_brand"))
    return p.select("p_partkey", tx.title_case(s).alias("title"))


# ---------------------------------------------------------------- quality

@register("validate_catalog")
def q_validate_catalog(spark, d):
    return quality.validate_dataset(mapped_raw(spark, d))


@register("validation_details")
def q_validation_details(spark, d):
    return quality.validation_details(quality.validate_dataset(mapped_raw(spark, d)))


@register("validate_clean_catalog")
def q_validate_clean_catalog(spark, d):
    return quality.validate_dataset(clean(spark, d))


@register("validate_missing_columns")
def q_validate_missing_columns(spark, d):
    """The raw catalog without two required columns, and the same without rows."""
    part = mapped_raw(spark, d).drop("price", "category")
    none = part.where("product_id IS NULL AND product_name = ''")
    return quality.validate_dataset(part).withColumn("source", F.lit("part")).unionByName(
        quality.validate_dataset(none).withColumn("source", F.lit("empty")))


@register("column_profile")
def q_column_profile(spark, d):
    return quality.column_profile(mapped_raw(spark, d).drop("ordinal"))


@register("category_distribution")
def q_category_distribution(spark, d):
    return quality.category_distribution(clean(spark, d))


@register("price_stats")
def q_price_stats(spark, d):
    return quality.price_statistics(clean(spark, d))


@register("rating_stats")
def q_rating_stats(spark, d):
    return quality.rating_statistics(clean(spark, d))


@register("price_histogram")
def q_price_histogram(spark, d):
    return quality.histogram(clean(spark, d), "price", 20)


@register("rating_histogram")
def q_rating_histogram(spark, d):
    return quality.histogram(clean(spark, d), "rating", 10)


@register("interaction_density")
def q_interaction_density(spark, d):
    return quality.interaction_overview(T.catalog(spark, d), T.interactions(spark, d))


# ---------------------------------------------------------------- collaborative

def ratings(spark, d):
    return fitted(spark, ("ratings", d), lambda: cut_lineage(collab.rating_table(T.interactions(spark, d))))


def cf_model(spark, d):
    return fitted(spark, ("cf", d), lambda: collab.CollaborativeModel.of_ratings(ratings(spark, d)))


def tfidf_postings(spark, d):
    return fitted(spark, ("tfidf", d), lambda: cut_lineage(content.tfidf(T.catalog(spark, d))[0]))


@register("ratings_mean")
def q_ratings_mean(spark, d):
    return collab.rating_table(T.interactions(spark, d))


@register("item_similarity")
def q_item_similarity(spark, d):
    sim = collab.item_similarity(ratings(spark, d))
    return sim.select("item_i", "item_j", F.round("sim", 4).alias("sim"))


@register("item_neighbours")
def q_item_neighbours(spark, d):
    """The ten most similar items of every item, without the full similarity table."""
    return collab.top_neighbours(ratings(spark, d), top_n=10)


@register("similarity_histogram")
def q_similarity_histogram(spark, d):
    """Distribution of the item similarities under 0.999, in 30 bins."""
    def counts(pairs):
        return pairs.groupBy(F.round("sim", 4).alias("sim")).agg(F.count(F.lit(1)).alias("n"))
    sim = collab.item_similarity(ratings(spark, d), reduce=counts)
    return quality.histogram(sim, "sim", 30, exclude_at_least=0.999, weight="n")


@register("cf_predict")
def q_cf_predict(spark, d):
    """Predicted rating for every observed (user, item) pair (self term included)."""
    m = cf_model(spark, d)
    return m.scores(pairs=m.ratings.select("user_id", "product_id"))


@register("cf_topk")
def q_cf_topk(spark, d):
    m = cf_model(spark, d)
    return m.recommend(T.catalog(spark, d), top_k=10)


# ---------------------------------------------------------------- popularity

@register("popular_topk")
def q_popular_topk(spark, d):
    return popular.popular_products(T.catalog(spark, d), top_k=10)


@register("popular_in_category")
def q_popular_in_category(spark, d):
    """Top 10 of one category (any case), and of the whole catalog for a category nobody has."""
    cat = T.catalog(spark, d)
    asked = {"PROMO": "promo", "No such category": "nothing"}
    one, none = (popular.popular_products(cat, 10, category=c).withColumn("asked", F.lit(n)) for c, n in asked.items())
    return one.unionByName(none)


@register("popular_by_category")
def q_popular_by_category(spark, d):
    return popular.popular_by_category(T.catalog(spark, d), top_k=5)


@register("recommend_for_user")
def q_recommend_for_user(spark, d):
    """Every customer plus the unknown ids of the request table: CF or popular."""
    customers = T.read_table(spark, d, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user_id"))
    users = customers.unionByName(T.requests(spark, d).select("user_id").where(F.col("user_id").isNotNull()))
    return popular.recommend_for_user(users, cf_model(spark, d), T.catalog(spark, d), top_k=5)


# ---------------------------------------------------------------- content (TF-IDF)

@register("tfidf_terms")
def q_tfidf_terms(spark, d):
    postings, vocab = content.tfidf(T.catalog(spark, d))
    return postings.join(vocab, "term").select("product_id", "term", "tf", "df",
                                               F.round("idf", 6).alias("idf"), F.round("w", 6).alias("w"))


@register("vocabulary_topn")
def q_vocabulary_topn(spark, d):
    """TF-IDF with a vocabulary of the 60 most frequent terms: its terms, and each product's weights over them."""
    postings, vocab = content.tfidf(T.catalog(spark, d), max_features=60)
    return postings.join(vocab, "term").select("product_id", "term", "df", F.round("w", 6).alias("w"))


@register("content_topk")
def q_content_topk(spark, d):
    """Ten most similar products, with explanations, for every catalog product."""
    return content.recommend_similar(tfidf_postings(spark, d), T.catalog(spark, d), k=10)


@register("recommend_for_product")
def q_recommend_for_product(spark, d):
    """Product facade over every part bought and ids no part has: similar products or a rejection."""
    asked = T.read_table(spark, d, "lineitem").select(F.concat(F.lit(" p"), F.col("l_partkey").cast("string")).alias("product_id"))
    other = T.read_table(spark, d, "supplier").select(F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("product_id"))
    return content.recommend_for_products(tfidf_postings(spark, d), T.catalog(spark, d), asked.unionByName(other), k=5)


# ---------------------------------------------------------------- dense vectors

@register("vector_topk")
def q_vector_topk(spark, d):
    """Semantic search: top-10 products for every request with a query text."""
    cat = T.catalog(spark, d)
    return neighbors.semantic_search(encode.with_query_vectors(T.requests(spark, d)), encode.catalog_vectors(cat), cat, k=10)


@register("hashed_text_embedding")
def q_hashed_text_embedding(spark, d):
    """Every product's text vector, as its non-zero buckets."""
    return encode.text_features(encode.catalog_text(T.catalog(spark, d)), "product_id", "text").withColumnRenamed("id", "product_id")


@register("image_topk")
def q_image_topk(spark, d):
    """Visual neighbours (self excluded) of every product with an image vector."""
    return neighbors.visual_neighbours(T.vectors(spark, d), T.catalog(spark, d), k=10)


@register("category_bias")
def q_category_bias(spark, d):
    return neighbors.category_bias(T.vectors(spark, d))


@register("visual_query_audit")
def q_visual_query_audit(spark, d):
    return neighbors.visual_query_audit(T.vectors(spark, d), T.catalog(spark, d), 10, 5, nested=False)


@register("visual_audit_nested")
def q_visual_audit_nested(spark, d):
    """The audit with its matches nested per product; the nested column as JSON text."""
    audit = neighbors.visual_query_audit(T.vectors(spark, d), T.catalog(spark, d), 10, 5)
    return audit.withColumn("top_visual_matches", F.to_json("top_visual_matches"))


def semantic_space(spark, d):
    """Fitted space and the catalog's vectors in it."""
    def build():
        _, vocab = content.tfidf(T.catalog(spark, d))
        space = semantic.SemanticSpace.fit(tfidf_postings(spark, d), vocab)
        return space, cut_lineage(space.encode(encode.catalog_text(T.catalog(spark, d)), "product_id", "text", "product_id"))
    return fitted(spark, ("semantic", d), build)


@register("semantic_topk")
def q_semantic_topk(spark, d):
    """Search by corpus-fitted vectors: top-10 products for every request with a query text."""
    space, vectors = semantic_space(spark, d)
    req = T.requests(spark, d)
    vec = space.encode(encode.asked(req), "request_id", "query", "__rid", "query_vec")
    req = req.drop("query_vec").join(vec, F.col("request_id") == F.col("__rid")).drop("__rid")
    return neighbors.semantic_search(req, vectors, T.catalog(spark, d), k=10)


# ---------------------------------------------------------------- streaming

def live(spark, d):
    """Events replayed as a stream: a run per third of the month, each continuing from the checkpoint of the one before."""
    def build():
        root = scratch(spark, "live")
        model = LiveModel(spark, f"{root}/state", top_k=5)
        events = T.event_ratings(T.read_table(spark, d, "events"))
        for part in range(3):
            events.where(F.col("slice") == part).drop("slice").write.mode("overwrite").parquet(f"{root}/source/slice-{part}")
            stream = spark.readStream.schema(events.drop("slice").schema).parquet(f"{root}/source/*")
            model.run(stream, f"{root}/checkpoint").awaitTermination()
        return model
    return fitted(spark, ("live", d), build)


@register("stream_ratings")
def q_stream_ratings(spark, d):
    """Mean ratings per pair after the stream."""
    return live(spark, d).ratings().select("user_id", "product_id", "n", F.round("r", 6).alias("r"))


@register("stream_similarity")
def q_stream_similarity(spark, d):
    """Item similarities from the summed co-occurrence deltas."""
    return live(spark, d).similarity().select("item_i", "item_j", F.round("sim", 4).alias("sim"))


@register("stream_answers")
def q_stream_answers(spark, d):
    """What every micro-batch answered to its users, from the state as of then."""
    return live(spark, d).answers().select(F.col("batch_id").alias("slice"), "user_id", "rank", "product_id", "predicted_score")


# ---------------------------------------------------------------- requests & hybrid

def hybrid_model(spark, d):
    cat = T.catalog(spark, d)
    return hybrid.HybridModel(cat, cf_model(spark, d), tfidf_postings(spark, d), encode.catalog_vectors(cat),
                              T.vectors(spark, d), n_candidates=30)


def hybrid_requests(spark, d):
    return encode.with_query_vectors(T.requests(spark, d))


@register("request_rejections")
def q_request_rejections(spark, d):
    """Outcome of one JSON body per customer: endpoint, shape and defects rotate with the key."""
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    text = k.cast("string")
    weights = pick(5, '{"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15}',
                   '{"content": 0.9, "collaborative": 0.9, "nlp": 0.1, "image": 0.1}',
                   '{"content": -0.1, "collaborative": 0.6, "nlp": 0.3, "image": 0.2}',
                   '{"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15, "price": 0.0}', 'null')
    body = F.concat(F.lit('{"product_id": "P'), text, F.lit('", "query": "'), pick(7, "bolt", " ", "anvil", "", "cog", "nut", "cam"),
                    F.lit('", "top_k": "'), text, F.lit('", "weights": '), weights, F.when(F.pmod(k, F.lit(11)) == 0, "").otherwise("}"))
    bodies = T.read_table(spark, d, "customer").select(k.cast("long").alias("request_id"), body.alias("body"),
                                                       pick(3, "search", "similar", "hybrid").alias("endpoint"))
    return requests_ops.request_outcomes(bodies, T.catalog(spark, d))


@register("request_validation")
def q_request_validation(spark, d):
    r = requests_ops.normalize_requests(T.requests(spark, d))
    return r.select("request_id", "user_id", "product_id", "product_given", "query", "top_k",
                    *[f"w_{s}" for s in ("content", "collaborative", "nlp", "image")], "status", "code")


@register("hybrid_candidates")
def q_hybrid_candidates(spark, d):
    return hybrid.hybrid_candidates(hybrid_model(spark, d), hybrid_requests(spark, d))


@register("hybrid_topk")
def q_hybrid_topk(spark, d):
    """Flagship: ranked, explained hybrid recommendations for every request."""
    return hybrid.hybrid_recommend(hybrid_model(spark, d), hybrid_requests(spark, d))


@register("explanation_lookup")
def q_explanation_lookup(spark, d):
    """Breakdown of product ``P{request_id + 1}`` for every request (top-20 list)."""
    req = hybrid_requests(spark, d)
    lookups = req.select("request_id", F.concat(F.lit("P"), (F.col("request_id") + 1).cast("string")).alias("product_id"))
    return hybrid.explanation_lookup(hybrid_model(spark, d), req, lookups, top_k=20)


# ---------------------------------------------------------------- evaluation

def _seed_eval(spark, d, configs: dict, group=None, top_k: int = 5):
    scored, truth = fitted(spark, ("seeded_eval", d, tuple(DEFAULT_EVAL_SEEDS)), lambda: evaluate.user_only_hybrid_scores(
        T.interactions(spark, d), T.catalog(spark, d), DEFAULT_EVAL_SEEDS))
    cfg = evaluate.config_table(spark, configs, group)
    return cut_lineage(evaluate.multi_seed_metrics(scored, truth, cfg, top_k))  # a row per configuration and seed, read several times


@register("split_sizes")
def q_split_sizes(spark, d):
    sp = evaluate.holdout_split(T.interactions(spark, d), 0.2, [42])
    return evaluate.split_sizes(sp).drop("seed")


@register("test_split")
def q_test_split(spark, d):
    sp = evaluate.holdout_split(T.interactions(spark, d), 0.2, [42])
    return sp.where("is_test").select("user_id", "product_id", "user_rating")


@register("precision_recall_ndcg")
def q_precision_recall_ndcg(spark, d):
    return evaluate.evaluate_collaborative(T.interactions(spark, d), T.catalog(spark, d), [5, 10], seed=42)


@register("seed_summary_stats")
def q_seed_summary_stats(spark, d):
    per_seed = _seed_eval(spark, d, {"Full Hybrid": DEFAULT_WEIGHTS})
    long = per_seed.unpivot(["configuration", "seed"], ["precision_at_k", "recall_at_k", "ndcg_at_k"],
                            "metric", "value")
    return evaluate.summary_stats(long, ["configuration", "metric"], "value")


@register("multi_seed_report")
def q_multi_seed_report(spark, d):
    return evaluate.multi_seed_report(_seed_eval(spark, d, SENSITIVITY_CONFIGS), 5)


@register("ablation")
def q_ablation(spark, d):
    return evaluate.multi_seed_report(_seed_eval(spark, d, ABLATION_CONFIGS), 5)


@register("signal_toggles")
def q_signal_toggles(spark, d):
    a = _seed_eval(spark, d, IMAGE_TOGGLE_CONFIGS, "image_comparison")
    b = _seed_eval(spark, d, NLP_TOGGLE_CONFIGS, "nlp_comparison")
    return evaluate.multi_seed_report(a.unionByName(b), 5)


@register("metrics_unpivot")
def q_metrics_unpivot(spark, d):
    """All ablation and sensitivity means, one row per configuration and metric."""
    reports = (evaluate.multi_seed_report(_seed_eval(spark, d, c), 5) for c in (ABLATION_CONFIGS, SENSITIVITY_CONFIGS))
    return evaluate.melt_report(evaluate.union_reports(*reports))


# ---------------------------------------------------------------- browse & lookup

@register("browse_category")
def q_browse_category(spark, d):
    """First page (12 rows) of every category, with per-category pagination."""
    return browse.pages_by_category(T.catalog(spark, d), page=1, limit=12)


@register("browse_keyword")
def q_browse_keyword(spark, d):
    """Keyword search 'bolt' over name/description, page 2 of 12."""
    return browse.get_products(T.catalog(spark, d), search="bolt", page=2, limit=12)


@register("browse_page")
def q_browse_page(spark, d):
    """Category 'Small' (case-insensitive), page 3 of 25."""
    return browse.get_products(T.catalog(spark, d), category="Small", page=3, limit=25)


@register("product_lookup")
def q_product_lookup(spark, d):
    """Every part id bought (typed lower-case with spaces) plus unknown
    supplier-derived ids, looked up by normalised id."""
    return browse.lookup_products(T.catalog(spark, d), lookup_ids(spark, d))


def lookup_ids(spark, d):
    li = T.read_table(spark, d, "lineitem").select(
        F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("query_id"))
    sup = T.read_table(spark, d, "supplier").select(
        F.concat(F.lit("p"), (F.col("s_suppkey") + 1000000).cast("string")).alias("query_id"))
    return li.unionByName(sup).distinct()


@register("browse_keyword_indexed")
def q_browse_keyword_indexed(spark, d):
    """The same page as ``browse_keyword``, through the trigram index."""
    def build():
        path = scratch(spark, "keyword-index")
        browse.save_index(browse.keyword_index(T.catalog(spark, d)), path)
        return spark.read.parquet(path)
    return browse.get_products(T.catalog(spark, d), search="bolt", page=2, limit=12, index=fitted(spark, ("keyword_index", d), build))


@register("health_summary")
def q_health_summary(spark, d):
    """Row counts of the catalog and of every fitted artefact."""
    m = cf_model(spark, d)
    post = tfidf_postings(spark, d)
    parts = [
        T.catalog(spark, d).agg(F.count(F.lit(1)).alias("catalog_products")),
        T.interactions(spark, d).agg(F.count(F.lit(1)).alias("interactions")),
        m.ratings.agg(F.count(F.lit(1)).alias("rated_pairs"), F.count_distinct("user_id").alias("known_users")),
        m.count_similar(),
        post.agg(F.count(F.lit(1)).alias("tfidf_postings"), F.count_distinct("term").alias("vocabulary_terms")),
        T.vectors(spark, d).agg(F.count(F.lit(1)).alias("vector_products")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = cat_ops.attach_row(out, p)
    return out
