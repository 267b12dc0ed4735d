"""Text work is dealt over tasks, and no join with the catalog or a stored table passes through the driver."""
from shelfrank import session
from shelfrank.operators import content, encode
from shelfrank.sources import tables as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_made_in_bounded_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "DEAL_ROWS", 50)
    cat = T.catalog(spark, sf_dir)
    n = -(-cat.count() // 50)
    postings, vocab = content.tfidf(cat)
    assert f", {n})" in _plan(postings) and "BroadcastHashJoin [term" not in _plan(postings.join(vocab, "term"))
    assert f", {n})" in _plan(encode.text_features(encode.catalog_text(cat), "product_id", "text"))


def test_catalog_and_stored_tables_are_not_broadcast(spark, sf_dir):
    cat = T.catalog(spark, sf_dir)
    stored = session.cut_lineage(cat.select("product_id"))
    assert "Broadcast" not in _plan(spark.range(9).selectExpr("concat('P', id) product_id").join(cat, "product_id"))
    assert "Broadcast" not in _plan(spark.range(9).selectExpr("concat('P', id) product_id").join(stored, "product_id"))
