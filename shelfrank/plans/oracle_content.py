"""DuckDB oracle SQL for the TF-IDF content operators."""

from __future__ import annotations

from .oracle import CATALOG, ORACLE, STOP_LIST, analyzer, r4, rnd, with_


def tfidf_ctes(src: str = "catalog") -> str:
    return f"""docs AS (
  SELECT product_id, concat_ws(' ', {analyzer('product_name')}, {analyzer('category')}, {analyzer('category')},
                               {analyzer('description')}) AS doc FROM {src}),
toks AS (
  SELECT product_id, list_filter(string_split(doc, ' '),
                                 lambda t: length(t) >= 2 AND NOT list_contains({STOP_LIST}, t)) AS u FROM docs),
grams AS (
  SELECT product_id, list_concat(u, CASE WHEN len(u) >= 2 THEN
           list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) ELSE [] END) AS g FROM toks),
tf AS (SELECT product_id, term, count(*) AS tf FROM (SELECT product_id, unnest(g) AS term FROM grams) GROUP BY ALL),
ndocs AS (SELECT count(*) AS n FROM {src}),
vocab AS (
  SELECT term, count(*) AS df, ln((n + 1) / (count(*) + 1)) + 1.0 AS idf
  FROM tf, ndocs GROUP BY term, n),
raw AS (SELECT tf.product_id, tf.term, tf.tf, tf.tf * v.idf AS raw FROM tf JOIN vocab v USING (term)),
postings AS (
  SELECT product_id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY product_id)) AS w FROM raw)"""


def content_top_ctes(k: int, targets: str = "catalog") -> str:
    """``ctop``: brute-force ranking of every other product per target (zero
    similarity included), top-k by (rounded sim desc, id)."""
    rs = f"CASE WHEN sim = 0 THEN 0.0 ELSE {r4('sim')} END"
    return f"""sims AS (
  SELECT a.product_id AS target_id, b.product_id, sum(a.w * b.w) AS sim
  FROM postings a JOIN postings b ON a.term = b.term AND a.product_id <> b.product_id
  WHERE a.product_id IN (SELECT product_id FROM {targets}) GROUP BY ALL),
allp AS (
  SELECT t.product_id AS target_id, c.product_id, coalesce(s.sim, 0.0) AS sim
  FROM (SELECT DISTINCT product_id FROM {targets}) t JOIN catalog c ON t.product_id <> c.product_id
  LEFT JOIN sims s ON s.target_id = t.product_id AND s.product_id = c.product_id),
ctop AS (
  SELECT target_id, product_id, {rs} AS similarity_score, sim,
         row_number() OVER (PARTITION BY target_id ORDER BY {rs} DESC, product_id) AS rank
  FROM allp QUALIFY rank <= {k})"""


ORACLE["tfidf_terms"] = with_(CATALOG, tfidf_ctes()) + f"""SELECT p.product_id, p.term, p.tf, v.df,
  {rnd('v.idf', 6)} AS idf, {rnd('p.w', 6)} AS w FROM postings p JOIN vocab v USING (term)"""

def _content_sql(k: int) -> str:
    return with_(CATALOG, tfidf_ctes(), content_top_ctes(k)) + """,
ov AS (
  SELECT t.target_id, t.product_id, a.term, a.w * b.w AS o,
         row_number() OVER (PARTITION BY t.target_id, t.product_id ORDER BY a.w * b.w DESC, a.term) AS r
  FROM ctop t JOIN postings a ON a.product_id = t.target_id
  JOIN postings b ON b.product_id = t.product_id AND b.term = a.term
  WHERE a.w * b.w > 0 QUALIFY r <= 3),
terms AS (SELECT target_id, product_id, string_agg(term, ', ' ORDER BY r) AS terms FROM ov GROUP BY ALL)
SELECT t.target_id, t.rank, t.product_id, c.product_name, c.category, c.price, c.rating, t.similarity_score,
  concat_ws(' | ',
    CASE WHEN lower(tc.category) = lower(c.category) THEN 'Same category (' || chr(39) || tc.category || chr(39) || ')'
         ELSE 'Related categories (' || chr(39) || tc.category || chr(39) || ' & ' || chr(39) || c.category
              || chr(39) || ')' END,
    CASE WHEN tm.terms IS NOT NULL THEN 'Matching key terms: ' || tm.terms END) AS explanation,
  'Content-Based Filtering (TF-IDF)' AS recommendation_method
FROM ctop t JOIN catalog c ON c.product_id = t.product_id JOIN catalog tc ON tc.product_id = t.target_id
LEFT JOIN terms tm ON tm.target_id = t.target_id AND tm.product_id = t.product_id""".replace("\n,\nov", ",\nov", 1)


ORACLE["content_topk"] = _content_sql(10)

_FOUND = _content_sql(5)
_AT = _FOUND.index("SELECT t.target_id, t.rank")
ORACLE["recommend_for_product"] = _FOUND[:_AT] + f""", want AS (
  SELECT DISTINCT 'P' || CAST(l_partkey AS VARCHAR) AS product_id FROM lineitem
  UNION SELECT 'NEW' || CAST(s_suppkey AS VARCHAR) FROM supplier)
SELECT x.target_id, 'ok' AS status, x.rank, x.product_id, x.product_name, x.category, x.price, x.rating, x.similarity_score,
  x.explanation, x.recommendation_method
FROM ({_FOUND[_AT:]}) x WHERE x.target_id IN (SELECT product_id FROM want)
UNION ALL
SELECT product_id, 'PRODUCT_NOT_FOUND', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM want
WHERE product_id NOT IN (SELECT product_id FROM catalog)"""
