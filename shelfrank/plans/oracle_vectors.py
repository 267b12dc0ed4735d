"""DuckDB oracle SQL for the dense-vector operators (brute force over pairs)."""

from __future__ import annotations

from .oracle import CATALOG, ORACLE, REQUESTS, STOP_LIST, VECTORS, analyzer, r4, strip, with_

_VX = """vx AS (
  SELECT product_id, category, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM vectors{where})"""
VEC = _VX.format(where=" WHERE product_id IN (SELECT product_id FROM catalog)")

# text vectors: signed hashed features of catalog texts and of query texts, as (id, bucket, s)
TEXT = f"""etext AS (
  SELECT product_id AS id, product_name || ' Category: ' || category || '. Description: ' || description AS txt FROM catalog),
etoks AS (SELECT id, list_filter(string_split({analyzer('txt')}, ' '),
                                 lambda t: length(t) >= 2 AND NOT list_contains({STOP_LIST}, t)) AS u FROM etext),
egrams AS (
  SELECT id, list_concat(u, CASE WHEN len(u) >= 2 THEN
           list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) ELSE [] END) AS g FROM etoks),
eterm AS (SELECT id, md5(unnest(g)) AS h FROM egrams),
efeat AS (
  SELECT id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket,
         sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS s
  FROM eterm GROUP BY ALL HAVING sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) <> 0)"""
QTEXT = (TEXT.replace("etext AS (\n  SELECT product_id AS id, product_name || ' Category: ' || category || '. Description: ' || description AS txt FROM catalog)",
                      f"qtext AS (SELECT request_id AS id, query AS txt FROM requests WHERE {strip('query')} <> '')")
         .replace("FROM etext", "FROM qtext").replace("etoks", "qtoks").replace("egrams", "qgrams").replace("eterm", "qterm").replace("efeat", "qfeat"))
TCOS = """enorm AS (SELECT id, sqrt(sum(s * s)) AS n FROM efeat GROUP BY id),
qnorm AS (SELECT id, sqrt(sum(s * s)) AS n FROM qfeat GROUP BY id),
tdot AS (SELECT q.id AS request_id, e.id AS product_id, sum(q.s * e.s) AS dot FROM qfeat q JOIN efeat e USING (bucket) GROUP BY ALL),
tcos AS (
  SELECT request_id, product_id, dot / (qn.n * en.n) AS s FROM tdot
  JOIN qnorm qn ON qn.id = request_id JOIN enorm en ON en.id = product_id)"""


def cos(a: str, b: str, an: str, bn: str) -> str:
    return f"CASE WHEN {an} * {bn} > 0 THEN list_dot_product({a}, {b}) / ({an} * {bn}) ELSE 0.0 END"


def visual_top(k: int, targets: str = "vx") -> str:
    s = cos("a.v", "b.v", "a.n", "b.n")
    return f"""vtop AS (
  SELECT a.product_id AS target_id, b.product_id, {r4(s)} AS similarity_score,
         row_number() OVER (PARTITION BY a.product_id ORDER BY {r4(s)} DESC, b.product_id) AS rank
  FROM vx a JOIN vx b ON a.product_id <> b.product_id
  WHERE a.product_id IN (SELECT product_id FROM {targets}) QUALIFY rank <= {k})"""


ORACLE["image_topk"] = with_(CATALOG, VECTORS, VEC, visual_top(10)) + """SELECT t.target_id, t.rank, t.product_id,
  c.product_name, c.category, c.price, c.rating, t.similarity_score,
  'Visual Embedding Similarity' AS recommendation_method
FROM vtop t JOIN catalog c ON c.product_id = t.product_id"""

ORACLE["hashed_text_embedding"] = with_(CATALOG, TEXT) + "SELECT id AS product_id, bucket, s FROM efeat"

_TS = r4("coalesce(t.s, 0.0)")
ORACLE["vector_topk"] = with_(CATALOG, REQUESTS, TEXT, QTEXT, TCOS) + f""",
st AS (
  SELECT r.request_id, c.product_id, c.product_name, c.category, c.price, c.rating, {_TS} AS similarity_score,
         trim(r.query) AS query,
         row_number() OVER (PARTITION BY r.request_id ORDER BY {_TS} DESC, c.product_id) AS rank
  FROM requests r JOIN catalog c ON true LEFT JOIN tcos t ON t.request_id = r.request_id AND t.product_id = c.product_id
  WHERE trim(coalesce(r.query, '')) <> '' QUALIFY rank <= 10)
SELECT request_id, rank, product_id, product_name, category, price, rating, similarity_score,
  query, 'Semantic Vector Search' AS recommendation_method FROM st""".replace("\n,\nst", ",\nst", 1)

_BS = "list_dot_product(a.v, b.v) / ((a.n + 1e-9) * (b.n + 1e-9))"
ORACLE["category_bias"] = with_(VECTORS, _VX.format(where="")) + f""", pr AS (
  SELECT lower(a.category) = lower(b.category) AS same, {_BS} AS s
  FROM vx a JOIN vx b ON a.product_id < b.product_id)
SELECT coalesce({r4('avg(s) FILTER (WHERE same)')}, 0.0) AS intra_category_mean,
       coalesce({r4('avg(s) FILTER (WHERE NOT same)')}, 0.0) AS inter_category_mean,
       coalesce({r4('avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same)')}, 0.0) AS category_bias_delta
FROM pr""".replace("\n, pr", ", pr", 1)

ORACLE["visual_query_audit"] = with_(CATALOG, VECTORS, VEC) + """,
smp AS (SELECT product_id FROM catalog ORDER BY ordinal LIMIT 10),
""" + visual_top(5, "smp") + """
SELECT t.product_id AS target_product_id, t.product_name AS target_product_name, t.category AS target_category,
  v.rank, v.product_id, c.product_name, c.category, v.similarity_score,
  lower(c.category) = lower(t.category) AS same_category
FROM catalog t JOIN smp s ON s.product_id = t.product_id
LEFT JOIN vtop v ON v.target_id = t.product_id LEFT JOIN catalog c ON c.product_id = v.product_id"""
