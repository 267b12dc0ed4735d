"""DuckDB oracle SQL for request validation and the hybrid ranker.

Brute force where Spark is clever: content neighbours rank every catalog
product per reference, vector neighbours score every pair.
"""

from __future__ import annotations

from .oracle import (CATALOG, INTERACTIONS, ORACLE, REQUESTS, VECTORS, cf_ctes, norm_id, r4, strip,
                     with_)
from .oracle_content import content_top_ctes, tfidf_ctes
from .oracle_vectors import QTEXT, TCOS, TEXT, VEC, cos

SIG = ["content", "collaborative", "nlp", "image"]
DEFAULTS = {"content": 0.25, "collaborative": 0.35, "nlp": 0.25, "image": 0.15}


def rq_ctes(top_k_override: int | None = None) -> str:
    """``top_k_override`` stands for a lookup: it also takes the default weights."""
    src = ("(SELECT * REPLACE (NULL AS w_content, NULL AS w_collaborative, NULL AS w_nlp, NULL AS w_image) FROM requests)"
           if top_k_override else "requests")
    alln = " AND ".join(f"w_{s} IS NULL" for s in SIG)
    anyn = " OR ".join(f"w_{s} IS NULL" for s in SIG)
    eff = ",\n    ".join(f"CAST(CASE WHEN {alln} THEN {DEFAULTS[s]} ELSE w_{s} END AS DOUBLE) AS w_{s}" for s in SIG)
    k = (f"{top_k_override}" if top_k_override else
         "greatest(coalesce(top_k, 10), 1)")
    neg = " OR ".join(f"w_{s} < 0" for s in SIG)
    tot = " + ".join(f"w_{s}" for s in SIG)
    return f"""rq1 AS (
  SELECT request_id,
    CASE WHEN {norm_id('user_id')} <> '' THEN {norm_id('user_id')} END AS user_id,
    CASE WHEN {norm_id('product_id')} <> '' THEN {norm_id('product_id')} END AS ref_id,
    (product_id IS NOT NULL AND product_id <> '') AS product_given,
    CASE WHEN {strip('query')} <> '' THEN query END AS query,
    CAST({k} AS INTEGER) AS top_k,
    ({alln}) AS alln, ({anyn}) AS anyn,
    {eff}
  FROM {src} requests),
rq AS (
  SELECT *, CASE WHEN NOT alln AND anyn THEN 'INVALID_WEIGHTS' WHEN {neg} THEN 'INVALID_WEIGHTS'
                 WHEN abs({tot} - 1.0) > 1e-4 THEN 'INVALID_WEIGHTS' END AS code
  FROM rq1)"""


def hybrid_sql(top_k_override: int | None = None, n: int = 30) -> str:
    """CTE chain ending in ``scored`` (all candidates, fused) and ``ranked``. A request's depth is n or its own top_k."""
    most = f"(SELECT greatest({n}, max(top_k)) FROM acc)"
    depth = f"greatest({n}, a.top_k)"
    i_cos = cos("r.v", "x.v", "r.n", "x.n")
    norm = ",\n    ".join(
        f"CASE WHEN max(raw_{s}) OVER w = min(raw_{s}) OVER w THEN (CASE WHEN raw_{s} > 0 THEN 1.0 ELSE 0.0 END) "
        f"ELSE least(greatest((raw_{s} - min(raw_{s}) OVER w) / (max(raw_{s}) OVER w - min(raw_{s}) OVER w), 0.0), 1.0) "
        f"END AS norm_{s}" for s in SIG)
    act = {"content": "product_given", "collaborative": "is_known", "nlp": "query IS NOT NULL",
           "image": "product_given"}
    asum = " + ".join(f"(CASE WHEN {act[s]} THEN w_{s} ELSE 0.0 END)" for s in SIG)
    eff = ",\n    ".join(f"CASE WHEN asum > 0 THEN (CASE WHEN {act[s]} THEN w_{s} / asum ELSE 0.0 END) "
                         f"ELSE w_{s} END AS eff_{s}" for s in SIG)
    fused = " + ".join(f"eff_{s} * norm_{s}" for s in SIG)
    return with_(CATALOG, VECTORS, INTERACTIONS, REQUESTS, cf_ctes(), tfidf_ctes(), VEC, TEXT, QTEXT, TCOS,
                 rq_ctes(top_k_override)) + f""",
acc AS (
  SELECT rq.*, rq.user_id IN (SELECT user_id FROM ratings) AS is_known,
         coalesce(rq.ref_id IN (SELECT product_id FROM vx), false) AS has_image, c.product_name AS ref_name
  FROM rq LEFT JOIN catalog c ON c.product_id = rq.ref_id WHERE rq.code IS NULL),
refs AS (SELECT DISTINCT ref_id AS product_id FROM acc WHERE ref_id IN (SELECT product_id FROM catalog)),
{content_top_ctes(most, 'refs')},
cf_t AS (
  SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, product_id) AS rk
  FROM cf_cand QUALIFY rk <= {most}),
nlp_t AS (
  SELECT a.request_id, c.product_id,
         row_number() OVER (PARTITION BY a.request_id ORDER BY {r4("coalesce(t.s, 0.0)")} DESC, c.product_id) AS rk
  FROM acc a JOIN catalog c ON true LEFT JOIN tcos t ON t.request_id = a.request_id AND t.product_id = c.product_id
  WHERE a.query IS NOT NULL QUALIFY rk <= {depth}),
img_t AS (
  SELECT r.product_id AS ref_id, x.product_id,
         row_number() OVER (PARTITION BY r.product_id ORDER BY {r4(i_cos)} DESC, x.product_id) AS rk
  FROM vx r JOIN vx x ON r.product_id <> x.product_id
  WHERE r.product_id IN (SELECT ref_id FROM acc WHERE has_image) QUALIFY rk <= {most}),
cand0 AS (
  SELECT a.request_id, t.product_id FROM acc a JOIN cf_t t ON t.user_id = a.user_id AND t.rk <= {depth} WHERE a.is_known
  UNION SELECT a.request_id, t.product_id FROM acc a JOIN ctop t ON t.target_id = a.ref_id AND t.rank <= {depth}
  UNION SELECT request_id, product_id FROM nlp_t
  UNION SELECT a.request_id, t.product_id FROM acc a JOIN img_t t ON t.ref_id = a.ref_id AND t.rk <= {depth} WHERE a.has_image),
cand1 AS (
  SELECT c.request_id, c.product_id FROM cand0 c JOIN acc a ON a.request_id = c.request_id
  WHERE (a.ref_id IS NULL OR c.product_id <> a.ref_id)
    AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = a.user_id AND r.product_id = c.product_id AND r.r > 0)),
pop30 AS (SELECT product_id, row_number() OVER (ORDER BY rating DESC, price DESC, product_id) AS rk
          FROM catalog QUALIFY rk <= {most}),
cand AS (
  SELECT request_id, product_id FROM cand1
  UNION ALL
  SELECT a.request_id, p.product_id FROM acc a JOIN pop30 p ON p.rk <= {depth}
  WHERE a.request_id NOT IN (SELECT request_id FROM cand1) AND (a.ref_id IS NULL OR p.product_id <> a.ref_id)),
candc AS (SELECT * FROM cand WHERE product_id IN (SELECT product_id FROM catalog)),
rawt AS (
  SELECT c.request_id, c.product_id, a.top_k, a.query, a.ref_name, a.product_given, a.is_known,
    {', '.join(f'a.w_{s}' for s in SIG)},
    coalesce(s.sim, 0.0) AS raw_content,
    CASE WHEN a.is_known THEN coalesce(p.predicted_score, 0.0) ELSE 0.0 END AS raw_collaborative,
    CASE WHEN a.query IS NOT NULL THEN coalesce(t.s, 0.0) ELSE 0.0 END AS raw_nlp,
    CASE WHEN a.has_image AND x.v IS NOT NULL THEN {i_cos} ELSE 0.0 END AS raw_image
  FROM candc c JOIN acc a ON a.request_id = c.request_id
  LEFT JOIN sims s ON s.target_id = a.ref_id AND s.product_id = c.product_id
  LEFT JOIN pred p ON p.user_id = a.user_id AND p.product_id = c.product_id
  LEFT JOIN tcos t ON t.request_id = c.request_id AND t.product_id = c.product_id
  LEFT JOIN vx x ON x.product_id = c.product_id
  LEFT JOIN vx r ON r.product_id = a.ref_id),
normt AS (
  SELECT *, {norm}
  FROM rawt WINDOW w AS (PARTITION BY request_id)),
efft AS (SELECT *, {eff} FROM (SELECT *, {asum} AS asum FROM normt)),
scored AS (
  SELECT *, {r4(fused)} AS final_hybrid_score,
    {', '.join(r4(f'eff_{s} * norm_{s}') + f' AS {s}_contribution' for s in SIG)}
  FROM efft),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY final_hybrid_score DESC, product_id) AS rank
  FROM scored QUALIFY rank <= top_k)
"""


def _two(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(12,4)), 2) AS VARCHAR)"


EXPLAIN = f"""coalesce(nullif(concat_ws(' | ',
    CASE WHEN nlp_contribution >= 0.05 THEN
      CASE WHEN query IS NOT NULL AND query <> ''
           THEN 'Strong semantic match with your query ' || chr(39) || query || chr(39) || ' (Score: +' || {_two('nlp_contribution')} || ')'
           ELSE 'High semantic text similarity (Score: +' || {_two('nlp_contribution')} || ')' END END,
    CASE WHEN collaborative_contribution >= 0.05 THEN
      'Preferred by users with similar shopping preferences (Score: +' || {_two('collaborative_contribution')} || ')' END,
    CASE WHEN content_contribution >= 0.05 THEN
      CASE WHEN ref_name IS NOT NULL AND ref_name <> ''
           THEN 'Category & description match reference item ' || chr(39) || ref_name || chr(39) || ' (Score: +' || {_two('content_contribution')} || ')'
           ELSE 'Product title & description match your interest (Score: +' || {_two('content_contribution')} || ')' END END,
    CASE WHEN image_contribution >= 0.05 THEN
      'Visually resembles reference product image (Score: +' || {_two('image_contribution')} || ')' END), ''),
  'Recommended based on catalog popularity and category relevance')"""

ORACLE["request_validation"] = with_(CATALOG, VECTORS, REQUESTS, rq_ctes()) + """SELECT request_id, user_id,
  ref_id AS product_id, product_given, query, top_k, w_content, w_collaborative, w_nlp, w_image,
  CASE WHEN code IS NULL THEN 'accepted' ELSE 'rejected' END AS status, code FROM rq"""

_KEY = "c_custkey"
_WEIGHT_RULE = f"""CASE {_KEY} % 5 WHEN 1 THEN 'Weights must sum to 1.0' WHEN 2 THEN 'A weight cannot be negative'
  WHEN 3 THEN 'Weights must hold exactly the four signals' END"""
ORACLE["request_rejections"] = with_(CATALOG) + f""", o AS (
  SELECT CAST({_KEY} AS BIGINT) AS request_id,
    CASE WHEN {_KEY} % 11 = 0 THEN 'INVALID_JSON'
         WHEN {_KEY} % 3 = 0 AND {_KEY} % 7 IN (1, 3) THEN 'MISSING_QUERY'
         WHEN {_KEY} % 3 = 1 AND 'P' || CAST({_KEY} AS VARCHAR) NOT IN (SELECT product_id FROM catalog) THEN 'PRODUCT_NOT_FOUND'
         WHEN {_KEY} % 3 = 2 AND {_KEY} % 5 IN (1, 2, 3) THEN 'INVALID_WEIGHTS' END AS code,
    {_WEIGHT_RULE} AS rule
  FROM customer)
SELECT request_id, CASE WHEN code IS NULL THEN 'accepted' ELSE 'rejected' END AS status, code,
  CASE code WHEN 'INVALID_JSON' THEN 'The body is not valid JSON' WHEN 'MISSING_QUERY' THEN 'A query text is required'
    WHEN 'PRODUCT_NOT_FOUND' THEN 'The product is not in the catalog' WHEN 'INVALID_WEIGHTS' THEN rule END AS message
FROM o""".replace("\n, o AS", ", o AS", 1)

ORACLE["hybrid_candidates"] = hybrid_sql() + "SELECT request_id, product_id FROM candc"

ORACLE["hybrid_topk"] = hybrid_sql() + f"""SELECT r.request_id, r.rank, r.product_id, c.product_name, c.category,
  c.price, c.rating, r.final_hybrid_score, r.content_contribution, r.collaborative_contribution,
  r.nlp_contribution, r.image_contribution, {EXPLAIN} AS explanation
FROM ranked r JOIN catalog c ON c.product_id = r.product_id"""

ORACLE["explanation_lookup"] = hybrid_sql(top_k_override=20) + f""",
lk AS (SELECT request_id, {norm_id("('P' || CAST(request_id + 1 AS VARCHAR))")} AS product_id FROM requests),
hit AS (SELECT r.*, {EXPLAIN} AS explanation FROM ranked r)
SELECT lk.request_id, lk.product_id,
  CASE WHEN h.rank IS NOT NULL OR c.product_id IS NOT NULL THEN 'ok' ELSE 'PRODUCT_NOT_FOUND' END AS status,
  c.product_name,
  CASE WHEN h.rank IS NOT NULL THEN h.final_hybrid_score WHEN c.product_id IS NOT NULL THEN 0.5 END AS final_hybrid_score,
  CASE WHEN h.rank IS NOT NULL THEN h.content_contribution WHEN c.product_id IS NOT NULL THEN 0.25 END AS content_contribution,
  CASE WHEN h.rank IS NOT NULL THEN h.collaborative_contribution WHEN c.product_id IS NOT NULL THEN 0.25 END
    AS collaborative_contribution,
  CASE WHEN h.rank IS NOT NULL THEN h.nlp_contribution WHEN c.product_id IS NOT NULL THEN 0.0 END AS nlp_contribution,
  CASE WHEN h.rank IS NOT NULL THEN h.image_contribution WHEN c.product_id IS NOT NULL THEN 0.0 END AS image_contribution,
  CASE WHEN h.rank IS NOT NULL THEN h.explanation WHEN c.product_id IS NOT NULL
       THEN 'Recommended based on overall catalog category matching and popularity.' END AS reasoning,
  CASE WHEN h.rank IS NOT NULL OR c.product_id IS NOT NULL
       THEN 'Transparent score attribution model based on weighted signal combination.' END AS notice
FROM lk LEFT JOIN hit h ON h.request_id = lk.request_id AND h.product_id = lk.product_id
LEFT JOIN catalog c ON c.product_id = lk.product_id""".replace("\n,\nlk", ",\nlk", 1)
