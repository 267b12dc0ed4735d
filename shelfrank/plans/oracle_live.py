"""DuckDB oracle SQL of the streaming, file and artefact queries: their batch counterparts."""

from __future__ import annotations

from .oracle import CATALOG, INTERACTIONS, ORACLE, RAW, cf_ctes, r4, rnd, with_
from .oracle_content import tfidf_ctes

EVENTS = """ev AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS user_id, 'P' || json_extract_string(props, '$.k') AS product_id,
    CAST(1 + (CAST(floor(value) AS BIGINT) % 5 + 5) % 5 AS DOUBLE) AS user_rating,
    CAST(least((day(ts) - 1) // 10, 2) AS INTEGER) AS slice
  FROM events WHERE event_type IN ('click', 'view', 'purchase'))"""

ORACLE["stream_ratings"] = with_(EVENTS) + f"""SELECT user_id, product_id, count(*) AS n, {rnd('avg(user_rating)', 6)} AS r
FROM ev GROUP BY user_id, product_id"""

ORACLE["stream_similarity"] = with_(EVENTS, cf_ctes("ev")) + f"SELECT item_i, item_j, {r4('sim')} AS sim FROM sim"

#: every slice's users are answered from the events of all slices up to it
ORACLE["stream_answers"] = with_(EVENTS, """seen AS (
  SELECT CAST(s AS VARCHAR) || '|' || user_id AS user_id, CAST(s AS VARCHAR) || '|' || product_id AS product_id, user_rating
  FROM ev JOIN range(0, 3) AS t(s) ON slice <= s)""", cf_ctes("seen")) + """,
top AS (
  SELECT user_id, product_id, predicted_score, row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, product_id) AS rank
  FROM cf_cand WHERE user_id IN (SELECT CAST(slice AS VARCHAR) || '|' || user_id FROM ev) QUALIFY rank <= 5)
SELECT CAST(split_part(user_id, '|', 1) AS BIGINT) AS slice, split_part(user_id, '|', 2) AS user_id, rank,
  split_part(product_id, '|', 2) AS product_id, predicted_score FROM top""".replace("\n,\ntop", ",\ntop", 1)

ORACLE["csv_catalog_dedup"] = with_(RAW) + """,
numbered AS (SELECT product_id, product_name, row_number() OVER (ORDER BY ordinal) - 1 AS ordinal FROM mapped),
d1 AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ordinal) = 1)
SELECT product_id, product_name, ordinal FROM d1
QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY ordinal) = 1""".replace("\n,\n", ",\n", 1)

ORACLE["catalog_sink"] = ORACLE["catalog_clean"]
ORACLE["browse_keyword_indexed"] = ORACLE["browse_keyword"]
ORACLE["artifact_lookup"] = ORACLE["product_lookup"]
ORACLE["artifact_ratings"] = with_(INTERACTIONS, cf_ctes()) + f"SELECT user_id, count(*) AS n_items, {r4('sum(r)')} AS sum_r FROM ratings GROUP BY user_id"

_TOP = tfidf_ctes().replace("FROM tf, ndocs GROUP BY term, n)", "FROM tf, ndocs GROUP BY term, n ORDER BY sum(tf) DESC, term LIMIT 60)")
ORACLE["vocabulary_topn"] = with_(CATALOG, _TOP) + f"""SELECT p.product_id, p.term, v.df, {rnd('p.w', 6)} AS w
FROM postings p JOIN vocab v USING (term)"""

_VALID = ORACLE["validate_catalog"]
_AT = _VALID.index("SELECT (n > 0")
ORACLE["validate_missing_columns"] = _VALID[:_AT] + f"""SELECT false AS passed, total_rows, ['category', 'price'] AS missing_columns,
  missing_product_ids, duplicate_product_ids, CAST(0 AS BIGINT) AS invalid_prices, invalid_ratings, empty_descriptions,
  invalid_image_urls, 'part' AS source FROM ({_VALID[_AT:]})
UNION ALL SELECT false, 0, ['category', 'price'], 0, 0, 0, 0, 0, 0, 'empty'"""

_FLAT = ORACLE["visual_query_audit"]
_CUT = _FLAT.index("SELECT t.product_id AS target_product_id")
ORACLE["visual_audit_nested"] = _FLAT[:_CUT].rstrip() + f""", flat AS ({_FLAT[_CUT:]})
SELECT target_product_id, target_product_name, target_category,
  CAST(coalesce(to_json(list(struct_pack(product_id := product_id, product_name := product_name, category := category,
    similarity_score := similarity_score, same_category := same_category) ORDER BY rank) FILTER (rank IS NOT NULL)), '[]') AS VARCHAR)
    AS top_visual_matches
FROM flat GROUP BY ALL"""
