"""DuckDB oracle SQL for browse, lookup and health queries."""

from __future__ import annotations

from .oracle import CATALOG, INTERACTIONS, ORACLE, VECTORS, cf_ctes, norm_id, with_
from .oracle_content import tfidf_ctes

COLS = "product_id, product_name, category, description, price, rating, image_url"


def _page(where: str, page: int, limit: int) -> str:
    return with_(CATALOG) + f""", f AS (SELECT * FROM catalog WHERE {where}),
tot AS (SELECT count(*) AS n, greatest(1, CAST(ceil(count(*) / {limit}) AS INTEGER)) AS tp FROM f),
pg AS (SELECT least(greatest({page}, 1), tp) AS p FROM tot)
SELECT {COLS}, CAST(n AS BIGINT) AS total_items, p AS page, {limit} AS "limit", tp AS total_pages
FROM (SELECT *, row_number() OVER (ORDER BY ordinal, product_id) AS pos FROM f), tot, pg
WHERE pos > (p - 1) * {limit} AND pos <= p * {limit}""".replace("\n, f AS", ", f AS", 1)


ORACLE["browse_keyword"] = _page("lower(product_name) LIKE '%bolt%' OR lower(description) LIKE '%bolt%'", 2, 12)
ORACLE["browse_page"] = _page("lower(category) = 'small'", 3, 25)

ORACLE["browse_category"] = with_(CATALOG) + f"""SELECT lower(category) AS category_key,
  CAST(pos AS INTEGER) AS position, {COLS}, CAST(total_items AS BIGINT) AS total_items, 1 AS page, 12 AS "limit",
  CAST(greatest(1, ceil(total_items / 12)) AS INTEGER) AS total_pages
FROM (SELECT *, row_number() OVER (PARTITION BY lower(category) ORDER BY ordinal, product_id) AS pos,
             count(*) OVER (PARTITION BY lower(category)) AS total_items FROM catalog)
WHERE pos <= 12"""

ORACLE["product_lookup"] = with_(CATALOG) + f""", q AS (
  SELECT DISTINCT ' p' || CAST(l_partkey AS VARCHAR) || ' ' AS query_id FROM lineitem
  UNION SELECT DISTINCT 'p' || CAST(s_suppkey + 1000000 AS VARCHAR) FROM supplier)
SELECT q.query_id, {norm_id('q.query_id')} AS product_id, c.product_id IS NOT NULL AS found,
  c.product_name, c.category, c.description, c.price, c.rating, c.image_url
FROM q LEFT JOIN catalog c ON c.product_id = {norm_id('q.query_id')}""".replace("\n, q AS", ", q AS", 1)

ORACLE["health_summary"] = with_(CATALOG, INTERACTIONS, VECTORS, cf_ctes(), tfidf_ctes()) + """SELECT
  (SELECT count(*) FROM catalog) AS catalog_products,
  (SELECT count(*) FROM interactions) AS interactions,
  (SELECT count(*) FROM ratings) AS rated_pairs,
  (SELECT count(DISTINCT user_id) FROM ratings) AS known_users,
  (SELECT count(*) FROM sim) AS similar_item_pairs,
  (SELECT count(*) FROM postings) AS tfidf_postings,
  (SELECT count(DISTINCT term) FROM postings) AS vocabulary_terms,
  (SELECT count(*) FROM vectors) AS vector_products"""
