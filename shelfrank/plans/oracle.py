"""DuckDB SQL for each registered query (the correctness oracle).

Written independently of the Spark plans, as plain SQL over the driver's
views. Helpers below only build repeated SQL fragments. ``r4``/``r2`` round
the way Spark's ``round`` does on doubles (HALF_UP on the shortest decimal
form of the double), so exact decimal ties agree between the engines.
"""

from __future__ import annotations

from ..functions.stopwords import ENGLISH_STOP_WORDS

WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {n}) AS DOUBLE)"


def r4(x: str) -> str:
    return rnd(x, 4)


def r2(x: str) -> str:
    return rnd(x, 2)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm_id(x: str) -> str:
    return f"upper({strip(x)})"


def clean_html(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g')"
    return strip(inner)


def title(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
            f"regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
            f"lambda t: upper(t[1]) || t[2:]), '') END")


def analyzer(x: str) -> str:
    inner = f"regexp_replace(lower(coalesce(CAST({x} AS VARCHAR), '')), '[^\\w\\s]', ' ', 'g')"
    return strip(f"regexp_replace({inner}, '\\s+', ' ', 'g')")


STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"

PID = "'P' || CAST(p_partkey AS VARCHAR)"
RATING = "(CAST(2.5 AS DOUBLE) + CAST(p_partkey % 26 AS DOUBLE) / 10.0)"

CATALOG = f"""catalog AS (
  SELECT {PID} AS product_id,
         p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS VARCHAR) AS product_name,
         p_type AS category,
         p_name || ' ' || p_brand || ' ' || p_type || ' size ' || CAST(p_size AS VARCHAR) AS description,
         CAST(p_retailprice AS DOUBLE) AS price,
         {RATING} AS rating,
         'https://images.example.com/p' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url,
         p_partkey AS ordinal
  FROM part)"""

RAW = f"""raw_rows AS (
  SELECT {PID} AS item_id,
    CASE WHEN p_partkey % 31 = 0 THEN p_name
         WHEN p_partkey % 5 = 0 THEN '  ' || p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS VARCHAR) || ' <b>Sale</b> '
         ELSE p_name || ' ' || p_brand || ' ' || CAST(p_partkey AS VARCHAR) END AS product_title,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE lower(p_type) END AS product_category,
    CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_name || ' ' || p_brand || ' size ' || CAST(p_size AS VARCHAR) END
      AS product_description,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN -p_retailprice ELSE p_retailprice END
      AS unit_price,
    CASE WHEN p_partkey % 11 = 0 THEN CAST(6.5 AS DOUBLE) ELSE {RATING} END AS stars,
    CASE WHEN p_partkey % 19 = 0 THEN 'invalid_path'
         ELSE 'https://images.example.com/p' || CAST(p_partkey AS VARCHAR) || '.jpg' END AS imageURL,
    p_partkey AS ordinal
  FROM part),
raw_catalog AS (
  SELECT * FROM raw_rows
  UNION ALL
  SELECT item_id, product_title, product_category, product_description, unit_price, stars, imageURL,
         ordinal + 1000000000 FROM raw_rows WHERE ordinal % 50 = 0),
mapped AS (
  SELECT item_id AS product_id, product_title AS product_name, product_category AS category,
         product_description AS description, unit_price AS price, stars AS rating, imageURL AS image_url,
         ordinal, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS DOUBLE) AS user_rating
  FROM raw_catalog)"""

CLEAN = RAW + f""",
dd1 AS (SELECT * FROM mapped QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ordinal) = 1),
dd2 AS (SELECT * FROM dd1 QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY ordinal) = 1),
imp AS (
  SELECT product_id, ordinal, user_id, user_rating,
    {clean_html('product_name')} AS n0, {clean_html('category')} AS c0, {clean_html('description')} AS d0,
    {strip("coalesce(image_url, 'nan')")} AS u0,
    CASE WHEN isnan(TRY_CAST(price AS DOUBLE)) THEN NULL ELSE TRY_CAST(price AS DOUBLE) END AS p0,
    CASE WHEN isnan(TRY_CAST(rating AS DOUBLE)) THEN NULL ELSE TRY_CAST(rating AS DOUBLE) END AS r0
  FROM dd2),
med AS (SELECT median(p0) FILTER (WHERE p0 > 0) AS m FROM imp),
clean_catalog AS (
  SELECT {norm_id('product_id')} AS product_id,
    CASE WHEN n0 = '' THEN 'Unnamed Product' ELSE n0 END AS product_name,
    {title("CASE WHEN c0 = '' THEN 'Uncategorized' ELSE c0 END")} AS category,
    CASE WHEN d0 = '' THEN 'No description available.' ELSE d0 END AS description,
    CASE WHEN coalesce(p0, coalesce(m, 0.0)) < 0 THEN 0.0 ELSE coalesce(p0, coalesce(m, 0.0)) END AS price,
    least(greatest(coalesce(r0, 3.5), 0.0), 5.0) AS rating,
    CASE WHEN u0 IN ('nan', 'None', '') THEN 'https://images.example.com/placeholder.jpg' ELSE u0 END AS image_url,
    user_id, user_rating, ordinal
  FROM imp, med)"""

INTERACTIONS = """interactions AS (
  SELECT 'U' || CAST(o_custkey AS VARCHAR) AS user_id, 'P' || CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(1.0 AS DOUBLE) + CAST(floor((l_quantity - 1) / 10) AS DOUBLE) AS user_rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def cf_ctes(src: str = "interactions", prefix: str = "") -> str:
    """ratings / norms / sim / nb / pred CTEs over an interactions-shaped relation."""
    p = prefix
    return f"""{p}ratings AS (
  SELECT {norm_id('user_id')} AS user_id, {norm_id('product_id')} AS product_id, avg(user_rating) AS r
  FROM {src}
  WHERE user_id IS NOT NULL AND product_id IS NOT NULL AND user_rating IS NOT NULL AND NOT isnan(user_rating)
  GROUP BY ALL),
{p}norms AS (SELECT product_id, sqrt(sum(r * r)) AS norm FROM {p}ratings GROUP BY product_id),
{p}dots AS (
  SELECT a.product_id AS item_i, b.product_id AS item_j, sum(a.r * b.r) AS dot
  FROM {p}ratings a JOIN {p}ratings b ON a.user_id = b.user_id AND a.product_id < b.product_id
  GROUP BY ALL),
{p}sim AS (
  SELECT item_i, item_j, dot / (ni.norm * nj.norm) AS sim
  FROM {p}dots JOIN {p}norms ni ON ni.product_id = item_i JOIN {p}norms nj ON nj.product_id = item_j
  WHERE ni.norm > 0 AND nj.norm > 0 AND dot / (ni.norm * nj.norm) <> 0),
{p}nb AS (
  SELECT item_i, item_j, sim FROM {p}sim
  UNION ALL SELECT item_j, item_i, sim FROM {p}sim
  UNION ALL SELECT product_id, product_id, CAST(1.0 AS DOUBLE) FROM {p}norms WHERE norm > 0),
{p}pred AS (
  SELECT r.user_id, nb.item_i AS product_id,
         CASE WHEN sum(abs(nb.sim)) <> 0 THEN {r4('sum(nb.sim * r.r) / sum(abs(nb.sim))')} ELSE 0.0 END
           AS predicted_score
  FROM {p}ratings r JOIN {p}nb nb ON nb.item_j = r.product_id
  WHERE r.r > 0 GROUP BY ALL),
{p}cf_cand AS (
  SELECT p.* FROM {p}pred p
  WHERE p.predicted_score > 0 AND NOT EXISTS (
    SELECT 1 FROM {p}ratings r WHERE r.user_id = p.user_id AND r.product_id = p.product_id AND r.r > 0))"""


def cf_top(k: int, prefix: str = "") -> str:
    return f"""{prefix}cf_top AS (
  SELECT user_id, product_id, predicted_score,
         row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, product_id) AS rank
  FROM {prefix}cf_cand QUALIFY rank <= {k})"""


def popular_top(k: int) -> str:
    return f"""pop AS (
  SELECT row_number() OVER (ORDER BY rating DESC, price DESC, product_id) AS rank,
         product_id, product_name, category, price, rating, {r2('rating')} AS predicted_score,
         'Top-rated popular product across catalog (Cold-Start fallback)' AS explanation,
         'Cold-Start Popularity Strategy' AS recommendation_method
  FROM catalog QUALIFY rank <= {k})"""


REQUESTS = """requests AS (
  SELECT CAST(c_custkey AS BIGINT) AS request_id,
    CASE WHEN c_custkey % 4 <> 2 THEN
      CASE WHEN c_custkey % 7 = 0 THEN 'U' || CAST(c_custkey + 10000000 AS VARCHAR)
           ELSE 'U' || CAST(c_custkey AS VARCHAR) END END AS user_id,
    CASE WHEN c_custkey % 4 <> 0 THEN 'P' || CAST(c_custkey AS VARCHAR) END AS product_id,
    CASE WHEN c_custkey % 4 >= 2 THEN q.product_name END AS query,
    CAST(CASE WHEN c_custkey % 11 = 5 THEN 40 ELSE 5 + (c_custkey % 3) * 5 END AS INTEGER) AS top_k,
    CASE c_custkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.15 WHEN 2 THEN 0.15 WHEN 3 THEN NULL ELSE 0.9 END::DOUBLE
      AS w_content,
    CASE c_custkey % 5 WHEN 0 THEN 0.35 WHEN 1 THEN 0.55 WHEN 2 THEN 0.25 WHEN 3 THEN NULL ELSE 0.9 END::DOUBLE
      AS w_collaborative,
    CASE c_custkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.20 WHEN 2 THEN 0.50 WHEN 3 THEN NULL ELSE 0.1 END::DOUBLE
      AS w_nlp,
    CASE c_custkey % 5 WHEN 0 THEN 0.15 WHEN 1 THEN 0.10 WHEN 2 THEN 0.10 WHEN 3 THEN NULL ELSE 0.1 END::DOUBLE
      AS w_image
  FROM customer
  LEFT JOIN catalog q ON q.product_id = 'P' || CAST(c_custkey AS VARCHAR))"""

VECTORS = """vectors AS (
  SELECT 'P' || CAST(vec_id AS VARCHAR) AS product_id, CAST(label AS VARCHAR) AS category, embedding
  FROM embeddings)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["schema_map"] = with_(RAW) + "SELECT * FROM mapped"

ORACLE["catalog_dedup"] = with_(RAW) + """,
d1 AS (SELECT * FROM mapped QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ordinal) = 1)
SELECT product_id, product_name, ordinal FROM d1
QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY ordinal) = 1""".replace("\n,\n", ",\n", 1)

ORACLE["catalog_clean"] = with_(CLEAN) + """SELECT product_id, product_name, category, description, price, rating,
  image_url, user_id, user_rating FROM clean_catalog"""

ORACLE["html_clean_pages"] = f"SELECT page_id, {clean_html('html')} AS text FROM pages"

_TITLE_SRC = """(p_name || '-' || lower(p_type) || '''s ' || p_brand)"""
ORACLE["title_case"] = f"SELECT p_partkey, {title(_TITLE_SRC)} AS title FROM part"


def _validate_sql(src: str, has_ordinal_dup_null: bool = True) -> str:
    return f"""
SELECT (n > 0 AND mi = 0 AND dup = 0 AND ip = 0 AND ir = 0) AS passed, n AS total_rows,
  CAST([] AS VARCHAR[]) AS missing_columns,
  CASE WHEN n = 0 THEN 0 ELSE mi END AS missing_product_ids,
  CASE WHEN n = 0 THEN 0 ELSE dup END AS duplicate_product_ids,
  CASE WHEN n = 0 THEN 0 ELSE ip END AS invalid_prices,
  CASE WHEN n = 0 THEN 0 ELSE ir END AS invalid_ratings,
  CASE WHEN n = 0 THEN 0 ELSE ed END AS empty_descriptions,
  CASE WHEN n = 0 THEN 0 ELSE iu END AS invalid_image_urls
FROM (
  SELECT CAST(count(*) AS BIGINT) AS n,
    CAST(sum(CASE WHEN product_id IS NULL OR {strip('product_id')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS mi,
    CAST(count(*) - count(DISTINCT product_id) - max(CASE WHEN product_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dup,
    CAST(sum(CASE WHEN price IS NULL OR isnan(price) OR price < 0 THEN 1 ELSE 0 END) AS BIGINT) AS ip,
    CAST(sum(CASE WHEN rating IS NULL OR isnan(rating) OR rating < 0 OR rating > 5 THEN 1 ELSE 0 END) AS BIGINT) AS ir,
    CAST(sum(CASE WHEN description IS NULL OR {strip('description')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS ed,
    CAST(sum(CASE WHEN image_url IS NULL OR NOT regexp_matches(image_url,
      '(?i)^http|^\\.|^/|[a-zA-Z0-9_-]+\\.(?:jpg|jpeg|png|webp)') THEN 1 ELSE 0 END) AS BIGINT) AS iu
  FROM {src})"""


ORACLE["validate_catalog"] = with_(RAW) + _validate_sql("mapped")
ORACLE["validate_clean_catalog"] = with_(CLEAN) + _validate_sql("clean_catalog")

ORACLE["validation_details"] = with_(RAW) + ", rep AS (" + _validate_sql("mapped") + """)
SELECT severity, "check", n, severity || ': Found ' || CAST(n AS VARCHAR) || ' ' || what AS message FROM (
  SELECT 'ERROR' AS severity, 'missing_product_ids' AS "check", missing_product_ids AS n,
         'missing or blank product_ids.' AS what FROM rep
  UNION ALL SELECT 'ERROR', 'duplicate_product_ids', duplicate_product_ids, 'duplicate product_ids.' FROM rep
  UNION ALL SELECT 'WARNING', 'invalid_prices', invalid_prices, 'invalid or negative prices.' FROM rep
  UNION ALL SELECT 'WARNING', 'invalid_ratings', invalid_ratings, 'ratings outside the [0.0, 5.0] range.' FROM rep
  UNION ALL SELECT 'INFO', 'empty_descriptions', empty_descriptions, 'empty product descriptions.' FROM rep
  UNION ALL SELECT 'INFO', 'invalid_image_urls', invalid_image_urls, 'missing or malformed image paths/urls.' FROM rep
) WHERE n > 0"""

_PROFILE_COLS = [("product_id", "string"), ("product_name", "string"), ("category", "string"),
                 ("description", "string"), ("price", "double"), ("rating", "double"),
                 ("image_url", "string"), ("user_id", "string"), ("user_rating", "double")]
ORACLE["column_profile"] = with_(RAW) + ", agg AS (SELECT count(*) AS n, " + ", ".join(
    f"count({c}) AS nn_{c}" for c, _ in _PROFILE_COLS) + " FROM mapped)\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST(nn_{c} AS BIGINT) AS non_null, "
    f"CAST(n - nn_{c} AS BIGINT) AS missing, "
    f"CASE WHEN n > 0 THEN {r2(f'CAST(n - nn_{c} AS DOUBLE) * 100.0 / CAST(n AS DOUBLE)')} ELSE 0.0 END "
    f"AS missing_pct FROM agg" for c, t in _PROFILE_COLS)

ORACLE["category_distribution"] = with_(CLEAN) + \
    "SELECT category, count(*) AS n_products FROM clean_catalog GROUP BY category"

ORACLE["price_stats"] = with_(CLEAN) + f"""SELECT {r4('avg(price)')} AS mean, {r4('quantile_cont(price, 0.5)')} AS median,
  {r4('min(price)')} AS min, {r4('max(price)')} AS max, {r4('coalesce(stddev_samp(price), 0.0)')} AS std,
  {r4('quantile_cont(price, 0.25)')} AS q25, {r4('quantile_cont(price, 0.75)')} AS q75 FROM clean_catalog"""

ORACLE["rating_stats"] = with_(CLEAN) + f"""SELECT {r4('avg(rating)')} AS mean, {r4('quantile_cont(rating, 0.5)')} AS median,
  {r4('min(rating)')} AS min, {r4('max(rating)')} AS max FROM clean_catalog"""


def _hist_sql(col: str, bins: int) -> str:
    return with_(CLEAN) + f""", x AS (SELECT {col} AS x FROM clean_catalog WHERE {col} IS NOT NULL),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CASE WHEN hi - lo > 0 THEN CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER)
                  ELSE 0 END AS bin FROM x, rng),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT e.bin, {r4(f'lo + (hi - lo) / {bins} * e.bin')} AS bin_start, {r4(f'lo + (hi - lo) / {bins} * (e.bin + 1)')} AS bin_end,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(unnest(range(0, {bins})) AS INTEGER) AS bin) e CROSS JOIN rng LEFT JOIN c ON c.bin = e.bin"""


ORACLE["price_histogram"] = _hist_sql("price", 20)
ORACLE["rating_histogram"] = _hist_sql("rating", 10)

_OVERVIEW = ["product_id", "product_name", "category", "description", "price", "rating", "image_url"]
ORACLE["interaction_density"] = with_(CATALOG, INTERACTIONS) + f"""SELECT
  CAST(np AS BIGINT) AS num_products, CAST(nu AS BIGINT) AS num_users, CAST(ni AS BIGINT) AS num_interactions,
  CAST(nc AS BIGINT) AS num_categories, CAST(nip AS BIGINT) AS num_interacted_products,
  {r4('CAST(ni AS DOUBLE) / CAST(nu * np AS DOUBLE)')} AS density_catalog,
  {r4('1.0 - CAST(ni AS DOUBLE) / CAST(nu * np AS DOUBLE)')} AS sparsity_catalog,
  {r4('CAST(ni AS DOUBLE) / CAST(nu * nip AS DOUBLE)')} AS density_interacted,
  {r4('1.0 - CAST(ni AS DOUBLE) / CAST(nu * nip AS DOUBLE)')} AS sparsity_interacted,
  CAST(dup AS BIGINT) AS duplicate_product_ids, {', '.join(f'CAST(m_{c} AS BIGINT) AS missing_{c}' for c in _OVERVIEW)}
FROM (SELECT {', '.join(f'count(*) - count({c}) AS m_{c}' for c in _OVERVIEW)}, count(*) AS np, count(DISTINCT category) AS nc,
             count(*) - count(DISTINCT product_id) - max(CASE WHEN product_id IS NULL THEN 1 ELSE 0 END) AS dup
      FROM catalog) a,
     (SELECT count(*) AS ni, count(DISTINCT user_id) AS nu, count(DISTINCT product_id) AS nip FROM interactions) b"""

# ---------------------------------------------------------------- collaborative

ORACLE["ratings_mean"] = with_(INTERACTIONS, cf_ctes()) + "SELECT user_id, product_id, r FROM ratings"

ORACLE["item_similarity"] = with_(INTERACTIONS, cf_ctes()) + f"SELECT item_i, item_j, {r4('sim')} AS sim FROM sim"

ORACLE["item_neighbours"] = with_(INTERACTIONS, cf_ctes()) + f"""SELECT item_i, item_j, {r4('sim')} AS sim,
  row_number() OVER (PARTITION BY item_i ORDER BY {r4('sim')} DESC, item_j) AS rank
FROM nb WHERE item_i <> item_j QUALIFY rank <= 10"""

ORACLE["similarity_histogram"] = with_(INTERACTIONS, cf_ctes()) + f""", x AS (
  SELECT x FROM (SELECT {r4('sim')} AS x FROM sim) WHERE x < 0.999),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CASE WHEN hi - lo > 0 THEN CAST(least(floor((x - lo) / (hi - lo) * 30), 29) AS INTEGER) ELSE 0 END AS bin FROM x, rng),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT e.bin, {r4('lo + (hi - lo) / 30 * e.bin')} AS bin_start, {r4('lo + (hi - lo) / 30 * (e.bin + 1)')} AS bin_end,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS bin) e CROSS JOIN rng LEFT JOIN c ON c.bin = e.bin""".replace("\n, x AS", ", x AS", 1)

ORACLE["cf_predict"] = with_(INTERACTIONS, cf_ctes()) + """SELECT r.user_id, r.product_id,
  coalesce(p.predicted_score, 0.0) AS predicted_score
FROM ratings r LEFT JOIN pred p ON p.user_id = r.user_id AND p.product_id = r.product_id"""

_CF_ENRICH = """SELECT t.user_id, t.rank, t.product_id, coalesce(c.product_name, t.product_id) AS product_name,
  coalesce(c.category, 'Unknown') AS category, coalesce(c.price, 0.0) AS price, coalesce(c.rating, 0.0) AS rating,
  t.predicted_score, 'Recommended based on past item ratings by user ' || t.user_id AS explanation,
  'Collaborative Filtering (Item-Item)' AS recommendation_method
FROM cf_top t LEFT JOIN catalog c ON c.product_id = t.product_id"""

ORACLE["cf_topk"] = with_(CATALOG, INTERACTIONS, cf_ctes(), cf_top(10)) + _CF_ENRICH

ORACLE["popular_topk"] = with_(CATALOG, popular_top(10)) + "SELECT * FROM pop"

_POP = f"""SELECT CAST(row_number() OVER (ORDER BY rating DESC, price DESC, product_id) AS INTEGER) AS rank,
  product_id, product_name, category, price, rating, {r2('rating')} AS predicted_score,
  'Top-rated popular product across catalog (Cold-Start fallback)' AS explanation,
  'Cold-Start Popularity Strategy' AS recommendation_method"""
ORACLE["popular_in_category"] = with_(CATALOG) + f"""SELECT *, 'promo' AS asked FROM ({_POP} FROM catalog
  WHERE lower(category) = 'promo' OR NOT EXISTS (SELECT 1 FROM catalog WHERE lower(category) = 'promo') QUALIFY rank <= 10)
UNION ALL SELECT *, 'nothing' FROM ({_POP} FROM catalog QUALIFY rank <= 10)"""

ORACLE["popular_by_category"] = with_(CATALOG) + f"""SELECT lower(category) AS category_key,
  row_number() OVER (PARTITION BY lower(category) ORDER BY rating DESC, price DESC, product_id) AS rank,
  product_id, product_name, category, price, rating, {r2('rating')} AS predicted_score,
  'Top-rated popular product across catalog (Cold-Start fallback)' AS explanation,
  'Cold-Start Popularity Strategy' AS recommendation_method
FROM catalog QUALIFY rank <= 5"""

ORACLE["recommend_for_user"] = with_(CATALOG, VECTORS, INTERACTIONS, REQUESTS, cf_ctes(), popular_top(5)) + f""",
users AS (SELECT DISTINCT {norm_id('user_id')} AS user_id FROM requests WHERE user_id IS NOT NULL
          UNION SELECT 'U' || CAST(c_custkey AS VARCHAR) FROM customer),
known AS (SELECT DISTINCT user_id FROM ratings),
cf_top AS (
  SELECT user_id, product_id, predicted_score,
         row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, product_id) AS rank
  FROM cf_cand WHERE user_id IN (SELECT user_id FROM users) QUALIFY rank <= 5)
SELECT user_id, rank, product_id, product_name, category, price, rating, predicted_score, explanation,
       recommendation_method FROM ({_CF_ENRICH.replace(chr(10), ' ')})
UNION ALL
SELECT u.user_id, p.rank, p.product_id, p.product_name, p.category, p.price, p.rating, p.predicted_score,
       p.explanation, p.recommendation_method
FROM users u JOIN pop p ON true WHERE u.user_id NOT IN (SELECT user_id FROM known)""".replace("\n,\nusers", ",\nusers", 1)
