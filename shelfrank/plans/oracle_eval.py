"""DuckDB oracle SQL for the holdout split, ranking metrics and multi-seed reports."""

from __future__ import annotations

from ..schemas import (ABLATION_CONFIGS, DEFAULT_EVAL_SEEDS, DEFAULT_WEIGHTS, IMAGE_TOGGLE_CONFIGS,
                       NLP_TOGGLE_CONFIGS, SENSITIVITY_CONFIGS)
from .oracle import CATALOG, INTERACTIONS, ORACLE, cf_ctes, norm_id, r4, with_


def split_cte(seeds) -> str:
    arr = "[" + ", ".join(str(int(s)) for s in seeds) + "]"
    return f"""sx AS (
  SELECT s.seed, i.user_id, i.product_id, i.user_rating,
         md5(CAST(s.seed AS VARCHAR) || ':' || i.user_id || ':' || i.product_id || ':' || CAST(i.user_rating AS VARCHAR)) AS k
  FROM interactions i, (SELECT unnest({arr}) AS seed) s WHERE i.user_id IS NOT NULL),
sr AS (
  SELECT *, row_number() OVER (PARTITION BY seed, user_id ORDER BY k, product_id, user_rating) AS rn,
         count(*) OVER (PARTITION BY seed, user_id) AS n FROM sx),
split AS (SELECT *, (n >= 2 AND rn <= greatest(1, floor(n * 0.2))) AS is_test FROM sr)"""


def metrics_sql(recs: str, truth: str, keys: list[str], ks: list[int]) -> str:
    """CTEs ``rel``, ``uk``, ``hk``, ``mu`` then per-(keys, k) means in ``met``."""
    kk = ", ".join(keys)
    kj = " AND ".join(f"r.{k} = uk.{k}" for k in keys)
    tj = " AND ".join(f"t.{k} = r.{k}" for k in keys)
    arr = "[" + ", ".join(str(k) for k in ks) + "]"
    return f"""rel AS (SELECT {kk}, user_id, count(*) AS n_rel FROM {truth} GROUP BY ALL),
uk AS (SELECT rel.*, kv.k FROM rel, (SELECT unnest({arr}) AS k) kv),
hk AS (
  SELECT {', '.join('uk.' + k for k in keys)}, uk.user_id, uk.k, count(DISTINCT r.product_id) AS hits,
         sum(1.0 / log2(r.rank + 1.0)) AS dcg
  FROM uk JOIN {recs} r ON {kj} AND r.user_id = uk.user_id AND r.rank <= uk.k
  JOIN {truth} t ON {tj} AND t.user_id = r.user_id AND t.product_id = r.product_id
  GROUP BY ALL),
mu AS (
  SELECT uk.*, coalesce(hk.hits, 0) AS hits, coalesce(hk.dcg, 0.0) AS dcg,
         list_sum(list_transform(range(1, least(uk.k, uk.n_rel) + 1), lambda i: 1.0 / log2(i + 1.0))) AS idcg
  FROM uk LEFT JOIN hk USING ({kk}, user_id, k)),
met AS (
  SELECT {kk}, k, {r4('avg(hits / k)')} AS precision_at_k, {r4('avg(hits / n_rel)')} AS recall_at_k,
         {r4('avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END)')} AS ndcg_at_k
  FROM mu GROUP BY ALL)"""


ORACLE["split_sizes"] = with_(INTERACTIONS, split_cte([42])) + """SELECT user_id, count(*) AS n,
  CAST(sum(CASE WHEN is_test THEN 0 ELSE 1 END) AS BIGINT) AS n_train,
  CAST(sum(CASE WHEN is_test THEN 1 ELSE 0 END) AS BIGINT) AS n_test FROM split GROUP BY user_id"""

ORACLE["test_split"] = with_(INTERACTIONS, split_cte([42])) + \
    "SELECT user_id, product_id, user_rating FROM split WHERE is_test"

ORACLE["precision_recall_ndcg"] = with_(
    CATALOG, INTERACTIONS, split_cte([42]),
    "train AS (SELECT user_id, product_id, user_rating FROM split WHERE NOT is_test)",
    cf_ctes("train"),
    f"truth AS (SELECT DISTINCT seed, {norm_id('user_id')} AS user_id, {norm_id('product_id')} AS product_id "
    "FROM split WHERE is_test AND user_rating >= 3.0)",
    """recs AS (
  SELECT 42 AS seed, user_id, product_id,
         row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, product_id) AS rank
  FROM cf_cand WHERE user_id IN (SELECT user_id FROM truth) QUALIFY rank <= 10)""",
    metrics_sql("recs", "truth", ["seed"], [5, 10])) + \
    "SELECT 'K = ' || CAST(k AS VARCHAR) AS cutoff, precision_at_k, recall_at_k, ndcg_at_k FROM met"


def _cfg_values(configs: dict, group: str | None = None) -> str:
    rows = []
    for name, w in configs.items():
        g = f", '{group}'" if group else ""
        rows.append(f"('{name}', {float(w['collaborative'])}{g})")
    cols = "configuration, w_collaborative" + (", comparison" if group else "")
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t({cols}))"


def seeded_sql(cfg_rel: str, keys: list[str], top_k: int = 5, n: int = 30) -> str:
    """CTE chain ending in ``met`` = per (configuration[, comparison], seed) means."""
    eff = "CASE WHEN c.w_collaborative > 0 THEN 1.0 ELSE c.w_collaborative END"
    ck = ", ".join(f"c.{k}" for k in keys if k != "seed")
    return with_(CATALOG, INTERACTIONS, split_cte(DEFAULT_EVAL_SEEDS),
                 f"""train AS (
  SELECT CAST(seed AS VARCHAR) || '|' || {norm_id('user_id')} AS user_id,
         CAST(seed AS VARCHAR) || '|' || {norm_id('product_id')} AS product_id, user_rating
  FROM split WHERE NOT is_test)""",
                 cf_ctes("train"),
                 f"""truth AS (SELECT DISTINCT seed, {norm_id('user_id')} AS user_id, {norm_id('product_id')} AS product_id
  FROM split WHERE is_test AND user_rating >= 3.0)""",
                 "tu AS (SELECT DISTINCT seed, user_id, CAST(seed AS VARCHAR) || '|' || user_id AS ukey FROM truth)",
                 f"""cft AS (
  SELECT user_id AS ukey, product_id AS pkey FROM cf_cand WHERE user_id IN (SELECT ukey FROM tu)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY predicted_score DESC, product_id) <= {n})""",
                 f"""pop AS (SELECT product_id FROM catalog
  QUALIFY row_number() OVER (ORDER BY rating DESC, price DESC, product_id) <= {n})""",
                 """cands AS (
  SELECT ukey, pkey FROM cft
  UNION ALL
  SELECT tu.ukey, CAST(tu.seed AS VARCHAR) || '|' || p.product_id FROM tu JOIN pop p ON true
  WHERE tu.ukey NOT IN (SELECT ukey FROM cft))""",
                 """sc AS (
  SELECT CAST(split_part(c.ukey, '|', 1) AS INTEGER) AS seed, split_part(c.ukey, '|', 2) AS user_id,
         split_part(c.pkey, '|', 2) AS product_id, coalesce(p.predicted_score, 0.0) AS raw
  FROM cands c LEFT JOIN pred p ON p.user_id = c.ukey AND p.product_id = c.pkey
  WHERE split_part(c.pkey, '|', 2) IN (SELECT product_id FROM catalog))""",
                 """nm AS (
  SELECT seed, user_id, product_id,
    CASE WHEN max(raw) OVER w = min(raw) OVER w THEN (CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END)
         ELSE least(greatest((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w), 0.0), 1.0) END AS nc
  FROM sc WINDOW w AS (PARTITION BY seed, user_id))""",
                 f"""recs AS (
  SELECT {ck}, n.seed, n.user_id, n.product_id,
         row_number() OVER (PARTITION BY {ck}, n.seed, n.user_id
                            ORDER BY {r4(f'({eff}) * n.nc')} DESC, n.product_id) AS rank
  FROM nm n, {cfg_rel} c QUALIFY rank <= {top_k})""",
                 f"tt AS (SELECT {ck}, t.* FROM truth t, {cfg_rel} c)",
                 metrics_sql("recs", "tt", keys, [top_k]))


def report_sql(keys: list[str], top_k: int = 5) -> str:
    kk = ", ".join(k for k in keys if k != "seed")
    parts = []
    for m, lab in (("precision_at_k", "P@K"), ("recall_at_k", "R@K"), ("ndcg_at_k", "NDCG@K")):
        std = f"CASE WHEN count({m}) > 1 THEN stddev_samp({m}) ELSE 0.0 END"
        ci = f"CASE WHEN count({m}) > 1 THEN 1.96 * ({std}) / sqrt(count({m})) ELSE 0.0 END"
        parts.append(f'{r4(f"avg({m})")} AS "{lab}_Mean", {r4(std)} AS "{lab}_Std", '
                     f'printf(\'%.4f ± %.4f\', {r4(f"avg({m})")}, {r4(ci)}) AS "{lab}_95CI"')
    return f"SELECT {kk}, {', '.join(parts)}, {top_k} AS Cutoff_K FROM met GROUP BY {kk}"


def _keys(group: bool) -> list[str]:
    return ["configuration"] + (["comparison"] if group else []) + ["seed"]


ORACLE["multi_seed_report"] = seeded_sql(_cfg_values(SENSITIVITY_CONFIGS), _keys(False)) + report_sql(_keys(False))
ORACLE["ablation"] = seeded_sql(_cfg_values(ABLATION_CONFIGS), _keys(False)) + report_sql(_keys(False))

_TOGGLES = (f"(SELECT * FROM {_cfg_values(IMAGE_TOGGLE_CONFIGS, 'image_comparison')} "
            f"UNION ALL SELECT * FROM {_cfg_values(NLP_TOGGLE_CONFIGS, 'nlp_comparison')})")
ORACLE["signal_toggles"] = seeded_sql(_TOGGLES, _keys(True)) + report_sql(_keys(True))

ORACLE["metrics_unpivot"] = seeded_sql(_cfg_values({**SENSITIVITY_CONFIGS, **ABLATION_CONFIGS}), _keys(False)) + \
    ", rep AS (" + report_sql(_keys(False)) + """)
SELECT configuration, 'P@K_Mean' AS metric, "P@K_Mean" AS score FROM rep
UNION ALL SELECT configuration, 'R@K_Mean', "R@K_Mean" FROM rep
UNION ALL SELECT configuration, 'NDCG@K_Mean', "NDCG@K_Mean" FROM rep"""

ORACLE["seed_summary_stats"] = seeded_sql(_cfg_values({"Full Hybrid": DEFAULT_WEIGHTS}), _keys(False)) + \
    ", lng AS (" + " UNION ALL ".join(
        f"SELECT configuration, '{m}' AS metric, {m} AS value FROM met"
        for m in ("precision_at_k", "recall_at_k", "ndcg_at_k")) + f""")
SELECT configuration, metric, {r4('avg(value)')} AS mean,
  {r4('CASE WHEN count(value) > 1 THEN stddev_samp(value) ELSE 0.0 END')} AS std,
  {r4('min(value)')} AS min, {r4('max(value)')} AS max,
  {r4('CASE WHEN count(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(value)) ELSE 0.0 END')} AS ci_95
FROM lng GROUP BY configuration, metric"""
