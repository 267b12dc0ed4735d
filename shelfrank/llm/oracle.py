"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .chat_format import END, MARKS, PROBE_TEXT, ROLE_CLOSE, ROLE_OPEN
from .url_filter import BASE_RULES, PATTERN_RULES

#: Every 200-byte string of every document, as hex; the ones that occur twice cover bytes.
OP1 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (SELECT r, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200),
k AS (SELECT w.r, w.i, md5(substr(n.h, 2 * w.i + 1, 400)) AS s FROM w JOIN n USING (r)),
twice AS (SELECT s FROM k GROUP BY s HAVING count(*) > 1),
rep AS (SELECT r, i FROM k WHERE s IN (SELECT s FROM twice)),
isl AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM rep),
grp AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM isl),
spans AS (SELECT r, g, min(i) AS a, max(i) + 200 AS b FROM grp GROUP BY r, g),
pieces AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p, a AS q FROM spans
  UNION ALL SELECT s.r, max(s.b), any_value(n.n) FROM spans s JOIN n USING (r) GROUP BY s.r),
kept AS (SELECT r, string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS h FROM pieces JOIN n USING (r) GROUP BY r),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY r)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op7() -> str:
    """Longest base rule by plain string comparison, then the pattern rules, then allow."""
    base = ", ".join(f"({_quoted(h + p)}, {_quoted(h)}, {_quoted(p)}, {_quoted(v)})" for v, h, p in BASE_RULES)
    block = " OR ".join(f"regexp_matches(host || path, {_quoted(rx)})" for v, _, rx in PATTERN_RULES if v == "block")
    return f"""WITH rules(rule, rhost, rpath, verdict) AS (VALUES {base}),
u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM u),
p AS (
  SELECT r, page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM s),
best AS (
  SELECT p.r, rule, verdict FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY p.r ORDER BY length(rule) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {block} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (r)"""


def op12() -> str:
    """Digests of the turns as given; the formatted length from the template and the escaped texts."""
    def escaped(col):
        angle = rf"regexp_replace({col}, '(<)(\\*(?:</?SYS>>|/?s>|\|endoftext\|>))', '\1\\\2', 'g')"
        return rf"regexp_replace({angle}, '(\[)(\\*(?:/?INST\]|/?ROLE\]|END\]))', '\1\\\2', 'g')"
    widths = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in MARKS.items())
    other = len(ROLE_OPEN + ROLE_CLOSE + END)
    return f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE_TEXT}'), (-7, 1, 'assistant', '{PROBE_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped('text')}) + CASE role {widths} ELSE {other} + length({escaped('role')}) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


#: crc32 bit by bit over the UTF-8 bytes; near words by shared remainders of a deletion.
_OP13 = """WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS h FROM r),
c AS (SELECT run, n, {crc} AS crc FROM h),
w AS (SELECT CASE WHEN crc % 199 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM c),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
p AS (SELECT word, unnest(range(length(word))) AS i FROM v),
x AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM p),
near AS (
  SELECT a.word, b.word AS other FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word
  UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
best AS (
  SELECT near.word, other, v.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS k
  FROM near JOIN v ON v.word = other),
told AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word AND k = 1),
path AS (
  SELECT word, word AS at, form AS next FROM told
  UNION ALL SELECT path.word, told.word, told.form FROM path JOIN told ON told.word = path.next)
SELECT told.word, told.form, path.at AS root, told.n, told.n_near, told.form_n
FROM told JOIN path ON path.word = told.word AND path.next IS NULL"""


def crc32(hexed: str) -> str:
    """crc32 of bytes in hex, bit by bit."""
    return f"""xor(4294967295, list_reduce(
    list_transform(range(4 * length({hexed})), lambda i: (('0x' || substr({hexed}, 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)) & 1),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295))"""


def op11(levels: int = 17) -> str:
    """Phrases of 1, 2, 4, ... words by doubling; islands of equal lags are diagonals."""
    ctes = [f"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))) AS hx FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws, {crc32('hx')} AS h FROM d),
n AS (SELECT *, len(ws) AS n, h // 10 AS g FROM w),
e AS (SELECT r, ws, n, CASE WHEN h % 10 = 0 THEN g % nullif(n, 0) END AS a, 3 + g % 8 AS k FROM n),
spot AS (SELECT *, unnest(range(n)) AS i FROM e),
said AS MATERIALIZED (SELECT r, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // k) ELSE i END] AS word FROM spot),
g0 AS MATERIALIZED (SELECT r, i, dense_rank() OVER (ORDER BY word) AS name FROM said QUALIFY count(*) OVER (PARTITION BY r, word) > 1)"""]
    for k in range(1, levels):
        ctes.append(f"""j{k} AS (
  SELECT a.r, a.i, dense_rank() OVER (ORDER BY a.name, b.name) AS name
  FROM g{k - 1} a JOIN g{k - 1} b ON b.r = a.r AND b.i = a.i + {1 << (k - 1)}),
g{k} AS MATERIALIZED (SELECT r, i, name FROM j{k} QUALIFY count(*) OVER (PARTITION BY r, name) > 1)""")
    bands = []
    for k in range(levels):
        g = 1 << k
        bands.append(f"""SELECT r, min(i) - d AS start, count(*) + {g - 1} + d AS length, d AS period FROM (
    SELECT r, i, d, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS island FROM (
      SELECT r, i, i - lag(i) OVER (PARTITION BY r, name ORDER BY i) AS d FROM g{k}) WHERE d > {g // 2} AND d <= {g})
  GROUP BY r, d, island HAVING count(*) + {g - 1} + d >= greatest(6, 4 * d)""")
    ctes.append("runs AS MATERIALIZED (\n  " + "\n  UNION ALL ".join(bands) + ")")
    return "WITH " + ",\n".join(ctes) + """,
told AS (
  SELECT r, count(*) AS n_runs, string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM said ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""


ORACLES = {"op1_suffix_dedup": OP1, "op7_url_filter": op7(), "op11_periodic_runs": op11(), "op12_chat_formatting": op12(),
           "op13_spelling_variants": _OP13.replace("{crc}", crc32("h"))}
