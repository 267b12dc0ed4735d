"""URL filter: pattern rules indexed by their rarest literal token.

A rule names a host (it and its subdomains fit) and a path prefix, or carries a
regular expression over ``host + path`` with the literal tokens it cannot do
without. The rules' tokens are counted over all URLs; a rule is filed under its
rarest one. A URL's distinct tokens fetch candidate rules, and only the
candidates' regular expressions run. The longest base rule that fits wins; pattern
rules decide URLs without one; then the default.

Defined cases: a null URL or one without ``://`` has empty host and path, no
rule and the default verdict; repeated rows repeat; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# Base rules as (verdict, host, path).
BASE_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# The filter's own rules for URLs without a base rule: (verdict, literal tokens, pattern).
PATTERN_RULES = [
    ("block", ["casino"], r"^([^/]*[.-])?casino[.-]"),
    ("block", ["pills"], r"^([^/]*[.-])?pills[.-]"),
    ("block", ["bets"], r"^([^/]*[.-])?bets[.-]"),
    ("block", ["ads"], r"^([^/]*\.)?ads[.-]"),
    ("block", ["xxx"], r"^([^/]*[.-])?xxx[.-]"),
    ("block", ["wp", "login"], r"/wp-login\.php"),
]
MAX_RULES = 100_000
SEPARATORS = "[^0-9a-zA-Z]+"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.substr(u, at + F.lit(3))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, host).otherwise(F.lit("")), F.when(at > 0, path).otherwise(F.lit(""))


def compile_rules(base, patterns) -> list[tuple]:
    """(rank, rule name or None, verdict, tokens, regex); the highest rank wins."""
    # a path may go on where the rule ends, so its last token counts only if a separator closes it
    out = [((1, len(host + path)), host + path, verdict,
            {*re.split(SEPARATORS, host), *re.split(SEPARATORS, path)[:-1]} - {""},
            rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}") for verdict, host, path in base]
    out += [((0, len(rx)), None, verdict, set(tokens), rx) for verdict, tokens, rx in patterns]
    if len(out) > MAX_RULES:
        raise ValueError(f"{len(out)} rules: the rule table goes to every task and holds {MAX_RULES} at most")
    if any(not r[3] for r in out):
        raise ValueError("every rule needs a literal token")
    return out


def rarest_tokens(urls: DataFrame, rules: list[tuple]) -> dict[str, list[int]]:
    """token -> numbers of the rules filed under it; the counts cover every URL."""
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rules for t in r[3]})], "token string")
    tokens = urls.select(F.explode(F.array_distinct(F.split(F.concat("host", "path"), SEPARATORS))).alias("token"))
    counted = tokens.join(F.broadcast(wanted), "token").groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counted.collect()}  # one row per rule token at most
    index: dict[str, list[int]] = {}
    for number, r in enumerate(rules):
        index.setdefault(min(sorted(r[3]), key=lambda t: seen.get(t, 0)), []).append(number)
    return index


def _filter_task(rules, index, default):
    def run(batches):
        compiled = [(rank, name, verdict, re.compile(rx).match if name else re.compile(rx).search)
                    for rank, name, verdict, _, rx in rules]
        cut = re.compile(SEPARATORS).split
        for batch in batches:
            names, verdicts, tried = [], [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                where = host + path
                candidates = [n for t in set(cut(where)) for n in index.get(t, ())]
                fit = [compiled[n] for n in candidates if compiled[n][3](where)]
                best = max(fit, key=lambda r: r[0], default=(None, None, default))
                names.append(best[1])
                verdicts.append(best[2])
                tried.append(len(candidates))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(tried, pa.int64())],
                names=["page_id", "host", "path", "rule", "verdict", "n_candidates"])
    return run


def filter_urls(pages: DataFrame, base=BASE_RULES, patterns=PATTERN_RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, n_candidates``, one row per page.

    Only the token counts shuffle (one row per rule token and task); the verdicts are a map.
    """
    rules = compile_rules(base, patterns)
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    index = rarest_tokens(urls, rules)
    return urls.mapInArrow(_filter_task(rules, index, default),
                           "page_id long, host string, path string, rule string, verdict string, n_candidates long")
