"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Per document a few counts are taken from the whole text. Per (lang, source) group
a KLL sketch of every ratio is built (partial sketches per task, merged after the
shuffle); a group's fence is its upper quartile plus ``spread`` times its
interquartile range, never below a small floor so that a uniform group does not
reject its own ordinary documents. On the given data the floors decide every row (README,
with the verdicts of fences without them). Groups under ``min_group`` documents use the sketch of
their language, merged from the group sketches. The fences are joined back to the documents.

Defined cases: a null or empty text has no words (base_failed); null lang or
source form groups of their own; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

SYMBOLS = frozenset("#*$%&|<>")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Lowest fence of each ratio: a ratio under it never rejects a document.
FLOORS = {"symbol_ratio": 0.05, "dup_line_ratio": 0.50, "repeat_ratio": 0.30, "upper_ratio": 0.30, "word_length": 12.0}

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_UPPER = re.compile(r"[A-Z]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    words = [w for w in _SPACE.split(text) if w]
    n = len(words)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (n, sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeated_words(words),
            len(_UPPER.findall(text)), lines)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window which occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
    grams = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = grams[2][grams[1]] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k:n - 2 + k] |= hit
    return int(cover.sum())


def _count_task(batches):
    for batch in batches:
        rows = [counts(t) for t in batch.column(3).to_pylist()]
        cols = np.array(rows, np.int64).reshape(len(rows), len(COUNTS))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), *(pa.array(cols[:, i]) for i in range(len(COUNTS)))],
            names=["doc_id", "lang", "source", *COUNTS])


def measure(docs: DataFrame) -> DataFrame:
    """Counts and ratios of every document (a map, no shuffle)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                      F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    m = src.mapInArrow(_count_task, "doc_id long, lang string, source string, "
                       + ", ".join(f"{c} long" for c in COUNTS))

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return m.select("*", ratio("n_symbols", "word_chars").alias("symbol_ratio"),
                    ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
                    ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
                    ratio("n_upper", "word_chars").alias("upper_ratio"),
                    ratio("word_chars", "n_words").alias("word_length"))


def fences(measured: DataFrame, k: int = 200, spread: float = 3.0, min_group: int = 100) -> DataFrame:
    """One row per (lang, source) with the upper fence of every ratio.

    The sketches of the groups are merged per language for groups under ``min_group``.
    """
    ratios = list(FLOORS)
    by_group = measured.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(r, k).alias(r) for r in ratios))
    by_group = stash(by_group)
    by_lang = by_group.groupBy(F.col("lang").alias("l_lang")).agg(
        *(F.kll_merge_agg_double(r, k).alias(f"l_{r}") for r in ratios))
    j = by_group.join(by_lang, by_group.lang.eqNullSafe(by_lang.l_lang), "left")

    def fence(r):
        s = F.when(F.col("n") >= min_group, F.col(r)).otherwise(F.col(f"l_{r}"))
        q3 = F.kll_sketch_get_quantile_double(s, F.lit(0.75))
        q1 = F.kll_sketch_get_quantile_double(s, F.lit(0.25))
        return F.greatest(F.lit(FLOORS[r]), q3 + spread * (q3 - q1)).alias(f"max_{r}")
    return j.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(fence(r) for r in ratios))


def judge(docs: DataFrame, spread: float = 3.0, min_group: int = 100) -> DataFrame:
    """Counts, ratios, fences and the verdict of every document.

    The measured rows (numbers only) are written once; the groups shuffle as partial
    sketches. The fences, one row per group, are joined on (lang, source).
    """
    m = stash(measure(docs))
    f = fences(m, spread=spread, min_group=min_group)
    j = m.join(f, m.lang.eqNullSafe(f.f_lang) & m.source.eqNullSafe(f.f_source), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for r in FLOORS:
        within = within & (F.col(r) <= F.col(f"max_{r}"))
    return j.withColumn("base_failed", failed).withColumn("kept", ~failed & within)
