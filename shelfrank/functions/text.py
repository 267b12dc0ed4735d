"""String column functions (all JVM-side expressions, no Python UDFs).

Java regexes need ``(?U)`` for Unicode-aware ``\\s`` / ``\\w``; without it
accented letters are treated as punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (DEFAULT_CATEGORY, DEFAULT_DESCRIPTION, DEFAULT_NAME,
                       IMAGE_URL_SENTINELS, PLACEHOLDER_IMAGE_URL)
from .stopwords import ENGLISH_STOP_WORDS

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing (Unicode) whitespace."""
    return F.regexp_replace(_c(col), _EDGE_SPACE, "")


def norm_id(col) -> Column:
    """Identifier normalisation applied to every id: strip, then upper-case."""
    return F.upper(strip(col))


def clean_html(col) -> Column:
    """Remove ``<...>`` tags, collapse whitespace, strip; null -> ''."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return strip(c)


def default_if_empty(col, default: str) -> Column:
    c = _c(col)
    return F.when(c == "", F.lit(default)).otherwise(c)


def clean_name(col) -> Column:
    return default_if_empty(clean_html(col), DEFAULT_NAME)


def clean_category(col, default: str = DEFAULT_CATEGORY) -> Column:
    return default_if_empty(clean_html(col), default)


def clean_description(col, default: str = DEFAULT_DESCRIPTION) -> Column:
    return default_if_empty(clean_html(col), default)


def clean_image_url(col) -> Column:
    """Strip; null or one of the sentinel strings -> placeholder URL."""
    s = strip(F.coalesce(_c(col).cast("string"), F.lit("nan")))
    return F.when(s.isin(*IMAGE_URL_SENTINELS), F.lit(PLACEHOLDER_IMAGE_URL)).otherwise(s)


def title_case(col) -> Column:
    """Python ``str.title()``: upper-case a letter that follows a non-letter.

    ``initcap`` only capitalises after spaces (``T-shirt``); here the string is
    split into alternating letter / non-letter runs and every letter run is
    capitalised (``T-Shirt``, ``Men'S``).
    """
    runs = F.regexp_extract_all(F.lower(_c(col)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))
    return F.when(_c(col).isNull(), F.lit(None)).otherwise(F.array_join(cap, ""))


def analyzer_text(col) -> Column:
    """Tokeniser pre-clean: lower, non-word chars -> space, collapse, strip."""
    c = F.coalesce(_c(col).cast("string"), F.lit(""))
    c = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return strip(c)


def weighted_document(name, category, description) -> Column:
    """``name cat cat desc`` (category counted twice), each part pre-cleaned."""
    cat = analyzer_text(category)
    return F.concat_ws(" ", analyzer_text(name), cat, cat, analyzer_text(description))


def embedding_text(name, category, description) -> Column:
    """``{name} Category: {cat}. Description: {desc}`` with nulls as ''."""
    e = lambda c: F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.concat(e(name), F.lit(" Category: "), e(category), F.lit(". Description: "), e(description))


def unigrams(doc, stop_words=None) -> Column:
    """Tokens of 2+ word characters minus stop words (doc pre-cleaned)."""
    stop = F.array(*[F.lit(w) for w in (ENGLISH_STOP_WORDS if stop_words is None else stop_words)])
    return F.filter(F.split(_c(doc), " "), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def with_bigrams(toks) -> Column:
    """Unigrams plus bigrams of consecutive tokens. ``toks`` should be a
    column reference (materialised), not an expression, so it is evaluated
    once per row rather than once per bigram."""
    toks = _c(toks)
    n = F.size(toks)
    bigrams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(0))),
                          lambda i: F.concat_ws(" ", F.element_at(toks, i), F.element_at(toks, i + 1)))
    bigrams = F.when(n >= 2, bigrams).otherwise(F.array().cast("array<string>"))
    return F.concat(toks, bigrams)


def contains_term(col, term: str, regex: bool = False) -> Column:
    """Case-insensitive keyword predicate (literal by default)."""
    low = F.lower(_c(col))
    return low.rlike(term.lower()) if regex else low.contains(term.lower())
