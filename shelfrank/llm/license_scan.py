"""License scan: Aho-Corasick phrase search plus licence-expression evaluation.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.
An automaton over the space-joined words finds notice phrases (of phrases that cover each other the longest counts) and
identifier tags; the text after a tag is parsed as a licence expression (``and`` / ``or`` /
``with``) by a shunting-yard parser and evaluated to its label set. Identifiers are matched whole,
with their versions; unknown ones give no label.

Defined cases: a null or empty text has no words, labels or places and score 0; texts of any length are
taken whole, in time linear in their length; equal labels count once; rows are independent, so repeated rows
repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

# Base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# The scan's own notice phrases. Of phrases that cover each other the longest counts.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "under the isc license": "isc",
    "apache license version 1 1": "apache-1",
    "apache software license": "apache-1",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "bsd 4 clause license": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "academic free license": "afl",
    "open software license": "osl",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "universal permissive license": "upl",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "do what the fuck you want to public license": "wtfpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "creative commons public domain dedication": "cc0",
    "all rights reserved": "all-rights-reserved",
}
# The words of Creative Commons conditions, and how notices spell them.
CC_WORDS = {"nc": ["noncommercial", "non commercial"], "nd": ["noderivatives", "no derivatives", "noderivs"],
            "sa": ["sharealike", "share alike"]}
CC_KINDS = ["", "sa", "nc", "nd", "nc-sa", "nc-nd"]
TAG = "spdx license identifier"
# Licence identifiers as family -> (label, versions); "" stands for the family's bare name.
FAMILIES = {
    "mit": ("mit", ["", "0"]), "x11": ("mit", [""]), "isc": ("isc", [""]), "0bsd": ("bsd", [""]),
    "bsd": ("bsd", ["", "1-clause", "2-clause", "2-clause-patent", "3-clause", "3-clause-clear", "3-clause-lbnl", "4-clause"]),
    "apache": ("apache-2", ["2", "2.0"]), "apache-1": ("apache-1", ["", "0", "1"]),
    "mpl": ("mpl", ["", "1.0", "1.1", "2.0", "2.0-no-copyleft-exception"]),
    "gpl": ("gpl", ["", "1.0", "2.0", "3.0", "2", "3"]), "lgpl": ("lgpl", ["", "2.0", "2.1", "3.0", "3"]),
    "agpl": ("agpl", ["", "1.0", "3.0", "3"]), "gfdl": ("gfdl", ["", "1.1", "1.2", "1.3"]),
    "epl": ("epl", ["", "1.0", "2.0"]), "eupl": ("eupl", ["", "1.0", "1.1", "1.2"]), "cddl": ("cddl", ["", "1.0", "1.1"]),
    "cpl": ("cpl", ["1.0"]), "osl": ("osl", ["", "1.0", "2.0", "2.1", "3.0"]), "afl": ("afl", ["", "1.1", "2.0", "2.1", "3.0"]),
    "artistic": ("artistic", ["1.0", "2.0", "1.0-perl", "1.0-cl8"]), "bsl": ("bsl", ["1.0"]), "busl": ("busl", ["1.1"]),
    "sspl": ("sspl", ["1.0"]), "elastic": ("elastic", ["2.0"]), "zlib": ("zlib", [""]), "unlicense": ("unlicense", [""]),
    "wtfpl": ("wtfpl", [""]), "cc0": ("cc0", ["", "1.0"]), "ofl": ("ofl", ["", "1.0", "1.1"]), "ncsa": ("ncsa", [""]),
    "postgresql": ("postgresql", [""]), "python": ("python", ["2.0", "2.0.1"]), "psf": ("python", ["2.0"]), "php": ("php", ["3.0", "3.01"]),
    "ruby": ("ruby", [""]), "vim": ("vim", [""]), "openssl": ("openssl", [""]), "curl": ("curl", [""]), "ms": ("ms-pl", ["pl", "rl"]),
    "ecl": ("ecl", ["1.0", "2.0"]), "upl": ("upl", ["1.0"]), "odbl": ("odbl", ["1.0"]), "odc-by": ("odc-by", ["1.0"]),
    "pddl": ("pddl", ["1.0"]), "blueoak": ("blueoak", ["1.0.0"]), "mulanpsl": ("mulanpsl", ["1.0", "2.0"]), "w3c": ("w3c", [""]),
}
RESTRICTED = {"gpl", "agpl", "gfdl", "sspl", "busl", "elastic", "all-rights-reserved", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_FOLD = bytes((c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20)
              for c in range(256))
_TAG_RE = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n\r*]+)", re.I)
_IDENTIFIER = re.compile(r"[0-9-]")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+\-]*")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def _identifiers() -> dict[str, str]:
    """Every identifier and its label. Creative Commons: any kind, any version, ported or not (checked by ``label_of``)."""
    out = {f"{family}-{v}" if v else family: label for family, (label, versions) in FAMILIES.items() for v in versions}
    for kind in CC_KINDS:
        name = f"cc-by-{kind}" if kind else "cc-by"
        out |= {f"{name}-{v}" if v else name: name for v in ("", "1.0", "2.0", "2.5", "3.0", "4.0")}
    return out


IDENTIFIERS = _identifiers()
_LATER = re.compile(r"(\+|-only|-or-later)\Z")
_PORTED = re.compile(r"(cc-by(?:-(?:nc|nd|sa))*-\d\.\d)-(?:[a-z]{2,3}|igo)\Z")


def notices() -> dict[str, str]:
    """Notice phrases, those of Creative Commons made from their conditions."""
    out = dict(NOTICE_PHRASES)
    for kind in CC_KINDS:
        label = f"cc-by-{kind}" if kind else "cc-by"
        spelt = itertools.product(*(CC_WORDS[c] for c in kind.split("-"))) if kind else [()]
        for said in spelt:
            out[" ".join(["creative commons attribution", *said])] = label
            out[" ".join(["cc attribution", *said])] = label
        out[" ".join(["cc by", *kind.split("-")]).strip()] = label
    return {phrase: label for phrase, label in out.items() if phrase not in BASE_PHRASES and phrase != "cc by"}


def label_of(identifier: str) -> str | None:
    """Label of a whole identifier: the family with its version, ``+``, ``-only`` and ``-or-later`` aside."""
    name = _LATER.sub("", identifier.lower())
    return IDENTIFIERS.get(name) or IDENTIFIERS.get(_PORTED.sub(r"\1", name))


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None if the expression is malformed."""
    out, ops, operand = [], [], True
    for t in tokens:
        low = t.lower()
        if low in PRECEDENCE:
            if operand:
                return None
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = True
        elif t == "(":
            if not operand:
                return None
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if operand or not ops:
                return None
            ops.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> tuple[set, bool]:
    """(labels named, whether the expression can be met without a restricted licence)."""
    stack = []
    for t in postfix:
        if t not in PRECEDENCE:
            lab = label_of(t)
            stack.append(({lab} if lab else set(), lab is not None and lab not in RESTRICTED))
            continue
        (lb, fb), (la, fa) = stack.pop(), stack.pop()
        stack.append((la, fa) if t == "with" else (la | lb, fa or fb if t == "or" else fa and fb))
    return stack[0]


def expression_labels(text: str) -> tuple[set, bool] | None:
    """Longest well-formed expression at the start of ``text``; None if there is none.

    The words after a tag may run on into prose: the expression ends where an operand
    follows an operand, or where a word is neither a known licence nor looks like an identifier.
    """
    tokens, operand, depth = [], True, 0
    for t in _TOKEN.findall(text):
        low = t.lower()
        if low in PRECEDENCE:
            if operand:
                break
            operand = True
        elif t == ")":
            if operand or not depth:
                break
            depth -= 1
        elif not operand:
            break
        elif t == "(":
            depth += 1
        elif label_of(t) or _IDENTIFIER.search(t) or (tokens and tokens[-1].lower() == "with"):
            operand = False
        else:
            break
        tokens.append(t)
    while tokens:
        postfix = to_postfix(tokens)
        if postfix:
            return evaluate(postfix)
        tokens.pop()
    return None


def automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for phrase, label in {**BASE_PHRASES, **notices()}.items():
        a.add_word(f" {phrase} ", (phrase, label, phrase in BASE_PHRASES))
    a.add_word(f" {TAG} ", (TAG, None, False))
    a.make_automaton()
    return a


def longest(found: list[tuple[int, int, str]]) -> set[str]:
    """Labels of the matches (start, end, label) that lie in no longer match."""
    labels, reach = set(), None
    for start, _, label in sorted(found, key=lambda m: (-m[1], m[0])):
        if reach is None or start < reach:
            labels.add(label)
            reach = start
    return labels


def scan(auto, text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = [w.decode("utf-8", "surrogatepass") for w in words_of(text_bytes(text))]
    joined = " ".join(["", *words, ""])
    base, base_labels, tagged, found = [], set(), False, []
    for end, (phrase, label, is_base) in auto.iter(joined):
        if label is None:
            tagged = True
            continue
        found.append((end - len(phrase), end, label))
        if is_base:
            base_labels.add(label)
            base.append(end - len(phrase))
    if base:
        starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=1))  # where every word begins
        base = [bisect.bisect_left(starts, at) for at in base]
    labels = base_labels | longest(found)
    free = not labels & RESTRICTED
    if tagged:
        for m in _TAG_RE.finditer(text):
            named = expression_labels(m[1])
            if named:
                labels |= named[0]
                free = free and named[1]
    score = 0.0 if not labels else 1.0 if free else 0.5
    return (len(words), len(base), min(base, default=None), max(base, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                     ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                     ("labels", pa.string()), ("score", pa.float64())])


def _scan_task(batches):
    auto = automaton()
    for batch in batches:
        rows = [(d, *scan(auto, t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        cols = list(zip(*rows)) if rows else [[]] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base places, labels and a 0-1 score.

    ``score`` is 1 when every licence found can be met without a restricted one
    (non-commercial, strong copyleft, all rights reserved), 0.5 when not, 0 without licences.
    A map over rows: no shuffle, memory bounded by one batch.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_scan_task, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                      "base_labels string, labels string, score double")
