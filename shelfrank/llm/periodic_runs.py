"""Periodic run detection: an online sparse diagonal DP over the words of every text.

A run is a stretch of words with smallest period ``q`` and at least ``max(min_words, min_repeats * q)``
words that no neighbouring word extends. On the diagonal of lag ``q`` it is a row of matches
``word[i] == word[i - q]``: every word whose earlier occurrence lies ``q`` back lets the active lag's
match length grow by one, and a diagonal that ends long enough is emitted at once.

What keeps the diagonals sparse are phrases in place of single words. Lags are walked in
bands ``(g/2, g]`` for ``g`` = 1, 2, 4, ...; in a band the "word" at ``i`` is the phrase of ``g`` words that
starts there. Inside a run with ``g/2 < q <= g`` two equal phrases are a multiple of ``q`` apart (a phrase
holds a whole period, and ``q`` is the smallest), and the run's ``4q`` words leave room for
phrases ``q`` apart. So the latest earlier occurrence decides, one lag is active at a time, every run shows on
its smallest period only, and a frequent word costs no more than a rare one. Phrases twice as long are
named from the pairs that still repeat near enough. Time is n log n, memory linear in a
group of ``GROUP_CHARS`` characters or one longer text.

Defined cases: a null or empty text has no words and no run; texts of any length are taken whole; repeated rows
are judged each; an empty table gives no rows; other columns are ignored. Ties for the best run of the report go to
the smallest start, then the smallest period. A null doc_id counts as the empty string in the checksum of the report.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, text_bytes

MIN_WORDS = 6
MIN_REPEATS = 4
GROUP_CHARS = 2_000_000
_FAR = np.iinfo(np.int64).max
_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN_TYPE)), ("collapsed", pa.string())])


def echoed(n: int, doc_id) -> np.ndarray:
    """Which of its n words a document says at each place: the report repeats the tail of one text in ten."""
    at = np.arange(n)
    h = crc_of(doc_id)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def grow_diagonals(at, lag, width: int, min_words: int, min_repeats: int):
    """Runs of one band, from the places (ascending) whose phrase of ``width`` words occurs ``lag`` words earlier."""
    found, active, first, last = [], 0, 0, -2

    def emit():
        length = last - first + width + active  # matched words plus the first period
        if active and length >= max(min_words, min_repeats * active):
            found.append((first - active, length, active))

    for i, d in zip(at.tolist(), lag.tolist()):
        if d != active or i != last + 1:
            emit()
            active, first = d, i
        last = i
    emit()
    return found


def find(ids: np.ndarray, room: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple]:
    """(start, length, period) of every run in ``ids``, texts set apart by ids that occur once.

    ``room`` is the largest period a run at each word can have, 0 at the separators.
    """
    found, at, name, g = [], np.arange(len(ids)), ids, 1
    while len(at) and g // 2 < room.max():
        order = np.argsort(name, kind="stable")
        ranked = name[order]
        same = ranked[1:] == ranked[:-1]
        gap = (at[order[1:]] - at[order[:-1]])[same]
        lag, ahead = np.full(len(at), _FAR), np.full(len(at), _FAR)
        lag[order[1:][same]] = gap
        ahead[order[:-1][same]] = gap
        near = room[at]
        hit = (lag > g // 2) & (lag <= g) & (lag <= near)
        found += grow_diagonals(at[hit], lag[hit], g, min_words, min_repeats)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(np.r_[0, ~same])
        live = np.minimum(lag, ahead) <= near
        at, number = at[live], number[live]
        second = np.searchsorted(at, at + g)
        second[second == len(at)] = 0
        both = at[second] == at + g if len(at) else np.zeros(0, bool)
        name = number[both] * (len(order) + 1) + number[second[both]]
        at = at[both]
        g *= 2
    return found


def runs_of(rows: list[tuple], echo: bool, min_words: int, min_repeats: int) -> list[tuple]:
    """(doc_id, runs by start then period, collapsed text) of each (doc_id, text)."""
    known: dict = {}
    said, parts, room, offsets, size = [], [], [], [], 0
    for k, (doc_id, text) in enumerate(rows):
        words = text_bytes(text).split()  # splits at exactly space and \x09-\x0D
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        if echo:
            places = echoed(len(words), doc_id)
            ids = ids[places]
            words = [words[p] for p in places.tolist()] if len(words) and places[-1] != len(words) - 1 else words
        said.append(words)
        parts += [ids, [-1 - k]]
        room += [np.full(len(ids), len(ids) // min_repeats), [0]]
        offsets.append(size)
        size += len(ids) + 1
    runs: list[list] = [[] for _ in rows]
    for start, length, period in find(np.concatenate(parts), np.concatenate(room), min_words, min_repeats):
        k = int(np.searchsorted(offsets, start, "right")) - 1
        runs[k].append((start - offsets[k], length, period))
    out = []
    for (doc_id, _), words, found in zip(rows, said, runs):
        found.sort(key=lambda r: (r[0], r[2]))
        if found:
            kept = np.ones(len(words), bool)
            for start, length, period in found:
                kept[start + period:start + length] = False
            words = [words[i] for i in np.flatnonzero(kept).tolist()]
        out.append((doc_id, [dict(zip(("start", "length", "period"), r)) for r in found],
                    b" ".join(words).decode("utf-8", "surrogatepass")))
    return out


def _groups(batch):
    rows, chars = [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        rows.append((doc_id, text))
        chars += len(text or "")
        if chars >= GROUP_CHARS:
            yield rows
            rows, chars = [], 0
    if rows:
        yield rows


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS, echo: bool = False) -> DataFrame:
    """``doc_id``, ``runs`` (by start, then period) and the ``collapsed`` text of every document.

    The collapsed text keeps the first period of each run and the words outside runs, joined by one space. ``echo``
    repeats the tails of some texts first (``echoed``). A map over rows.
    """
    def task(batches):
        for batch in batches:
            for rows in _groups(batch):
                cols = list(zip(*runs_of(rows, echo, min_words, min_repeats)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(task, f"doc_id long, runs {_RUNS}, collapsed string")


def report(docs: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest length / period, and digests of all runs and of the collapsed text."""
    found = find_runs(docs, echo=True)
    # exact order of the fractions, by cross products
    best = F.expr("""array_sort(runs, (a, b) -> CASE
        WHEN a.length * b.period <> b.length * a.period THEN IF(a.length * b.period > b.length * a.period, -1, 1)
        WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1)
        WHEN a.period <> b.period THEN IF(a.period < b.period, -1, 1) ELSE 0 END)""")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    top = F.get(best, F.lit(0))
    return found.select("doc_id", "runs", "collapsed", top.alias("top"), listed.alias("listed")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col("top")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
