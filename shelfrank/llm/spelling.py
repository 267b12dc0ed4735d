"""Spelling variant grouping: blocked Gram matrices over letter counts.

One edit changes at most two letters' counts by one, so near words are at squared distance at most 2 of their
letter-count vectors: ``|x|^2 + |y|^2 - 2 x.y``, a NumPy product for a block of words against a block of the same
or the next length. Pairs within 2 are verified letter by letter.

Which words meet: the letters are dealt into four classes by frequency. At most two classes
differ between near words, so near words agree in every count of some two classes. A word goes to
the six groups of its letters in two classes; a pair counts in the first group that both share. Groups over ``block``
words are split by hash into tiles of two blocks each, so a task holds two blocks of one group whatever its size;
a word of a group of ``s`` blocks is copied ``s`` times.

Counting words pre-aggregates before the shuffle. What reaches the driver: the letter frequencies (at most
90 rows) and the largest count.

Defined cases: a null or empty text has no words; long texts and words are taken whole (wide rows are verified in slices);
ties go to the smallest word in code-point order; repeated rows are occurrences of their own; an empty table gives
no rows; other columns are ignored; a null doc_id counts as the empty string in the checksum.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
BLOCK = 2_048
CLASSES = 4
PAIRS = list(itertools.combinations(range(CLASSES), CLASSES - 2))
TYPO_MOD = 199
_CELLS = 1 << 22
_FLUSH = 200_000
_TILE = 1 << 31

# In Latin-1 a letter of the alphabet (A-Z, a-z, À-ÿ) is one byte; others become spaces.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))


def letter_runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters, A-Z lower-cased, as Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(_FOLD).split()


def mistyped(doc_id, run: bytes) -> bytes:
    """The report's planted typos: one run in 199 of a document loses a letter."""
    said = f"{'' if doc_id is None else doc_id}:".encode() + (run if run.isascii() else run.decode("latin-1").encode("utf-8"))
    h = zlib.crc32(said)
    if h % TYPO_MOD:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _count_task(typos: bool, min_chars: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                           pa.array(list(counts.values()), pa.int64())], schema=schema)

    def task(batches):
        counts: dict = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: dict = {}
                for run in letter_runs(text):
                    seen[run] = seen.get(run, 0) + 1
                for run, n in seen.items():
                    word = mistyped(doc_id, run) if typos else run
                    if len(word) >= min_chars:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > _FLUSH:
                    yield rows(counts)
                    counts = {}
        if counts:
            yield rows(counts)
    return task


def count_words(docs: DataFrame, typos: bool = False, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words with enough letters and occurrences."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = src.mapInArrow(_count_task(typos, min_chars), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def deal_letters(words: DataFrame) -> dict[int, int]:
    """Class of every letter (Latin-1 code): dealt by frequency, to and fro, so that the classes weigh alike."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''")
    ranked = letters.groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()  # at most 90 rows
    return {ord(r["letter"]): min(i % (2 * CLASSES), 2 * CLASSES - 1 - i % (2 * CLASSES)) for i, r in enumerate(ranked)}


def _keys_task(classes: dict[int, int]):
    """(group, word) for each of the word's groups: the pair of classes and the word's letters in them, sorted."""
    drop = [bytes(c for c, k in classes.items() if k not in pair) for pair in PAIRS]
    schema = pa.schema([("group", pa.string()), ("word", pa.string())])

    def task(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            groups = []
            for w in words:
                letters = bytes(sorted(w.encode("latin-1")))
                groups += [f"{j}{letters.translate(None, d).decode('latin-1')}" for j, d in enumerate(drop)]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()),
                                              pa.array([w for w in words for _ in PAIRS], pa.string())], schema=schema)
    return task


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of x and y (letters, of one length each, y's the same or one more) that one edit turns into each other."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    head = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= x.shape[1]


class LengthBlock:
    """Words of one length: letters, letter counts and squared norms."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.width = len(words[0])
        self.letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), self.width)

    def count(self, letters: np.ndarray):
        """Counts of ``letters`` (codes). Sums of squares stay exact: single precision up to 4,000 letters a word."""
        kind = np.float32 if self.width <= 4_000 else np.float64
        self.counts = np.stack([(self.letters == c).sum(axis=1) for c in letters], axis=1).astype(kind) \
            if len(letters) else np.zeros((len(self.words), 0), kind)
        self.norms = (self.counts * self.counts).sum(axis=1)


def gram_pairs(x: LengthBlock, y: LengthBlock, same: bool):
    """Index pairs within squared distance 2, by slices of the Gram matrix; ``same``: each pair of a block once."""
    step = max(1, _CELLS // len(y.words))
    for a in range(0, len(x.words), step):
        gram = x.counts[a:a + step] @ y.counts.T
        gram *= -2
        gram += x.norms[a:a + step, None]
        gram += y.norms[None, :]
        i, j = np.nonzero(gram <= 2)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        yield i, j


def near_in_tile(key: str, tile: list[tuple[int, bytes]], classes: dict[int, int], cross: bool = False):
    """Pairs of near words of a tile: (side, word) of one group; ``cross``: side 0 meets side 1, else itself."""
    pair = PAIRS[int(key[0])]
    sides: list[dict] = [{}, {}]
    for side, w in sorted(tile):
        sides[side].setdefault(len(w), []).append(w)
    blocks = [{n: LengthBlock(words) for n, words in s.items()} for s in sides]
    free = np.array([c for c, k in classes.items() if k not in pair])  # counts in the pair's classes are equal
    used = np.unique(np.concatenate([b.letters.ravel() for s in blocks for b in s.values()]))
    used = used[np.isin(used, free)]
    for b in itertools.chain(*(s.values() for s in blocks)):
        b.count(used)
    # the group counts a pair if its classes are the first two that agree
    early = [np.isin(used, [c for c, k in classes.items() if k == e]) for e in range(pair[1]) if e != pair[0]]
    found = []
    other = blocks[1] if cross else blocks[0]
    meets = [(x, other[n], not cross) for n, x in blocks[0].items() if n in other]
    meets += [(x, other[n + 1], False) for n, x in blocks[0].items() if n + 1 in other]
    if cross:
        meets += [(y, blocks[0][n + 1], False) for n, y in other.items() if n + 1 in blocks[0]]
    for x, y, same in meets:
        for i, j in gram_pairs(x, y, same):
            rows = max(1, _CELLS // y.width)
            for s in range(0, len(i), rows):
                p, q = i[s:s + rows], j[s:s + rows]
                ok = one_edit(x.letters[p], y.letters[q])
                p, q = p[ok], q[ok]
                for cols in early:
                    agree = (x.counts[p][:, cols] == y.counts[q][:, cols]).all(axis=1)
                    p, q = p[~agree], q[~agree]
                found += [(x.words[a], y.words[b]) for a, b in zip(p.tolist(), q.tolist())]
    return found


def _near_task(classes: dict[int, int]):
    schema = pa.schema([("word", pa.string()), ("other", pa.string())])

    def rows(found):
        a = [x.decode("latin-1") for x, _ in found]
        b = [y.decode("latin-1") for _, y in found]
        return pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string())], schema=schema)

    def pairs(key, tile):
        if len(tile) < 2:
            return []
        low, high = divmod(key[1], _TILE)
        return near_in_tile(key[0], tile, classes, low < high)

    def task(batches):
        key, tile, found = None, [], []
        for batch in batches:
            for g, t, side, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (g, t) != key:
                    found += pairs(key, tile)
                    key, tile = (g, t), []
                    if len(found) > _FLUSH // 2:
                        yield rows(found)
                        found = []
                tile.append((side, w.encode("latin-1")))
        yield rows(found + pairs(key, tile))
    return task


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, other``: every pair of words one insertion, deletion or replacement apart, in both directions."""
    classes = deal_letters(words)
    keyed = words.select("word").mapInArrow(_keys_task(classes), "group string, word string")
    sizes = keyed.groupBy("group").count().where("count > 1")  # a word alone meets none
    keyed = keyed.join(sizes, "group").withColumn("parts", F.ceil(F.col("count") / block).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    met = keyed.select("group", "word", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"))
    low, high = F.least("b", "x"), F.greatest("b", "x")
    tiles = met.select("group", (low.cast("long") * F.lit(_TILE) + high).alias("tile"),
                       F.when(F.col("b") > F.col("x"), 1).otherwise(0).alias("side"), "word")
    dealt = tiles.repartition("group", "tile").sortWithinPartitions("group", "tile")
    return dealt.mapInArrow(_near_task(classes), "word string, other string")


def follow(forms: DataFrame, largest: int, ratio: int = RATIO) -> DataFrame:
    """``word, root`` from ``word, form``: each step's count is ``ratio`` times the last's, which bounds the steps;
    every round doubles them."""
    links = math.floor(math.log(max(largest, 1), ratio)) + 1
    root = stash(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(links)) if links > 1 else 0):
        up = root.select(F.col("word").alias("root"), F.col("root").alias("further"))
        root = stash(root.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return root


def group_variants(words: DataFrame, block: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary ``word, n``.

    ``form`` is the near word of largest n (ties: smallest word), if that is at least ``ratio`` times the word's.
    """
    words = stash(words.select("word", "n"))
    near = near_words(words, block)
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = near.join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best"))
    told = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    told = stash(told)
    largest = words.agg(F.max("n")).first()[0] or 0
    root = follow(told.where("form IS NOT NULL"), largest, ratio)
    return told.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return group_variants(count_words(docs, typos=True))
