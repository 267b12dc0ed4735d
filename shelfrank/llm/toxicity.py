"""Toxicity by maximum-scoring token segments.

Learning (labelled rows only): every word and every word prefix of 4-8 letters gets a log-odds
ratio toxic / clean with an informative Dirichlet prior (the overall counts scaled to
``prior`` pseudo-counts) and a z-score; features above ``min_z`` form the lexicon.
Scoring: each token scores its best lexicon feature, others a small negative drift; a
linear-time scan (Ruzzo-Tompa) finds all maximal-scoring segments. A segment of score S
in a text of n tokens has the extreme-value (Karlin-Altschul) expectation
``K n exp(-lambda S)``, lambda being fitted on clean training texts; segments under ``max_e``
are passages. A logistic curve over the best and the summed normalised scores,
fitted on the training texts, gives the 0-1 score.

Defined cases: null and empty texts have no tokens and get the curve's value without
passages; without both kinds of labels nothing is learnt and every score is 0;
repeated rows repeat; repeated labels of an id count as toxic if one is.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hashed_sample

SAMPLE = 40_000  # labelled training rows the lexicon and the curve are fitted on, at most
LEXICON = 20_000  # features kept, at most
PREFIXES = range(4, 9)
DOC_CAP = 4  # occurrences of a feature that one text adds to the counts
DRIFT = -0.08
SLICE = 300  # texts whose counts are held at once
_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def _count_task(batches):
    """Feature counts of some hundred texts at a time: capped occurrences and texts, toxic and clean.

    Spark adds them up before the shuffle; a larger dictionary would only hold memory.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            totals: dict[str, list] = {}
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own: Counter = Counter()
                for w, c in Counter(tokens_of(text)).items():
                    for f in features_of(w):
                        own[f] += c
                own[""] = 1  # counts the texts
                for f, c in own.items():
                    t = totals.setdefault(f, [0, 0, 0, 0])
                    t[toxic] += min(c, DOC_CAP)
                    t[2 + toxic] += 1
            cols = list(zip(*totals.values())) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.string()), *(pa.array(c, pa.int64()) for c in cols)],
                names=["f", "c0", "c1", "d0", "d1"])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, mod: int = 5) -> DataFrame:
    """``text, toxic`` of at most ``sample`` labelled rows outside the held-out fold."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
           .where(F.col("l_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod(F.col("l_id"), mod) != 0))
           .groupBy("l_id").agg(F.max("toxic").alias("toxic")))
    lab = hashed_sample(lab, F.col("l_id"), sample)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.join(F.broadcast(lab), src.doc_id == lab.l_id).select("text", "toxic")  # at most ``sample`` label rows


def learn_lexicon(train: DataFrame, prior: float = 50.0, min_z: float = 4.0, limit: int = LEXICON) -> dict[str, float]:
    """feature -> log-odds. Copies of a text count once; the counts shuffle pre-aggregated."""
    once = train.groupBy(F.md5(F.col("text")).alias("k")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    counts = once.select("text", "toxic").mapInArrow(_count_task, "f string, c0 long, c1 long, d0 long, d1 long")
    total = counts.groupBy("f").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "d0", "d1")))
    # a feature without toxic texts, or with fewer than its share, cannot reach a positive z
    size = total.where("f = ''").collect()
    if not size or not size[0]["d0"] or not size[0]["d1"]:
        return {}
    n0, n1 = float(size[0]["d0"]), float(size[0]["d1"])

    def log_odds(a, b, na, nb):
        both = (F.col(a) + F.col(b)) / F.lit(na + nb) * F.lit(prior)
        x, y = F.col(a) + both, F.col(b) + both
        return F.log(y / F.lit(nb + prior)) - F.log(x / F.lit(na + prior)), F.sqrt(1 / x + 1 / y)
    delta, _ = log_odds("c0", "c1", n0, n1)
    presence, sigma = log_odds("d0", "d1", n0, n1)
    best = (total.where("f <> '' AND d1 >= 4").select("f", delta.alias("delta"), (presence / sigma).alias("z"))
            .where((F.col("z") >= min_z) & (F.col("delta") > 0.5)).orderBy(F.desc("z"), "f").limit(limit))
    return {r["f"]: float(r["delta"]) for r in best.collect()}


def token_scores(words: list[str], lexicon: dict[str, float], cache: dict[str, float]) -> list[float]:
    out = []
    for w in words:
        s = cache.get(w)
        if s is None:
            found = [lexicon[f] for f in features_of(w) if f in lexicon]
            if len(cache) > 200_000:
                cache.clear()
            s = cache[w] = max(found, default=DRIFT)
        out.append(s)
    return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            # the latest segment that starts from a lower sum: join with it if it also ends lower
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((start, i + 1, left, total))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


class Model:
    """Lexicon, extreme-value parameters and the logistic curve."""

    def __init__(self, lexicon: dict[str, float], lam: float = 1.0, big_k: float = 0.1, max_e: float = 0.5,
                 weights: tuple = (0.0, 0.0, 0.0, 0.0)):
        self.lexicon, self.lam, self.big_k, self.max_e, self.weights = lexicon, lam, big_k, max_e, weights
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(tokens, significant passages as start, end and -log of their expectation)."""
        words = tokens_of(text)
        scores = token_scores(words, self.lexicon, self.cache)
        if not words or max(scores) <= 0:
            return len(words), []
        size = math.log(self.big_k * len(words))
        found = [(a, b, self.lam * s - size) for a, b, s in segments(scores)]
        return len(words), [p for p in found if p[2] >= -math.log(self.max_e)]

    @staticmethod
    def statistics(n: int, found: list) -> tuple[float, float, float]:
        """What the curve reads of a text's tokens and passages."""
        values = [p[2] for p in found]
        return (math.log1p(max(values, default=0.0)), math.log1p(sum(values)), sum(values) / math.sqrt(n + 20.0))

    def score(self, n: int, found: list) -> float:
        if not self.lexicon:
            return 0.0
        x = self.statistics(n, found)
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit_lambda(freq: dict[float, float]) -> float:
    """Positive root of ``sum p exp(lambda s) = 1`` over the clean texts' token scores."""
    s, p = np.array(list(freq)), np.array(list(freq.values()), float)
    p /= p.sum()
    if s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0 if s.max() <= 0 else 0.05
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    return hi


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple:
    """Logistic regression by Newton steps (a few columns)."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _spectrum_task(lexicon):
    def run(batches):
        cache: dict[str, float] = {}
        for batch in batches:
            c: Counter = Counter()
            for t in batch.column(0).to_pylist():
                c.update(token_scores(tokens_of(t), lexicon, cache))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()), pa.array(list(c.values()), pa.int64())],
                                             names=["s", "n"])
    return run


def _statistics_task(model):
    def run(batches):
        for batch in batches:
            rows = [model.statistics(*model.passages(t)) for t in batch.column(0).to_pylist()]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in cols), batch.column(1)],
                                             names=["a", "b", "c", "y"])
    return run


def train_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows; what reaches the driver is bounded by
    ``sample`` rows of three numbers and ``LEXICON`` features."""
    train = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(train)
    if not lexicon:
        return Model({})
    clean = train.where("toxic = 0").select("text")
    freq = {r["s"]: r["n"] for r in clean.mapInArrow(_spectrum_task(lexicon), "s double, n long")
            .groupBy("s").agg(F.sum("n").alias("n")).collect()}
    model = Model(lexicon, fit_lambda(freq) if freq else 1.0)
    rows = np.array([tuple(r) for r in train.mapInArrow(
        _statistics_task(model), "a double, b double, c double, y int").collect()], float)
    model.weights = fit_curve(rows[:, :3], rows[:, 3])
    return model


def _score_task(model):
    def run(batches):
        for batch in batches:
            read = [model.passages(t) for t in batch.column(1).to_pylist()]
            found, scores = [r[1] for r in read], [model.score(*r) for r in read]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()),
                 pa.array([[{"first_token": a, "end_token": b, "evidence": s} for a, b, s in f] for f in found], _PASSAGES)],
                names=["doc_id", "score", "passages"])
    return run


_PASSAGES = pa.list_(pa.struct([("first_token", pa.int64()), ("end_token", pa.int64()), ("evidence", pa.float64())]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, passages`` of every row, a map without shuffle."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_score_task(model), "doc_id long, score double, passages array<struct<first_token: bigint, "
                                              "end_token: bigint, evidence: double>>")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            keep = [model.score(*model.passages(t)) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.select(names).mapInArrow(run, docs.schema)
