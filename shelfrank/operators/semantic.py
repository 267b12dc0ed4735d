"""Semantic text vectors fitted on the catalog: the leading right singular vectors of its TF-IDF matrix.

``fit`` runs randomized subspace iteration on the long postings table. The basis ``V`` (terms x width) is a table
``(term, vec)``. One iteration is one pass over blocks of documents: a block's postings meet the basis rows of the block's terms
in one cogroup task, which multiplies ``Z = Xᵀ(X V)`` sparsely and emits a partial row per (block, distinct term). Spark adds the
partial rows, with map-side aggregation, so a term of nearly all documents costs a row per block. The basis is made orthonormal
by its Gram matrix (width x width, on the driver), which is also all that the last step needs to rotate it to singular vectors.

``fold`` maps any weighted texts into that space: the sum of their terms' vectors. Catalog and queries are folded alike; a
query's terms take the catalog's idf, unknown ones nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage, forget, ship_package

DIMS = 64
OVERSAMPLE = 8
ITERATIONS = 5
BLOCK_DOCS = 8_192
_SLICE = 200_000  # postings multiplied at once


def _multiply(weights, index, basis: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row i: the sum over its run of postings of weight times basis row; runs begin at ``starts`` (none is empty)."""
    out = np.zeros((len(starts), basis.shape[1]))
    stops = np.r_[starts[1:], len(weights)]
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + _SLICE, "right")))
        a, b = starts[at], stops[end - 1]
        out[at:end] = np.add.reduceat(weights[a:b, None] * basis[index[a:b]], starts[at:end] - a, axis=0)
        at = end
    return out


def _block(posts: pd.DataFrame, base: pd.DataFrame):
    """(row ids, term names, basis rows, postings sorted by row: weights, row starts, term codes) of a block."""
    terms = base["name"].to_numpy(dtype=object)
    basis = np.stack(base["vec"].to_numpy()).astype(np.float64)
    at = pd.Index(terms).get_indexer(posts["term"].to_numpy(dtype=object))
    posts, at = posts[at >= 0], at[at >= 0]
    rows, code = np.unique(posts["id"].to_numpy(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, at, w = code[order], at[order], posts["w"].to_numpy(dtype=np.float64)[order]
    return rows, terms, basis, w, np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), at, code


def _back_and_forth(key, posts: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    """Partial rows of ``Xᵀ(X V)`` from a block's documents."""
    if posts.empty or base.empty:
        return pd.DataFrame({"term": pd.Series([], dtype=object), "vec": pd.Series([], dtype=object)})
    rows, terms, basis, w, starts, at, code = _block(posts, base)
    y = _multiply(w, at, basis, starts)
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    z = _multiply(w[order], code[order], y, first)
    return pd.DataFrame({"term": terms[own[first]], "vec": list(z)})


def _fold_kernel(key, posts: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    if posts.empty or base.empty:
        return pd.DataFrame({"id": pd.Series([], dtype=object), "vec": pd.Series([], dtype=object)})
    rows, _, basis, w, starts, at, _ = _block(posts, base)
    return pd.DataFrame({"id": rows, "vec": list(_multiply(w, at, basis, starts))}) if len(w) else \
        pd.DataFrame({"id": pd.Series([], dtype=object), "vec": pd.Series([], dtype=object)})


def _dealt(postings: DataFrame, block_docs: int) -> DataFrame:
    """Postings with their document block; about ``block_docs`` documents each."""
    n = postings.agg(F.approx_count_distinct("id")).first()[0]
    return postings.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / block_docs)))).cast("int"))


def _with_basis(dealt: DataFrame, basis: DataFrame, kernel, schema: str) -> DataFrame:
    """Run the kernel on every block's postings and the basis rows of its terms."""
    # names of its own: both sides come from the same postings
    need = dealt.select(F.col("blk").alias("b"), F.col("term").alias("name")).distinct()
    need = need.join(basis.select(F.col("term").alias("name"), "vec"), "name")
    return dealt.groupBy("blk").cogroup(need.groupBy("b")).applyInPandas(kernel, schema)


def _sum_rows(parts: DataFrame, width: int) -> DataFrame:
    return parts.groupBy("term").agg(F.array(*[F.sum(F.col("vec")[i]) for i in range(width)]).alias("vec"))


def _gram(basis: DataFrame, width: int, other: str = "vec") -> np.ndarray:
    """``VᵀW`` over all terms: partial sums of partitions, width x width cells on the driver."""
    def part(batches):
        total = np.zeros((width, width))
        for frame in batches:
            if len(frame):
                total += np.stack(frame["vec"].to_numpy()).T @ np.stack(frame[other].to_numpy())
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})
    cols = ["vec"] if other == "vec" else ["vec", other]
    out = np.zeros((width, width))
    # stored, which drops the shuffles of what the basis is made from
    for r in cut_lineage(basis.select(*cols).mapInPandas(part, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))).collect():
        out[r["i"], r["j"]] = r["g"]
    return (out + out.T) / 2  # symmetric but for rounding


def _rotated(basis: DataFrame, turn: np.ndarray) -> DataFrame:
    """Every row times a small matrix."""
    def task(batches):
        for frame in batches:
            rows = np.stack(frame["vec"].to_numpy()) @ turn if len(frame) else np.zeros((0, turn.shape[1]))
            yield pd.DataFrame({"term": frame["term"], "vec": list(rows)})
    return basis.select("term", "vec").mapInPandas(task, "term string, vec array<double>")


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """A turn that makes the rows' columns orthonormal; directions without weight are dropped."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > values.max() * 1e-12
    return vectors[:, keep] / np.sqrt(values[keep])


def _next(basis: DataFrame, after: DataFrame) -> DataFrame:
    """Store the basis that follows and delete the one it was made from: each is as large as the vocabulary times the width."""
    stored = cut_lineage(after)
    forget(basis)
    return stored


class SemanticSpace:
    """``terms`` is ``(term, vec)``: the term's row of the right singular vectors; ``strengths`` are the singular values."""

    def __init__(self, terms: DataFrame, vocabulary: DataFrame, strengths: np.ndarray):
        self.terms, self.vocabulary, self.strengths = terms, vocabulary, strengths

    @classmethod
    def fit(cls, postings: DataFrame, vocabulary: DataFrame, dims: int = DIMS, iterations: int = ITERATIONS,
            oversample: int = OVERSAMPLE, block_docs: int = BLOCK_DOCS) -> "SemanticSpace":
        """``postings`` is ``(product_id, term, w)``, ``vocabulary`` ``(term, idf)``. Start signs come from a hash of the
        term, so that a fit can be repeated."""
        ship_package(postings.sparkSession)
        dealt = cut_lineage(_dealt(postings.select(F.col("product_id").alias("id"), "term", "w"), block_docs))
        width = dims + oversample
        start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                            lambda i: F.when(F.pmod(F.xxhash64("term", i), F.lit(2)) == 0, 1.0).otherwise(-1.0))
        basis = cut_lineage(dealt.select("term").distinct().withColumn("vec", start))
        for _ in range(iterations):
            turn = _orthonormal(_gram(basis, width))
            width = turn.shape[1]
            turned = _next(basis, _rotated(basis, turn))
            basis = _next(turned, _sum_rows(_with_basis(dealt, turned, _back_and_forth, "term string, vec array<double>"), width))
        turn = _orthonormal(_gram(basis, width))
        width = turn.shape[1]
        basis = _next(basis, _rotated(basis, turn))
        image = cut_lineage(_sum_rows(_with_basis(dealt, basis, _back_and_forth, "term string, vec array<double>"), width))
        squares, turn = np.linalg.eigh(_gram(basis.join(image.withColumnRenamed("vec", "img"), "term"), width, "img"))
        order = np.argsort(-squares)[:dims]
        order = order[squares[order] > squares.max() * 1e-12]
        terms = _next(basis, _rotated(basis, turn[:, order]))
        forget(image)
        forget(dealt)
        return cls(terms, cut_lineage(vocabulary.select("term", "idf")), np.sqrt(squares[order]))

    def fold(self, weighted: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
        """``(id, vec array<double>)`` of a table ``(id string, term, w)``; ids without a known term have no row."""
        return _with_basis(_dealt(weighted.select("id", "term", "w"), block_docs), self.terms, _fold_kernel, "id string, vec array<double>")

    def encode(self, df: DataFrame, id_col: str, text_col: str, out_id: str, out: str = "embedding") -> DataFrame:
        """Vectors of texts: TF-IDF with the catalog's idf, folded. A text without a known term gets a zero vector."""
        toks = df.select(F.col(id_col).cast("string").alias("id"), tx.unigrams(tx.analyzer_text(text_col)).alias("__u"))
        tf = toks.select("id", F.explode(tx.with_bigrams("__u")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
        vecs = self.fold(tf.join(self.vocabulary, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w")))
        ids = df.select(F.col(id_col).alias(out_id)).distinct()
        zero = F.array_repeat(F.lit(0.0), len(self.strengths))
        return ids.join(vecs, F.col(out_id).cast("string") == F.col("id"), "left").select(
            out_id, F.coalesce("vec", zero).cast("array<float>").alias(out))
