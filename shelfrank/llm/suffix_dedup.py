"""Repeated 200-byte strings by sampled suffixes, names and adjacent comparison.

The difference-cover scheme (sort sampled triples, recurse on their names, merge the
remaining suffixes, compare adjacent prefixes) on Spark:

* Names. A position's 8 bytes are its first name; three names 8 apart make the name of
  24 bytes, three of those the name of 72, and three of those cover all 200 bytes.
* Samples. Of the 177 positions at which a 24-byte triple starts inside a 200-byte string, the one with
  the smallest name is sampled (leftmost of equals). The choice depends on the string alone, so
  equal strings share their sample at the same offset: what a difference cover
  guarantees with two suffixes of three, here with about one in ninety. Each sample
  stands for the run of 200-byte strings that chose it.
* Sort. Sampled triples are counted by name on Spark; only names met twice go on.
* Merge. A remaining suffix starts d bytes before its sample and is named by (sample's
  name, d, its own 200 bytes' name). Samples whose whole surroundings (all the strings that chose them)
  are equal settle each other by a count, without their bytes. Of every distinct surrounding
  one sample goes on: those with equal names are brought together, their suffixes sorted,
  and adjacent equal ones mark their bytes.

Names are spread over buckets of bounded size. A name with more than ``hot`` distinct
surroundings is not put into one bucket: its suffixes become rows that Spark counts by name.

Texts are identified by two 64-bit hashes; copies of a text of 200 bytes or more are repeats as a
whole and take part once. Defined cases: a null text is empty; texts under 200 bytes lose
nothing; an empty table gives no rows; repeated rows and ids give a row each; other
columns are ignored (``strip`` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, text_bytes

LENGTH = 200
GRAM = 24
SPREAD = LENGTH - GRAM  # largest distance from a string's start to its sample
HOT = 20_000
BUCKET = 10_000
ROWS = 1_000  # samples whose suffix names are computed at once
CHUNK = 1 << 22
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LOW = np.uint64(0xFFFFFF)


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    return x ^ (x >> np.uint64(29))


def _triple(name, a: int, b: int, n: int):
    """Name of the three names at 0, ``a`` and ``b`` of each of the first ``n`` positions (last axis)."""
    return _mixed(name[..., :n] * _M[0] + name[..., a:a + n] * _M[1] + name[..., b:b + n] * _M[2])


def names24(buf: np.ndarray) -> np.ndarray:
    """Names of the 24 bytes at every position; ``buf`` is uint8, along the last axis."""
    n = buf.shape[-1]
    eight = np.zeros((*buf.shape[:-1], n - 7), np.uint64)
    for off in range(8):
        m = (n - off) // 8
        eight[..., off::8][..., :m] = np.ascontiguousarray(buf[..., off:off + 8 * m]).view(np.uint64)
    return _triple(_mixed(eight), 8, 16, n - GRAM + 1)


def names200(n24: np.ndarray) -> np.ndarray:
    """Names of the 200 bytes at every position, from the names of 24."""
    n72 = _triple(n24, 24, 48, n24.shape[-1] - 48)
    return _triple(n72, 72, 128, n72.shape[-1] - 128)


def samples(raw: bytes):
    """(position, first start, last start, name) arrays of the samples of a text."""
    out = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
        part = np.frombuffer(raw[at:at + CHUNK + LENGTH - 1], np.uint8)
        g = names24(part)
        low = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        width = 1
        while width * 2 <= SPREAD + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPREAD + 1 - width
        if rest:
            low = np.minimum(low[:-rest], low[rest:])
        pos = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
        last = np.r_[first[1:], len(pos)] - 1
        p = pos[first]
        out.append((p + at, first + at, last + at, g[p].view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _pack(p, first, last):
    return (p << 16) | ((p - first) << 8) | (p - last)


def _unpack(v):
    p = v >> 16
    return p, p - ((v >> 8) & 255), p - (v & 255)


def _keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2"), t.alias("text"))


def _sample_task(batches):
    import xxhash
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at in range(0, batch.num_rows, 500):
            raws = [text_bytes(t) for t in batch.column(2).slice(at, 500).to_pylist()]
            found = [samples(t) for t in raws]
            sizes = [len(f[0]) for f in found]
            p, first, last, h = (np.concatenate([f[i] for f in found]) for i in range(4))
            run = np.fromiter((digest(t[a:b + LENGTH]) for t, f in zip(raws, found) for a, b in zip(f[1].tolist(), f[2].tolist())),
                              np.uint64, len(p)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(k1[at:at + 500], sizes)), pa.array(np.repeat(k2[at:at + 500], sizes)), pa.array(h),
                 pa.array(_pack(p, first, last)), pa.array(run)], names=["k1", "k2", "h", "v", "run"])


def _surroundings_task(batches):
    """One row per sample that goes on: its place and the bytes around it."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = text_bytes(batch.column(2)[i].as_py())
            v = np.array(batch.column(3)[i].as_py(), np.int64)
            hot = (v >> 62) & 1
            p, first, last = _unpack(v & ~(1 << 62))
            for j in range(0, len(v), 5_000):
                s = slice(j, j + 5_000)
                ctx = [raw[max(0, q - SPREAD):q + LENGTH] for q in p[s]]
                h = names24(np.frombuffer(b"".join(c[min(q, SPREAD):min(q, SPREAD) + GRAM] for c, q in zip(ctx, p[s])),
                                          np.uint8).reshape(len(ctx), GRAM))[:, 0]
                n = len(ctx)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())),
                     pa.array(h.view(np.int64)), pa.array(p[s]), pa.array(p[s] - first[s]), pa.array(p[s] - last[s]),
                     pa.array(hot[s].astype(bool)), pa.array(ctx, pa.binary())],
                    names=["k1", "k2", "h", "p", "far", "near", "hot", "ctx"])


_CONTEXT = "k1 long, k2 long, h long, p long, far long, near long, hot boolean, ctx binary"


def suffix_names(ctx: list[bytes], p: np.ndarray, near: np.ndarray, far: np.ndarray):
    """(names, owned) of the 200-byte strings that start d = 0..SPREAD before each sample."""
    width = SPREAD + LENGTH
    buf = np.zeros((len(ctx), width), np.uint8)
    for i, (c, q) in enumerate(zip(ctx, p)):
        left = SPREAD - min(int(q), SPREAD)
        buf[i, left:left + len(c)] = np.frombuffer(c, np.uint8)
    names = names200(names24(buf))[:, ::-1]  # column d starts d bytes before the sample
    d = np.arange(SPREAD + 1)
    return names, (d >= near[:, None]) & (d <= far[:, None])


def _bucket_task(table: pa.Table) -> pa.Table:
    """Sort the suffixes of a bucket by name; adjacent equal ones mark their strings."""
    k1, k2, h, p, far, near = (table.column(c).to_numpy() for c in ("k1", "k2", "h", "p", "far", "near"))
    order = np.argsort(h, kind="stable")
    k1, k2, h, p, far, near = (x[order] for x in (k1, k2, h, p, far, near))
    ctx = table.column("ctx").take(pa.array(order)).to_pylist()
    cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    out, start = [], 0
    # whole names at a time, some thousand samples each
    for end in [*(c for i, c in enumerate(cuts) if i), len(h)]:
        if end - start < 4_000 and end != len(h):
            continue
        s = slice(start, end)
        keys = []
        for at in range(start, end, ROWS):
            t = slice(at, min(end, at + ROWS))
            names, owned = suffix_names(ctx[t], p[t], near[t], far[t])
            i, dist = np.nonzero(owned)
            key = _mixed(names[i, dist] + _mixed(h[t].view(np.uint64)[i] + dist.astype(np.uint64) * _M[1]))
            keys.append((key, (i + at - start).astype(np.int32), dist.astype(np.int16)))
        key, row, dist = (np.concatenate(k) for k in zip(*keys))
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(key), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        row, dist = row[hit], dist[hit]
        if len(row):
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            rows = row[at]
            most, least = np.maximum.reduceat(dist, at), np.minimum.reduceat(dist, at)
            out.append((k1[s][rows], k2[s][rows], p[s][rows] - most, p[s][rows] - least + LENGTH))
        start = end
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("k1", "k2", "a", "b"), cols)))


def _suffix_rows_task(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            t = batch.slice(at, 500)
            k1, k2, h, p, far, near = (t.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "h", "p", "far", "near"))
            names, owned = suffix_names(t.column("ctx").to_pylist(), p, near, far)
            row, dist = np.nonzero(owned)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (k1[row], k2[row], h[row], dist.astype(np.int64), names[row, dist].view(np.int64), p[row] - dist)],
                names=["k1", "k2", "h", "d", "name", "s"])


def repeated_spans(docs: DataFrame, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """``k1, k2, spans``: the covered byte ranges [a, b) of every text that has any.

    Shuffled: one small row per sample (about one in ninety bytes) twice, the texts once, and
    the distinct surroundings of repeated samples. A text's spans are bounded by its own length.
    """
    keyed = _keyed(docs).where(F.octet_length("text") >= LENGTH)
    found = stash(keyed.mapInArrow(_sample_task, "k1 long, k2 long, h long, v long, run long"))
    place = F.xxhash64("k1", "k2", "v")
    # written, so that the join reads it through a shuffle and a hot name's partition can be split
    named = stash(found.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select(F.col("h").alias("r_h")))
    again = stash(found.join(named, found.h == named.r_h, "left_semi").groupBy("k1", "k2", "v").agg(
        F.first("h").alias("h"), F.first("run").alias("run")))  # copies of a text add nothing

    reach = F.col("v").bitwiseAND(F.lit(0xFFFF))
    kinds = stash(again.groupBy("h", reach.alias("w"), "run").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "v")).alias("m")))
    settled = kinds.where("n > 1").select(F.col("h").alias("s_h"), F.col("w").alias("s_w"), F.col("run").alias("s_run"))
    at = F.shiftright("v", 16)
    equal = again.join(settled, (again.h == settled.s_h) & (reach == settled.s_w) & (again.run == settled.s_run), "left_semi").select(
        "k1", "k2", (at - F.shiftright("v", 8).bitwiseAND(F.lit(255))).alias("a"),
        (at - F.col("v").bitwiseAND(F.lit(255)) + LENGTH).alias("b"))

    # one sample of each distinct surrounding of a name that has several
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("c_h"), "c")
    mark = F.when(F.col("c") > hot, F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    going = kinds.join(several, kinds.h == several.c_h).select("m.k1", "m.k2", F.col("m.v").bitwiseOR(mark).alias("v"))
    per_text = going.groupBy("k1", "k2").agg(F.collect_list("v").alias("vs"))  # bounded by the text's length
    once = keyed.dropDuplicates(["k1", "k2"])
    around = stash(once.join(per_text, ["k1", "k2"]).select("k1", "k2", "text", "vs").mapInArrow(_surroundings_task, _CONTEXT))

    n = around.where("NOT hot").count()
    buckets = max(1, -(-n // bucket))
    usual = around.where("NOT hot").groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")) \
        .applyInArrow(_bucket_task, "k1 long, k2 long, a long, b long")

    single = around.where("hot")
    suffixes = single.mapInArrow(_suffix_rows_task, "k1 long, k2 long, h long, d long, name long, s long")
    pairs = suffixes.groupBy("h", "d", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = suffixes.join(pairs.select(F.col("h").alias("p_h"), F.col("d").alias("p_d"), F.col("name").alias("p_name")),
                         (F.col("h") == F.col("p_h")) & (F.col("d") == F.col("p_d")) & (F.col("name") == F.col("p_name")), "left_semi")
    loose = both.select("k1", "k2", F.col("s").alias("a"), (F.col("s") + LENGTH).alias("b"))
    spans = usual.unionByName(equal).unionByName(loose)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def merge_spans(spans, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def kept_bytes(raw: bytes, runs) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _runs(raw: bytes, copies: int, spans) -> list[tuple[int, int]]:
    if copies > 1 and len(raw) >= LENGTH:
        return [(0, len(raw))]
    return merge_spans([(s["a"], s["b"]) for s in spans or ()], len(raw))


def _with_spans(docs: DataFrame, columns) -> DataFrame:
    """The rows with ``text_``, ``copies`` (rows of that text) and ``spans`` as last columns."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*columns, t.alias("text_"), F.xxhash64(t).alias("d1"), F.xxhash64(F.lit("second"), t).alias("d2"))
    copies = _keyed(docs).where(F.octet_length("text") >= LENGTH).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spans = repeated_spans(docs)
    facts = stash(spans.join(copies, ["k1", "k2"], "full").select(
        "k1", "k2", F.coalesce("n", F.lit(1)).alias("copies_"), F.col("spans").alias("spans_")))
    return rows.join(facts, (rows.d1 == facts.k1) & (rows.d2 == facts.k2), "left").drop("d1", "d2", "k1", "k2")


def _report_task(batches):
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 500):
            for doc_id, text, copies, spans in zip(*(c.slice(at, 500).to_pylist() for c in batch.columns)):
                raw = text_bytes(text)
                runs = _runs(raw, copies or 1, spans)
                rows.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per document."""
    j = _with_spans(docs, [F.col("doc_id").cast("long").alias("doc_id")])
    return j.select("doc_id", "text_", "copies_", "spans_").mapInArrow(
        _report_task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes taken out of ``text``, all columns kept.

    A character that loses some of its bytes goes as a whole; ``n_chars`` follows the text if
    there is one; a row whose text is lost completely goes.
    """
    names = docs.columns
    j = _with_spans(docs, [F.col(c).alias(f"c{i}_") for i, c in enumerate(names)])
    at = names.index("text")

    def run(batches):
        for batch in batches:
            out, keep = [], []
            for text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("text_", "copies_", "spans_"))):
                raw = text_bytes(text)
                runs = _runs(raw, copies or 1, spans)
                new = kept_bytes(raw, runs).decode("utf-8", "ignore") if runs else text
                out.append(new)
                keep.append(bool(new) or not runs)
            cols = [batch.column(i) for i in range(len(names))]
            changed = pa.array([bool(s) or (c or 1) > 1 for s, c in zip(batch.column("spans_").to_pylist(), batch.column("copies_").to_pylist())])
            new = pa.array(out, pa.string())
            cols[at] = pa.compute.if_else(changed, new.cast(cols[at].type), cols[at])
            if "n_chars" in names:
                i = names.index("n_chars")
                size = pa.array([len(t) for t in out], pa.int64()).cast(cols[i].type)
                cols[i] = pa.compute.if_else(changed, size, cols[i])
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}_" for i in range(len(names))]).filter(pa.array(keep, pa.bool_()))

    from pyspark.sql.types import StructField, StructType
    schema = StructType([StructField(f"c{i}_", f.dataType, True) for i, f in enumerate(docs.schema)])
    return j.mapInArrow(run, schema).toDF(*names)
