"""Language-model scores: exact unigram base and a hashed maximum-entropy model.

The corpus is cut into blocks of about two million tokens; a block is one row with its
documents' token ids and its own dictionary (word hashes). Word counts are a Spark
aggregation over the blocks' dictionaries, joined back to them, so they cover every training
document and no task holds the vocabulary.

The model predicts a word's class, then its member bucket in the class, from hashed features: the word before,
the pair before, and the word two back (a skip). The most frequent words have buckets of their own;
the others share hashed ones, inside which a word has its add-one share of the training counts. The weights
are trained on all training blocks in rounds: each task runs AdaGrad steps over its blocks from the round's
weights, and Spark averages the rows that changed, weighted by how often each was updated.

Words are known by 64-bit hashes. Defined cases: a null or empty text is the single
end token; without training rows every count is 0 and the model is uniform;
repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, stash, text_bytes

BLOCK_TOKENS = 1 << 21
CLASSES = MEMBERS = 16
OWN = 192  # buckets of single words; the other 64 are hashed
CLASS_ROWS, MEMBER_ROWS = 1 << 13, 1 << 15
FEATURES = 3
STEP = 16384  # tokens of one gradient step
ROUNDS = 2
CHUNK_ROWS = 1024  # weight rows that travel as one record
_END = b"\n"  # no word: words hold no white space
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BLOCK = ("block long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, "
          "hashes array<long>, train array<long>")


class _Ids(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def pack_ids(ids: np.ndarray) -> bytes:
    """Token ids as four byte planes, compressed: the high planes are nearly empty."""
    import zstandard
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ids(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def tokens_of(text: str | None) -> list[bytes]:
    return [*text_bytes(text).translate(_LOWER).split(), _END]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _block_task(mod, held_out, size):
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                        ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("hashes", pa.list_(pa.int64())),
                        ("train", pa.list_(pa.int64()))])

    def run(batches):
        import xxhash
        task, serial = TaskContext.get().partitionId(), 0
        words, ids, doc_ids, held, n = _Ids(), [], [], [], 0

        def block():
            flat = np.concatenate(ids)
            sizes = np.array([len(i) for i in ids], np.int32)
            train = np.bincount(flat[np.repeat(~np.array(held), sizes)], minlength=len(words))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) | serial]), one(doc_ids, pa.int64()), one(held, pa.bool_()), one(sizes, pa.int32()),
                 pa.array([pack_ids(flat)], pa.binary()), one(hashes, pa.int64()), one(train, pa.int64())],
                schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tokens_of(text)
                ids.append(np.fromiter(map(words.__getitem__, own), np.int64, len(own)))
                doc_ids.append(doc_id)
                held.append(crc_of(doc_id) % mod == held_out)
                n += len(own)
                if n >= size:
                    yield block()
                    words, ids, doc_ids, held, n, serial = _Ids(), [], [], [], 0, serial + 1
        if ids:
            yield block()
    return run


def mix(x, k: int):
    x = (x ^ (x >> np.uint64(31))) * _M[k]
    return x ^ (x >> np.uint64(29))


class Tables:
    """Bucket of every word, and the share of a word in its bucket."""

    def __init__(self, top: list[int], totals: dict[int, int], kinds: dict[int, int]):
        order = np.argsort(np.array(top, np.int64))
        self.top, self.at = np.array(top, np.int64)[order], order
        self.weight = np.array([totals.get(b, 0) + kinds.get(b, 0) + 1 for b in range(CLASSES * MEMBERS)], float)

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        out = OWN + ((hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(CLASSES * MEMBERS - OWN)).astype(np.int64)
        if len(self.top):
            i = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            own = self.top[i] == hashes
            out[own] = self.at[i[own]]
        return out


class Weights:
    """Class and member tables (float32), with the biases as last rows."""

    def __init__(self):
        self.classes = np.zeros((CLASS_ROWS + 1, CLASSES), np.float32)
        self.members = np.zeros((MEMBER_ROWS + CLASSES, MEMBERS), np.float32)


def contexts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashed features of every token [FEATURES, tokens]; texts start from nothing."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[starts] = 0
    two[starts] = 0
    second = starts[sizes > 1] + 1
    two[second] = 0
    return np.stack([mix(one, 0), mix(one * _M[1] + two, 1), mix(two, 2)])


_ONES = np.ones(max(CLASSES, MEMBERS), np.float32)


def _softmax(z):
    np.clip(z, -30, 30, out=z)
    np.exp(z, out=z)
    z /= (z @ _ONES[:z.shape[1]])[:, None]
    return z


def predict(w: Weights, feats: np.ndarray, target: np.ndarray):
    """(P(class), P(member | class), rows of both tables) of tokens with their bucket."""
    cls = target // MEMBERS
    rows_c = (feats & np.uint64(CLASS_ROWS - 1)).astype(np.uint16)
    rows_m = (mix(feats + cls.astype(np.uint64) * _M[0], 1) & np.uint64(MEMBER_ROWS - 1)).astype(np.uint16)
    zc = w.classes.take(rows_c[0], axis=0)
    zm = w.members.take(rows_m[0], axis=0)
    for k in range(1, FEATURES):
        zc += w.classes.take(rows_c[k], axis=0)
        zm += w.members.take(rows_m[k], axis=0)
    zc += w.classes[CLASS_ROWS]
    zm += w.members.take(MEMBER_ROWS + cls, axis=0)
    return _softmax(zc), _softmax(zm), rows_c, rows_m


def _row_sums(rows: np.ndarray, grad: np.ndarray):
    """(distinct rows, summed gradients, how often) for the same gradient on each feature's row."""
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")  # radix sort: the rows are 16-bit
    ranked = flat[order]
    at = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    return ranked[at].astype(np.int64), np.add.reduceat(grad.take(order % len(grad), axis=0), at, axis=0), np.diff(np.r_[at, len(flat)])


class Trainer:
    """AdaGrad from the round's weights; keeps how often each row was updated."""

    def __init__(self, w: Weights, rate: float = 0.15):
        self.w, self.rate = w, rate
        self.start = (w.classes.copy(), w.members.copy())
        self.square = [np.full(t.shape, 1e-3, np.float32) for t in self.start]
        self.count = [np.zeros(len(t)) for t in self.start]

    def update(self, k: int, table, rows, grad, n):
        self.square[k][rows] += grad * grad
        table[rows] -= self.rate * grad / np.sqrt(self.square[k][rows])
        self.count[k][rows] += n

    def step(self, feats, target):
        pc, pm, rows_c, rows_m = predict(self.w, feats, target)
        at = np.arange(len(target))
        cls = target // MEMBERS
        pc[at, cls] -= 1
        pm[at, target % MEMBERS] -= 1
        self.update(0, self.w.classes, *_row_sums(rows_c, pc))
        self.update(0, self.w.classes, np.array([CLASS_ROWS]), pc.sum(0, keepdims=True), np.array([len(target)]))
        self.update(1, self.w.members, *_row_sums(rows_m, pm))
        rows, grad, n = _row_sums(cls.astype(np.uint16), pm)
        self.update(1, self.w.members, rows + MEMBER_ROWS, grad, n)

    def deltas(self):
        """(table, chunk, update-weighted changes and counts as float32 bytes) of the rows that moved."""
        for k, now in enumerate((self.w.classes, self.w.members)):
            n = self.count[k][:, None]
            both = np.hstack([(now - self.start[k]) * n, n]).astype(np.float32)
            for at in range(0, len(both), CHUNK_ROWS):
                if self.count[k][at:at + CHUNK_ROWS].any():
                    yield k, at // CHUNK_ROWS, both[at:at + CHUNK_ROWS].tobytes()


def _arrays(batch, i):
    """(token hashes, sizes, held, ids, dictionary hashes) of one block row."""
    ids = unpack_ids(batch.column("ids")[i].as_py())
    hashes = np.asarray(batch.column("hashes")[i].values)
    sizes = np.asarray(batch.column("sizes")[i].values).astype(np.int64)
    held = batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
    return ids, hashes, sizes, held


def _train_task(weights, tables):
    def run(batches):
        import copy
        trainer = None
        for batch in batches:
            trainer = trainer or Trainer(copy.deepcopy(weights))
            for i in range(batch.num_rows):
                ids, hashes, sizes, held = _arrays(batch, i)
                buckets = tables.buckets(hashes)
                use = np.repeat(~held, sizes)
                feats = contexts(hashes[ids].view(np.uint64), sizes)[:, use]
                target = buckets[ids][use]
                for at in range(0, len(target), STEP):
                    trainer.step(feats[:, at:at + STEP], target[at:at + STEP])
        if trainer:
            rows = list(trainer.deltas())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                names=["k", "chunk", "task", "sums"])
    return run


def _sum_chunks(table: pa.Table) -> pa.Table:
    total = None
    for piece in table.column("sums"):
        a = np.frombuffer(piece.as_py(), np.float32)
        total = a.astype(float) if total is None else total + a
    return pa.table({"k": table.column("k")[:1], "chunk": table.column("chunk")[:1], "task": pa.array([0], pa.int64()),
                     "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


_SUMS = "k long, chunk long, task long, sums binary"


def train(blocks: DataFrame, tables: Tables, rounds: int = ROUNDS) -> Weights:
    """One pass over all training blocks, in ``rounds`` disjoint parts.

    The tasks' changes are summed by Spark over (chunk, task % 64), then over chunks;
    the driver gets the summed tables, whose size is fixed.
    """
    w = Weights()
    shapes = (w.classes.shape, w.members.shape)
    for r in range(rounds):
        part = blocks.select("block", "ids", "hashes", "sizes", "held").where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r)
        moved = part.mapInArrow(_train_task(w, tables), _SUMS)
        level = moved.groupBy("k", "chunk", F.pmod("task", F.lit(64)).alias("salt")).applyInArrow(_sum_chunks, _SUMS)
        for row in level.groupBy("k", "chunk").applyInArrow(_sum_chunks, _SUMS).collect():
            width = shapes[row["k"]][1]
            both = np.frombuffer(row["sums"], np.float32).reshape(-1, width + 1)
            change = both[:, :width] / np.maximum(both[:, width:], 1)
            table = (w.classes, w.members)[row["k"]]
            table[row["chunk"] * CHUNK_ROWS:][:len(change)] += change
    return w


def _score_task(weights, tables, n_train, n_kinds):
    import math
    unit = math.log10(n_train + n_kinds + 1)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, hashes, sizes, held = _arrays(batch, i)
                counts = np.zeros(len(hashes))
                for entry in (batch.column("counts")[i],):
                    if entry.is_valid:
                        flat = entry.values
                        counts[np.asarray(flat.field("lid"))] = np.asarray(flat.field("c"))
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                log = np.log10(counts + 1)
                buckets = tables.buckets(hashes)
                share = log - np.log10(tables.weight[buckets])
                feats, target = contexts(hashes[ids].view(np.uint64), sizes), buckets[ids]
                lp = share[ids]
                for at in range(0, len(ids), STEP):
                    s = slice(at, at + STEP)
                    pc, pm, _, _ = predict(weights, feats[:, s], target[s])
                    k = np.arange(len(target[s]))
                    lp[s] += np.log10(pc[k, target[s] // MEMBERS] + 1e-30) + np.log10(pm[k, target[s] % MEMBERS] + 1e-30)
                base = np.add.reduceat(log[ids], starts) - sizes * unit
                known = np.add.reduceat((counts > 0).astype(np.int64)[ids], starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(held), pa.array(sizes), pa.array(known),
                     pa.array(np.full(len(sizes), n_train)), pa.array(base), pa.array(np.add.reduceat(lp, starts))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, mod: int = 7, held_out: int = 2, block_tokens: int = BLOCK_TOKENS,
                    rounds: int = ROUNDS) -> DataFrame:
    """One row per document with the base and the model's log10 probability of its text.

    Rows whose crc32(doc_id as text) mod ``mod`` is ``held_out`` are scored but not learnt from.
    Shuffled: one row per (block, distinct word) for the counts and back, and the blocks once.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stash(src.mapInArrow(_block_task(mod, held_out, block_tokens), _BLOCK))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("hashes", "train")).alias("lid", "z")).select(
        "block", "lid", F.col("z.hashes").alias("h"), F.col("z.train").alias("n"))
    vocabulary = stash(entries.groupBy("h").agg(F.sum("n").alias("c")).where("c > 0"))
    top = [r["h"] for r in vocabulary.orderBy(F.desc("c"), "h").limit(OWN).collect()]
    hashed = F.lit(OWN) + F.pmod(F.shiftrightunsigned("h", 20), F.lit(CLASSES * MEMBERS - OWN))
    bucket = hashed
    if top:
        own = F.create_map(*(x for i, h in enumerate(top) for x in (F.lit(h), F.lit(i).cast("long"))))
        bucket = F.when(F.col("h").isin(top), own[F.col("h")]).otherwise(hashed)
    sums = vocabulary.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    tables = Tables(top, {r["b"]: r["c"] for r in sums}, {r["b"]: r["v"] for r in sums})
    n_train, n_kinds = sum(r["c"] for r in sums), sum(r["v"] for r in sums)
    weights = train(blocks, tables, rounds) if n_train else Weights()
    known = entries.join(vocabulary, "h").groupBy("block").agg(F.collect_list(F.struct("lid", "c")).alias("counts"))
    both = blocks.drop("train").join(known.select(F.col("block").alias("k_block"), "counts"), F.col("block") == F.col("k_block"), "left")
    return both.select("ids", "hashes", "sizes", "held", "doc_ids", "counts").mapInArrow(
        _score_task(weights, tables, n_train, n_kinds), _RESULT)
