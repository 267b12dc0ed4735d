"""Bounded-space online packing of token ids into fixed-length sequences.

Every input partition keeps at most ``open_windows`` unfinished sequences. A
document's ids are cut into full sequences plus a remainder; the remainder goes
to the open window it fits best. When none fits, the fullest window is emitted;
a gap of at least ``min_piece`` is first filled with the head of the remainder.
What is open at the end of a partition is merged over groups of ``fan_in``
partitions, again and again, until one group is left.

Defined cases: a null or empty text is the single end id 0; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

LENGTH = 1024
END_ID = 0
SPECIAL = "<|endoftext|>"
SPACE_STEP = 100_000
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, window long, task long")
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def long_space(text: str) -> bool:
    """Whether a whole step of ``SPACE_STEP`` characters is white space, as in every run of twice that."""
    return any(text[at:at + SPACE_STEP].isspace() for at in range(0, len(text) - SPACE_STEP + 1, SPACE_STEP))


class Encoder:
    """Ids of the tokenizer file. ``tiktoken`` runs the same vocabulary some four times
    faster; texts that hold the special string or a long white-space run (its pattern engine
    runs out of stack between 0.9 and 1 million) go through ``tokenizers`` itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole = json_path, None

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return [END_ID]
        if SPECIAL in text or long_space(text):
            if self.whole is None:
                from tokenizers import Tokenizer
                self.whole = Tokenizer.from_file(self.json_path)
            return [*self.whole.encode(text, add_special_tokens=False).ids, END_ID]
        return [*self.fast.encode_ordinary(text), END_ID]


class Windows:
    """At most ``limit`` open windows; a window is its fill and its pieces."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.open: list[list] = []

    def best(self, n: int):
        """The fullest window that still takes ``n`` ids, the oldest of equals."""
        found = None
        for w in self.open:
            if w[0] + n <= self.capacity and (found is None or w[0] > found[0]):
                found = w
        return found

    def fullest(self):
        return max(self.open, key=lambda w: w[0])

    def put(self, window, piece, n: int):
        if window is None:
            window = [0, []]
            self.open.append(window)
        window[1].append((piece, window[0]))
        window[0] += n
        return window

    def close(self, window):
        self.open.remove(window)
        return window[1]


def place(windows: Windows, start: int, length: int, cut, min_piece: int) -> Iterator[list]:
    """Place ids ``start..start+length``; ``cut(a, b)`` makes a piece. Yields finished windows."""
    cap = windows.capacity
    while length >= cap:
        yield [(cut(start, start + cap), 0)]
        start, length = start + cap, length - cap
    while length:
        w = windows.best(length)
        if w is None and len(windows.open) >= windows.limit:
            w = windows.fullest()
            gap = cap - w[0]
            if gap >= min_piece and length - gap >= min_piece:
                windows.put(w, cut(start, start + gap), gap)
                start, length = start + gap, length - gap
            yield windows.close(w)
            continue
        w = windows.put(w, cut(start, start + length), length)
        if w[0] == cap:
            yield windows.close(w)
        return


def _pack_task(paths, capacity, open_windows, min_piece):
    def run(batches):
        task = TaskContext.get().partitionId()
        encode, windows, n_done = Encoder(*paths), Windows(capacity, open_windows), 0
        rows: list[tuple] = []

        def flush(done, closed):
            nonlocal n_done
            for piece, offset in done:
                rows.append((*piece, (task << 36) | n_done if closed else None, offset,
                             None if closed else n_done, task))
            n_done += 1

        def table():
            out = pa.RecordBatch.from_pylist(
                [dict(zip([*COLUMNS, "window", "task"], r)) for r in rows], schema=_SCHEMA)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encode(text), "<u4")
                total = len(ids)

                def cut(a, b):
                    return doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), total

                for done in place(windows, 0, total, cut, min_piece):
                    flush(done, True)
            yield table()
        for w in list(windows.open):
            flush(w[1], False)
        yield table()
    return run


_SCHEMA = pa.schema([(c, pa.int64()) for c in [*COLUMNS, "window", "task"]])


def _merge_group(capacity, open_windows, last, level):
    """Merge the open windows of one group: whole windows are placed best-fit, longest first."""
    def run(key, pdf):
        windows, out, serial = Windows(capacity, open_windows), [], 0
        sizes = pdf.groupby(["task", "window"], sort=True)["length"].sum().sort_values(ascending=False, kind="stable")
        parts = dict(tuple(pdf.sort_values("offset").groupby(["task", "window"])))
        group = int(key[0])

        def flush(done, closed):
            nonlocal serial
            for (name, size), base in done:
                p = parts[name].copy()
                p["offset"] += base
                p["sequence_id"] = ((level << 58) | (group << 20) | serial) if closed else pd.NA
                p["window"] = pd.NA if closed else serial
                p["task"] = group
                out.append(p)
            serial += 1

        for name, size in sizes.items():
            size = int(size)
            w = windows.best(size)
            if w is None and len(windows.open) >= windows.limit:
                flush(windows.close(windows.fullest()), True)
            windows.put(w, (name, size), size)
        for w in list(windows.open):
            flush(w[1], last)
        res = pd.concat(out)
        return res.astype({c: "Int64" for c in res.columns})
    return run


def pack(docs: DataFrame, paths: tuple[str, str, str], capacity: int = LENGTH, open_windows: int = 32,
         min_piece: int = 32, fan_in: int = 64) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``) with their sequence and offset.

    ``paths`` are the tokenizer's JSON file, the same vocabulary as ranks, and its split
    pattern. The pieces are written once to the shared folder; the leftovers of the
    partitions (at most ``open_windows`` each) then go through merge rounds of ``fan_in``.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stash(src.mapInArrow(_pack_task(paths, capacity, open_windows, min_piece), PIECES))
    result = pieces.where("window IS NULL").select(COLUMNS)
    left = pieces.where("window IS NOT NULL")
    tasks = left.agg(F.max("task")).first()[0]
    level = 1
    while tasks is not None:
        groups, last = tasks // fan_in, tasks < fan_in
        merged = left.groupBy((F.col("task") / fan_in).cast("long").alias("g")).applyInPandas(
            _merge_group(capacity, open_windows, last, level), PIECES)
        if last:
            return result.unionByName(merged.select(COLUMNS))
        merged = stash(merged)
        result = result.unionByName(merged.where("window IS NULL").select(COLUMNS))
        left, tasks, level = merged.where("window IS NOT NULL"), groups, level + 1
    return result


def tokenizer_paths() -> tuple[str, str, str]:
    """Files of the public 50k byte-level vocabulary."""
    import public_tokenizers as p
    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
