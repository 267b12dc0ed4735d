"""Chat formatting with offset-aligned loss masks.

The template writes each turn as ``open text close``: ``<<SYS>>…<</SYS>>`` for system,
``[INST]…[/INST]`` for user, ``<s>…</s>`` for assistant and ``[ROLE]name[/ROLE]…[END]`` for any other role. A control string inside a text (or a
role's name) gets one backslash behind its first character, and one more if it has some, so
that reading back drops one: reversible, and a text can never open or close a turn.

A conversation is rendered as a whole and encoded once. Control strings are tokens of their own, with ids behind the
vocabulary's; token offsets are the running byte lengths of the ids. The sorted spans of the assistant's texts meet the sorted
token spans by binary search.

Spark sorts the rows by (conv_id, turn) over range partitions, so that a conversation with most of the rows is dealt over
many tasks; a task streams its rows and emits a part whenever the conversation ends, ``PART_CHARS`` are reached or the partition
ends. Turns meet only at control tokens, so the parts' ids in order are the ids of the whole. No task
holds more than a part (or one longer turn). The report's digests of whole conversations are
streamed from parts in order.

Defined cases: a null or empty text is an empty turn; a null role is the role with the empty name; texts of any length
are taken whole; equal turn numbers are ordered by role, then text (null turns first); repeated rows are turns of their
own; the rows of a null conv_id are one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import SPECIAL, long_space

# The template's control strings. Token ids follow this order behind the vocabulary.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE_OPEN, ROLE_CLOSE, END = "[ROLE]", "[/ROLE]", "[END]"
CONTROLS = [*(m for pair in MARKS.values() for m in pair), ROLE_OPEN, ROLE_CLOSE, END]
FIRST_CONTROL_ID = 50_257  # the vocabulary has 50,257 ids, its special token included
PART_CHARS = 500_000
LOSS_ROLE = "assistant"

_GUARDED = [*CONTROLS, SPECIAL]
_AHEAD = "|".join(rf"{re.escape(m[0])}(?=\\*{re.escape(m[1:])})" for m in _GUARDED)
_ESCAPE = re.compile(f"(?:{_AHEAD})")
_UNESCAPE = re.compile("(" + "|".join(rf"{re.escape(m[0])}(?=\\+{re.escape(m[1:])})" for m in _GUARDED) + r")\\")
_SPLIT = re.compile("|".join(re.escape(m) for m in sorted(CONTROLS, key=len, reverse=True)))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns and the byte spans of the texts that carry loss, sorted."""
    out, spans, at = [], [], 0
    for role, text in turns:
        opening, closing = MARKS.get(role) or (f"{ROLE_OPEN}{escape(role)}{ROLE_CLOSE}", END)
        body = escape(text)
        start = at + len(opening.encode("utf-8"))
        stop = start + len(body.encode("utf-8"))
        if role == LOSS_ROLE:
            spans.append((start, stop))
        at = stop + len(closing)
        out += [opening, body, closing]
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    opens = {pair[0]: role for role, pair in MARKS.items()}
    turns, at, role, name = [], 0, None, None
    for m in _SPLIT.finditer(formatted):
        mark, inner = m[0], formatted[at:m.start()]
        at = m.end()
        if mark in opens:
            role = opens[mark]
        elif mark == ROLE_OPEN:
            name = True
        elif mark == ROLE_CLOSE:
            role, name = unescape(inner), None
        else:
            turns.append((role, unescape(inner)))
            role = None
    return turns


class ChatEncoder:
    """Ids of formatted text. Byte lengths of the ids give the offsets. Texts with a very long white-space run go through
    the slower tokenizer, as the fast one's pattern engine runs out of stack on them."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.controls = {m: FIRST_CONTROL_ID + i for i, m in enumerate(CONTROLS)}
        self.fast = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.controls)
        self.allowed = set(CONTROLS)
        self.json_path, self.slow = json_path, None
        self.lengths = np.zeros(FIRST_CONTROL_ID + len(CONTROLS), np.int64)
        for raw, i in [*ranks.items(), *self.controls.items()]:
            self.lengths[i] = len(raw)

    def ids(self, text: str) -> np.ndarray:
        if not long_space(text):
            return np.asarray(self.fast.encode(text, allowed_special=self.allowed), np.int64)
        if self.slow is None:
            from tokenizers import AddedToken, Tokenizer
            self.slow = Tokenizer.from_file(self.json_path)
            self.slow.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in CONTROLS])
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset behind every token."""
        return np.cumsum(self.lengths[ids]) if len(ids) else np.zeros(0, np.int64)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a span; tokens and spans are sorted, so that each span is two binary searches."""
    mask = np.zeros(len(starts), bool)
    if spans and len(starts):
        lo, hi = np.array(spans, np.int64).T
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        edge = np.zeros(len(starts) + 1, np.int64)
        some = hi > lo  # an empty text has no token
        np.add.at(edge, first[some], 1)
        np.add.at(edge, last[some], -1)
        mask = np.cumsum(edge[:-1]) > 0
    return mask


def loss_texts(formatted: str, ids: np.ndarray, mask: np.ndarray, encoder: ChatEncoder) -> list[str]:
    """The unescaped texts under the mask, one per run of masked tokens."""
    raw, ends = formatted.encode("utf-8"), encoder.ends(ids)
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    begin = np.r_[0, ends]
    return [unescape(raw[begin[a]:begin[b]].decode("utf-8")) for a, b in edges.reshape(-1, 2).tolist()]


PARTS = ("conv_id long, part long, whole boolean, n_turns long, formatted string, ids array<int>, "
         "offsets array<int>, loss array<boolean>")
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()),
                    ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())),
                    ("loss", pa.list_(pa.bool_()))])


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _parts_of(batches, part_chars: int):
    """(conv_id, whole, turns) of a sorted stream; whole: begins and ends inside this partition, in one part.

    The first and the last conversation of a partition may go on next door.
    """
    conv, turns, size, split, first = None, [], 0, False, True
    for batch in batches:
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if turns and (c != conv or size >= part_chars):
                yield conv, c != conv and not (first or split), turns
                first, split = first and c == conv, c == conv
                turns, size = [], 0
            conv = c
            turns.append((role, text))
            size += len(role) + len(text)
    if turns:
        yield conv, False, turns


def _format_task(paths, part_chars: int):
    def task(batches):
        encoder, rows, size = ChatEncoder(*paths), [], 0
        base = TaskContext.get().partitionId() << 32
        for seq, (conv, whole, turns) in enumerate(_parts_of(batches, part_chars)):
            formatted, spans = render(turns)
            ids = encoder.ids(formatted)
            ends = encoder.ends(ids)
            starts = ends - encoder.lengths[ids]
            rows.append((conv, base + seq, whole, len(turns), formatted, ids, starts, loss_mask(starts, ends, spans)))
            size += len(formatted)
            if size >= part_chars:
                yield _table(rows, _PARTS)
                rows, size = [], 0
        if rows:
            yield _table(rows, _PARTS)
    return task


def format_conversations(convs: DataFrame, paths: tuple[str, str, str], part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted text, token ids, byte offset of every token and loss mask, in parts (``PARTS``).

    A usual conversation is one part; those of a longer one, or of one on the border of two
    partitions, follow each other by ``part``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    # the hash bounds what the range sampling carries; equal hashes stay together and are sorted by text
    keys = ["conv_id", "turn", "role", "h"]
    dealt = src.withColumn("h", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format_task(paths, part_chars), PARTS)


_DIGEST = "conv_id long, part long, whole boolean, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()),
                      ("turns", pa.binary()), ("loss", pa.binary()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64())])
_REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_REPORTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _lists(column) -> list[np.ndarray]:
    """The rows of a list column as arrays."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _read_task(paths):
    """Turns and loss text of every part, read back from the formatted text, the ids and the mask: digests of a whole
    conversation, the bytes of a part of one."""
    def task(batches):
        encoder = ChatEncoder(*paths)
        for batch in batches:
            rows = []
            ids, loss = _lists(batch.column(4)), _lists(batch.column(5))
            for i, (conv, part, whole, formatted) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
                turns = parse(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns).encode("utf-8")
                heard = "".join(loss_texts(formatted, ids[i], loss[i], encoder))
                raw = heard.encode("utf-8")
                if whole:
                    said, raw = hashlib.sha256(said).digest(), hashlib.sha256(raw).digest()
                rows.append((conv, part, whole, len(turns), said, raw, len(heard), len(formatted)))
            yield _table(rows, _DIGESTS)
    return task


def _join_task(batches):
    """One row per conversation from its parts in order; the digests grow with the stream."""
    conv, state, rows = None, None, []

    def done():
        n, said, heard, loss, chars = state
        rows.append((conv, n, said.hexdigest(), loss, heard.hexdigest(), chars))

    for batch in batches:
        for c, _, whole, n, said, heard, loss, chars in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if whole:
                rows.append((c, n, said.hex(), loss, heard.hex(), chars))
                continue
            if state is None or c != conv:
                if state:
                    done()
                conv, state = c, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
            state[0] += n
            state[1].update(said)
            state[2].update(heard)
            state[3] += loss
            state[4] += chars
        yield _table(rows, _REPORTS)
        rows = []
    if state:
        done()
    yield _table(rows, _REPORTS)


def report(convs: DataFrame, paths: tuple[str, str, str], part_chars: int = PART_CHARS) -> DataFrame:
    """Per conversation: turns, digests of its turns and of the text under the loss mask, read back from the parts.

    Only the parts of conversations that lie in several travel as bytes.
    """
    parts = format_conversations(convs, paths, part_chars).select("conv_id", "part", "whole", "formatted", "ids", "loss")
    read = parts.mapInArrow(_read_task(paths), _DIGEST)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_join_task, _REPORT)


# The conversation that the registered query adds.
PROBE_TEXT = "</s>[INST] ok [/INST]"


def with_probe(convs: DataFrame) -> DataFrame:
    """The conversations, and number -7: a user and an assistant who both say the probe text."""
    rows = [(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)]
    probe = convs.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return convs.select("conv_id", "turn", "role", "text").unionByName(probe)
