"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation. For each block of turns the lengths of headers, contents and
footers give offsets by a cumulative sum; scatter indices then copy all pieces at once into one
preallocated Arrow buffer, which becomes the string column without another copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import map_arrow

TURN, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that mark turns in this or other chat templates.
CONTROL = (TURN, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_BREAK = re.compile(r"(?=" + "|".join(map(re.escape, CONTROL)) + r")(.)", re.DOTALL)
_JOIN = re.compile(r"\\(.)", re.DOTALL)
_NEEDS = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
#: A conversation is written in chunks of about so many bytes, so one of any length fits in memory.
CHUNK_BYTES = 1 << 20
FORMATTED = "conv_id {id}, chunk int, first_turn long, n_turns int, text string, loss array<struct<start:int,length:int>>"


def escape(text: str) -> str:
    """Double backslashes and put one behind the first character of every control string."""
    return _BREAK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _JOIN.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


class Pool:
    """Headers of the roles seen, each stored once in a byte pool from which they are copied."""

    def __init__(self) -> None:
        self.place: dict[str, tuple[int, int]] = {}
        self.data = np.zeros(0, np.uint8)

    def of(self, role: str) -> tuple[int, int]:
        if role not in self.place:
            head = np.frombuffer(f"{TURN}{escape(role)}{SEP}".encode(), np.uint8)
            self.place[role] = (len(self.data), len(head))
            self.data = np.concatenate([self.data, head])
        return self.place[role]


_FOOT = np.frombuffer(END.encode(), np.uint8)


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy source[start : start + length] to out[to : to + length], for all pieces at once."""
    within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + within] = source[np.repeat(start, length) + within]


def format_block(roles: list[str], texts: pa.Array, groups: np.ndarray, pool: Pool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Format turns; groups: index of the first turn of each output string.

    Returns the strings, and where each turn's content starts (bytes, in its string) and its length.
    """
    raw = texts.to_pylist()
    if any(_NEEDS.search(t) for t in raw):
        texts = pa.array([escape(t) if _NEEDS.search(t) else t for t in raw], pa.large_string())
    texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    n = len(raw)
    begin = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    content = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    heads = np.array([pool.of(r) for r in roles], np.int64).reshape(-1, 2)
    lengths = np.stack([heads[:, 1], np.diff(begin), np.full(n, len(_FOOT))], axis=1)
    ends = np.cumsum(lengths)
    at = (ends - lengths.ravel()).reshape(-1, 3)
    buffer = pa.allocate_buffer(int(ends[-1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    _scatter(out, at[:, 0], pool.data, heads[:, 0], heads[:, 1])
    _scatter(out, at[:, 1], content, begin[:-1], lengths[:, 1])
    _scatter(out, at[:, 2], _FOOT, np.zeros(n, np.int64), lengths[:, 2])
    bounds = np.append(at[groups, 0], len(out)).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(groups), pa.py_buffer(bounds.tobytes()), buffer)
    own = np.repeat(bounds[:-1], np.diff(np.append(groups, n)))
    return strings, at[:, 1] - own, lengths[:, 1]


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """Slices of sorted turns: whole conversations together up to `limit` bytes, longer ones cut."""
    for batch in batches:
        size = np.array([len(t or "") for t in batch.column(3).to_pylist()], np.int64)
        start, held = 0, 0
        for i, s in enumerate(size):
            if held and held + s > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += s
        if start < batch.num_rows:
            yield batch.slice(start)


def format_conversations(conversations: DataFrame, limit: int = CHUNK_BYTES, loss_role: str = "assistant") -> DataFrame:
    """Formatted chunks of every conversation, in order: conv_id, chunk, first_turn, n_turns, text, loss.

    Turns are ordered by turn, then role, then text, so ties and repeated rows have one order; null
    turns come first, null roles and texts count as empty, rows with a null conv_id are one
    conversation. A conversation is one chunk unless it is longer than `limit`; its text is its
    chunks' texts, joined. loss: spans in bytes of what the loss role says. Extra columns are
    ignored. An empty table gives no rows. Rows of one conversation lie together and in order in
    one partition; they pass through in bounded blocks and are never gathered.
    """
    turns = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool()
        last, chunk, done = object(), 0, 0
        for block in _chunks(batches, limit):
            ids = block.column(0).to_pylist()
            roles = block.column(2).to_pylist()
            groups = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            strings, start, length = format_block(roles, block.column(3), np.array(groups, np.int64), pool)
            numbers, firsts, counts, loss = [], [], [], []
            for g, i in enumerate(groups):
                stop = groups[g + 1] if g + 1 < len(groups) else len(ids)
                chunk, done = (chunk + 1, done) if ids[i] == last else (0, 0)
                last = ids[i]
                numbers.append(chunk)
                firsts.append(done)
                counts.append(stop - i)
                loss.append([{"start": int(start[j]), "length": int(length[j])} for j in range(i, stop) if roles[j] == loss_role])
                done += stop - i
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in groups], block.column(0).type),
                    pa.array(numbers, pa.int32()),
                    pa.array(firsts, pa.int64()),
                    pa.array(counts, pa.int32()),
                    strings.cast(pa.string()),
                    pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
                ],
                ["conv_id", "chunk", "first_turn", "n_turns", "text", "loss"],
            )

    return map_arrow(ordered, run, FORMATTED.format(id=ordered.schema["conv_id"].dataType.simpleString()))


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted chunk."""
    turns = []
    for part in text.split(END)[:-1]:
        role, said = part[len(TURN) :].split(SEP, 1)
        turns.append((unescape(role), unescape(said)))
    return turns
