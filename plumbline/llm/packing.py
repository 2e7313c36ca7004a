"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition packs its pieces best-fit and writes out the bins that are nearly full. The
underfull bins go on as items of a tree of merges: fewer, larger groups of items are packed
best-fit again, until one round is left with few enough items for one task or stops helping.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from plumbline.llm.lexicon import SideMerger, byte_letters
from plumbline.llm.shared import cut, map_arrow, shared_path, ship_file

CAPACITY = 1024
END_ID = 2
#: A bin with at most this share of free tokens is written out before the last round.
SLACK = 1 / 64
#: Items that one task packs in a merge round.
GROUP_ITEMS = 200_000
#: Texts where a space may stand next to other white space.
_ODD_SPACE = "  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Letters and punctuation of chunks that are cut further, where the split is beyond doubt.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf" ?[{_LETTERS}]+[{_MARKS}]*(?:\n[{_LETTERS}]+[{_MARKS}]*)*")
_UNIT = re.compile(rf" ?[{_LETTERS}]+|[{_MARKS}]+|\n")
_SIMPLE = rf"^(?P<word>[{_LETTERS}]+)(?P<marks>[{_MARKS}]*)$"
#: Bytes of text that are cut up at once.
BLOCK_BYTES = 16 << 20
#: A unit that the tokenizer's split leaves whole.
_WHOLE = rf"^ ?[{_LETTERS}]+$"
#: Units up to this many bytes are merged side by side, so many cells of their matrix at a time.
SIDE_BYTES, SIDE_CELLS = 48, 1 << 17


class Encoder:
    """Ids of units as binary values of unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        self.side = SideMerger(model["vocab"], model["merges"], letters, letters)

    def ids(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units: whole words are merged side by side, the tokenizer is asked for others."""
        size = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = pc.match_substring_regex(units, _WHOLE).to_numpy(zero_copy_only=False) & (size <= SIDE_BYTES)
        others = units.filter(pa.array(~whole)).to_pylist()
        asked = [np.array(found.ids, "<u4") for found in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        order = np.flatnonzero(whole)
        order = order[np.argsort(size[order], kind="stable")]
        _, offsets, data = units.buffers()
        begin = np.frombuffer(offsets, np.int32)[units.offset : units.offset + len(units)].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        counts, found, at = np.zeros(len(units), np.int64), [], 0
        while at < len(order):
            width = -(-int(size[order[at]]) // 4) * 4
            stop = min(int(np.searchsorted(size[order], width, "right")), at + SIDE_CELLS // width)
            group = order[at:stop]
            cells = data[np.minimum(begin[group, None] + np.arange(width), len(data) - 1)]
            ids, counts[group] = self.side.cells(cells, size[group])
            found.append(ids.astype("<u4"))
            at = stop
        place = np.r_[order, np.flatnonzero(~whole)]
        counts[~whole] = [len(x) for x in asked]
        values = np.concatenate([*found, *asked, np.zeros(0, "<u4")])
        bounds = (4 * np.r_[0, np.cumsum(counts[place])]).astype(np.int32)
        stored = pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(bounds), pa.py_buffer(values)])
        back = np.empty(len(units), np.int64)
        back[place] = np.arange(len(units))
        return stored.take(pa.array(back))


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)


def _units(chunk: str) -> list[str]:
    """The byte-level split's tokens of a plain chunk; any other chunk as it is."""
    return _UNIT.findall(chunk) if _PLAIN.fullmatch(chunk) else [chunk]


def _grouped(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Binary values joined by groups of these sizes, without a copy."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    ends = np.ascontiguousarray(at[np.r_[0, np.cumsum(counts)]])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), data or pa.py_buffer(b"")])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of these sizes, one group after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _spaced_ids(chunks: pa.Array, encoder: Encoder) -> pa.Array:
    """Ids of distinct chunks that follow a space."""
    found = pc.extract_regex(chunks, _SIMPLE)
    ok = found.is_valid().to_numpy(zero_copy_only=False)
    simple = found.drop_null()
    words, marks = pc.binary_join_element_wise(pa.scalar(" "), simple.field("word"), ""), simple.field("marks")
    marked = pc.greater(pc.binary_length(marks), 0).to_numpy(zero_copy_only=False)
    others = [_units(" " + c) for c in chunks.filter(pa.array(~ok)).to_pylist()]
    counts = np.zeros(len(chunks), np.int64)
    counts[ok], counts[~ok] = 1 + marked, [len(u) for u in others]
    begin, rest = np.cumsum(counts) - counts, counts[~ok]
    order = np.empty(int(counts.sum()), np.int64)
    order[begin[ok]] = np.arange(len(words))
    order[begin[ok][marked] + 1] = len(words) + np.flatnonzero(marked)
    order[np.repeat(begin[~ok], rest) + _within(rest)] = 2 * len(words) + np.arange(int(rest.sum()))
    flat = pa.array([u for units in others for u in units], pa.string())
    units = pa.concat_arrays([words, marks, flat]).take(pa.array(order)).dictionary_encode()
    return _grouped(encoder.ids(units.dictionary).take(units.indices), counts)


def token_bytes(texts: pa.Array, encoder: Encoder, end: bytes = b"") -> pa.Array:
    """Ids of whole texts (no nulls), and `end` behind each, as binary values of one buffer.

    A single space between two other characters starts a new word of the byte-level split, so
    texts can be cut there and equal chunks need encoding only once.
    """
    odd = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    if odd.any():
        cut_up = [_SPACE_BETWEEN.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        order = np.empty(len(texts), np.int64)
        order[np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]] = np.arange(len(texts))
        lists = pa.concat_arrays([lists, pa.array(cut_up, lists.type)]).take(pa.array(order))
    n, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
    first = np.cumsum(n) - n
    spaced = np.ones(len(flat), bool)
    spaced[first] = False
    starts, chunks = flat.take(pa.array(first)).dictionary_encode(), flat.filter(pa.array(spaced)).dictionary_encode()
    known = [encoder.ids(starts.dictionary), _spaced_ids(chunks.dictionary, encoder), pa.array([end], pa.binary())]
    # every text: its start, its chunks, the end
    where = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), n)
    index = np.full(len(flat) + len(texts), len(known[0]) + len(known[1]), np.int64)
    index[where[~spaced]] = starts.indices.to_numpy()
    index[where[spaced]] = len(known[0]) + chunks.indices.to_numpy().astype(np.int64)
    return _grouped(pa.concat_arrays(known).take(pa.array(index)), n + 1)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Places and slices of about BLOCK_BYTES; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(size) - 1).clip(0) // BLOCK_BYTES
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]).tolist() if len(texts) else []
    for start, stop in zip(starts, [*starts[1:], len(texts)]):
        yield start, pc.fill_null(texts.slice(start, stop - start), "")


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (binary, unsigned 32-bit) of every document.

    Null texts count as empty; each document ends with id 2, so it has at least one token. Longer
    documents are cut into pieces of `capacity`, the first of which may be shorter.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([END_ID], "<u4").tobytes()
    tokenizer = ship_file(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(SparkFiles.get(tokenizer))
        for batch in batches:
            for at, block in _blocks(batch.column(1)):
                ids = token_bytes(block, encoder, end)
                _, offsets, data = ids.buffers()
                bounds = np.frombuffer(offsets, np.int32).astype(np.int64)
                n = np.diff(bounds) // 4
                count = -(-n // capacity)
                owner, number = np.repeat(np.arange(len(n)), count), _within(count)
                first = (n - (count - 1) * capacity)[owner]
                start = np.where(number > 0, first + (number - 1) * capacity, 0)
                length = np.where(number > 0, capacity, first)
                # pieces lie one after the other in the buffer of the ids
                cuts = np.append(bounds[owner] + 4 * start, bounds[-1]).astype(np.int32)
                cut_up = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(cuts), data])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at + owner)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), cut_up],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return map_arrow(
        rows,
        run,
        StructType([rows.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())]),
    )


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: largest first, each into the fullest bin that still has room."""
    bins = np.empty(len(sizes), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # rooms that have an open bin, ascending
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            stack = open_by_room[room]
            b = stack.pop()
            if not stack:
                rooms.pop(k)
        else:
            room, b = capacity, made
            made += 1
        bins[i] = b
        left = room - size
        if left:
            if not open_by_room[left]:
                bisect.insort(rooms, left)
            open_by_room[left].append(b)
    return bins


def _round(bins: DataFrame, capacity: int, level: int) -> DataFrame:
    """Pack each partition's items (fill, members) best-fit into bins: id, fill, members."""
    kind = bins.schema

    def pack_group(group: pa.Table, first: int) -> pa.RecordBatch:
        fills = group.column("fill").to_numpy().astype(np.int64)
        found = best_fit(fills, capacity)
        order = np.argsort(found, kind="stable")
        bin_of, size = found[order], fills[order]
        heads = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
        before = np.cumsum(size) - size
        base = before - np.repeat(before[heads], np.diff(np.r_[heads, len(order)]))
        members = group.column("members").combine_chunks().take(pa.array(order))
        counts = members.value_lengths().to_numpy().astype(np.int64)
        flat = members.flatten()
        moved = flat.field("at").to_numpy() + np.repeat(base, counts)
        flat = pa.StructArray.from_arrays([pa.array(moved, pa.int64()), flat.field("item")], ["at", "item"])
        bounds = np.r_[0, np.cumsum(counts)][np.r_[heads, len(order)]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(first + np.arange(len(heads)), pa.int64()),
                pa.array(np.add.reduceat(size, heads), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat),
            ],
            ["id", "fill", "members"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= GROUP_ITEMS:
                out = pack_group(pa.Table.from_batches(held), first)
                first, held = first + out.num_rows, []
                yield out
        if sum(b.num_rows for b in held):
            yield pack_group(pa.Table.from_batches(held), first)

    return map_arrow(bins, run, StructType([StructField("id", LongType()), kind["fill"], kind["members"]]))


def pack(items: DataFrame, capacity: int = CAPACITY, local_items: int = 20_000) -> DataFrame:
    """Pack rows with a `length` from 1 to capacity: their columns, sequence_id and offset.

    First partitions of about `local_items` rows are packed best-fit; nearly full bins are done.
    Underfull bins are the items of the next, smaller set of groups, and so on. Items are never
    split or dropped. Rounds end when one group is left, or when a round no longer removes a tenth
    of the bins. Every round is cut, so sequence ids don't change when executors are lost.
    """
    columns = items.columns
    single = cut(
        items.select(
            F.col("length").cast("long").alias("fill"),
            F.array(F.struct(F.lit(0).cast("long").alias("at"), F.struct(*columns).alias("item"))).alias("members"),
        )
    )
    left = single.count()
    groups = max(1, round(left / local_items))
    bins = cut(_round(single.coalesce(groups), capacity, 0))
    full = F.col("fill") >= capacity - int(SLACK * capacity)
    done, level = [bins.where(full)], 1
    rest = bins.where(~full).select("fill", "members")
    left = rest.count()
    while left > 1:
        groups = -(-left // GROUP_ITEMS)
        bins = cut(_round(rest.repartition(groups), capacity, level))
        after = bins.where(~full).count()
        if groups == 1 or after > 0.9 * left:
            done.append(bins)
            break
        done.append(bins.where(full))
        rest, left, level = bins.where(~full).select("fill", "members"), after, level + 1
    else:
        done.append(bins.where(~full))
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    return packed.select(F.col("id").alias("sequence_id"), F.explode("members").alias("m")).select(
        *[F.col(f"m.item.{c}").alias(c) for c in columns], "sequence_id", F.col("m.at").alias("offset")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise and pack documents: doc_id, piece, start, length, ids, sequence_id, offset.

    Pieces are written to the shared folder once, with a key; only keys and lengths go through the
    rounds of packing, and the ids are joined to their places afterwards. Other columns of docs are
    ignored. Repeated rows are packed each on its own, null ids are kept, an empty table gives no
    rows.
    """
    path = shared_path(docs.sparkSession, "pieces")
    keyed = pieces(docs, tokenizer_path, capacity, id_col, text_col).withColumn("key", F.monotonically_increasing_id())
    keyed.write.option("compression", "zstd").parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    places = pack(stored.select("key", "length"), capacity).select("key", "sequence_id", "offset")
    # the narrow side is hashed, so the ids are shuffled but not sorted
    return stored.join(places.hint("shuffle_hash"), "key").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
