"""Alignment of two tokenizers by lockstep vectorised merging.

Each document has tokens of tokenizers A and B over the same bytes. One numpy state vector holds an
A pointer and a B pointer for each lane; a step emits a link for every lane, notes a cut where both
tokens end, moves the pointers whose token ends first, and finished lanes are compacted away.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.shared import map_arrow, shared_path

#: A tokens of a lane; a longer document has several, so that one text doesn't hold up a batch.
LANE_TOKENS = 512
#: Bytes of text that are merged at once.
BLOCK_BYTES = 1 << 20
#: Links of documents that share one list of id pairs.
CHUNK_LINKS = 2_000_000
#: Segments whose ids a worker remembers before it starts anew; results don't depend on it.
MEMORY = 300_000
#: Segments that are encoded in one go.
GROUP = 256
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts with these are cut by `_CUT`; in others every space stands between two other characters.
_IRREGULAR = r"  |^ | $| [\t-\r]|[\t-\r] |[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of recent segments.

    A segment is what stands between two single spaces. A is asked for a space and the segment, B,
    which adds the space itself, for the segment. Neither's tokens reach over such a space: A splits
    there, and B is asked segment by segment only if none of its pieces holds a space behind
    another character.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = _byte_of_char()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.a_length = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        self.width = len(self.b_bytes)
        self.forget()
        n, m = len(self.a_bytes), self.width
        texts = [f"{i}{s}" for s, size in ((",", n), ("|", n), (",", m), (";", m), ("", m)) for i in range(size)]
        #: Decimal ids with what may follow them, by kind and id.
        self.words = np.array(texts, object)
        self.word_at = np.cumsum([0, n, n, m, m])

    def forget(self) -> None:
        """Start anew: `at` numbers the segments; of each its start and number of ids, of A and of B."""
        self.at: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.start = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.fits = np.zeros(0, bool)

    def _encode(self, groups: list[list[str]]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]] | None]:
        """For each group of segments the ids of A and B and where each segment's end.

        A group is encoded in one go, its segments joined by single spaces. None if the joined bytes
        of its tokens differ from the text or a token reaches over a segment's end.
        """
        texts = [" ".join(g) for g in groups]
        found = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        for group, text, a, b in zip(groups, texts, found, self.b.encode(texts, num_threads=1)):
            want, a = f" {text}".encode(), a.ids
            if not b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b)):
                yield None
                continue
            ids = [np.array(a, np.int32), np.array(b, np.int32)]
            over = np.cumsum([len(s.encode()) + 1 for s in group])
            reached = [np.cumsum(length[i]) for length, i in zip((self.a_length, self.b_length), ids)]
            ends = [np.searchsorted(r, over) + 1 for r in reached]
            yield (ids, ends) if all(np.array_equal(r[e - 1], over) for r, e in zip(reached, ends)) else None

    def learn(self, segments: list[str]) -> None:
        """Keep the ids of new segments. Those that begin and end without space share a call."""
        new = [s for s in segments if s not in self.at]
        if len(self.at) + len(new) > MEMORY:
            self.forget()
            new = segments
        plain = [s for s in new if s and s == s.strip()] if self.cuttable else []
        alone = [[s] for s in new if not s or s != s.strip()] if self.cuttable else [[s] for s in new]
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        done: list[tuple[list[str], tuple | None]] = []
        for group, found in zip(groups, self._encode(groups)):
            if found:
                done.append((group, found))
            else:
                alone += [[s] for s in group]
        done += zip(alone, self._encode(alone))
        for group, found in done:
            self.at.update(zip(group, range(len(self.at), len(self.at) + len(group))))
        none = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2
        for side in (0, 1):
            parts = [(f or none) for _, f in done]
            size = [np.diff(ends[side], prepend=0) for _, ends in parts]
            size = np.concatenate([self.size[side], *size])
            self.ids[side] = np.concatenate([self.ids[side], *[ids[side] for ids, _ in parts]])
            self.size[side], self.start[side] = size, np.cumsum(size) - size
        self.fits = np.concatenate([self.fits, *[np.full(len(g), f is not None) for g, f in done]])

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids, bounds of texts in them, and the same of B; texts that don't fit have none."""
        texts = pc.fill_null(texts, "")
        if self.cuttable:
            odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(texts, " ")
        else:
            odd, lists = np.ones(len(texts), bool), None
        if odd.any():
            own = [(_CUT.split(t) if self.cuttable else [t]) for t in texts.filter(pa.array(odd)).to_pylist()]
            own = pa.array(own, pa.list_(texts.type))
            order = np.empty(len(texts), np.int64)
            order[~odd] = np.arange((~odd).sum())
            order[odd] = (~odd).sum() + np.arange(odd.sum())
            lists = pa.concat_arrays([lists.filter(pa.array(~odd)), own]).take(pa.array(order)) if lists is not None else own
        flat = lists.flatten().dictionary_encode()
        segments = flat.dictionary.to_pylist()
        self.learn(segments)
        number = np.fromiter(map(self.at.__getitem__, segments), np.int64, len(segments))
        fits = self.fits[number]
        codes = flat.indices.to_numpy()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        wrong = np.r_[0, np.cumsum(~fits[codes])] if len(codes) else np.zeros(1, np.int64)
        keep = (wrong[bounds[1:]] == wrong[bounds[:-1]]) & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
        per_text = np.diff(bounds)
        used = number[codes[np.repeat(keep, per_text)]]
        out = []
        for side in (0, 1):
            count, start, values = self.size[side][used], self.start[side][used], self.ids[side]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            out.append(values[np.repeat(start - (ends - count), count) + np.arange(total)])
            segment_ends = np.r_[0, ends]
            out.append(segment_ends[np.r_[0, np.cumsum(np.where(keep, per_text, 0))]])
        return out[0], out[1], out[2], out[3]


@lru_cache(maxsize=2)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def merge(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all documents in order: A token, B token, and whether both end there.

    Tokens of all documents lie end to end and cover the same bytes, a_ends and b_ends are their
    ends, a_bounds the documents' first A tokens. Every link has its own sum of token numbers, which
    is its place in the output.
    """
    n, m = len(a_ends), len(b_ends)
    found, cut = np.full(n + m, -1, np.int64), np.zeros(n + m, bool)
    if n:
        size = np.diff(a_bounds)
        lanes = -(-size // LANE_TOKENS)
        first = np.repeat(np.cumsum(lanes) - lanes, lanes)
        i = np.repeat(a_bounds[:-1], lanes) + (np.arange(int(lanes.sum())) - first) * LANE_TOKENS
        begin = np.where(i > 0, a_ends[i - 1], 0)
        stop = np.r_[begin[1:], a_ends[-1]]
        j = np.searchsorted(b_ends, begin, "right")
        while len(i):
            at_a, at_b = a_ends[i], b_ends[j]
            low = np.minimum(at_a, at_b)
            place = i + j
            found[place] = i
            cut[place] = at_a == at_b
            i = i + (at_a == low)
            j = j + (at_b == low)
            more = low < stop
            if not more.all():
                i, j, stop = i[more], j[more], stop[more]
    place = np.flatnonzero(found >= 0)
    return found[place], place - found[place], cut[place]


def group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, groups: tuple[np.ndarray, np.ndarray], bounds: np.ndarray) -> list[str]:
    """Each document's groups as text: `a1,a2|b1;a3|b2,b3`. groups: number of each token's group."""
    ga, gb = groups
    if not len(a):
        return [""] * (len(bounds) - 1)
    at_a = np.arange(len(a)) + np.searchsorted(gb, ga, "left")
    at_b = np.arange(len(b)) + np.searchsorted(ga, gb, "right")
    last_a, last_b = np.r_[ga[1:] != ga[:-1], True], np.r_[gb[1:] != gb[:-1], True]
    kind_b = 2 + last_b.astype(np.int64)
    total = len(a) + len(b)
    which = np.empty(total, np.int64)
    which[at_a] = pair.word_at[last_a.astype(np.int64)] + a
    which[at_b] = pair.word_at[kind_b] + b
    closing = bounds[1:][np.diff(bounds) > 0] - 1  # a document's last token is its last group's last B
    which[closing] += pair.width
    words = pair.words[which].tolist()
    return ["".join(words[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _ranges(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _ship(docs: DataFrame, path: str) -> str:
    """Hand a tokenizer's file to the executors; its name there."""
    context = docs.sparkSession.sparkContext
    name = os.path.basename(path)
    if not any(os.path.basename(f) == name for f in context.listFiles):
        context.addFile(path)
    return name


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, first_b, last_b (first and last B token linked to each A token), cuts.

    cuts: byte offsets in space+text where a token of A and one of B both end. Null and empty texts,
    and texts whose tokens don't join to space+text, have empty lists. Texts are whole, repeated
    rows and null ids are rows like others, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    a_file, b_file = _ship(docs, a_path), _ship(docs, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(SparkFiles.get(a_file), SparkFiles.get(b_file))
        for block in _blocks(batches):
            a, a_bounds, b, b_bounds = pair.tokens(block.column(1))
            a_ends, b_ends = np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b])
            i, j, cut = merge(a_ends, b_ends, a_bounds)
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
            stops = np.r_[starts[1:], len(i)][: len(starts)] - 1
            offset = np.repeat(b_bounds[:-1], np.diff(a_bounds))
            ends = np.r_[0, a_ends][a_bounds]
            at = a_ends[i[cut]]
            held = np.searchsorted(at, ends, "right")
            own = np.repeat(ends[:-1], np.diff(held))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    _ranges(a.astype(np.int32), a_bounds),
                    _ranges(b.astype(np.int32), b_bounds),
                    _ranges((j[starts] - offset).astype(np.int32), a_bounds),
                    _ranges((j[stops] - offset).astype(np.int32), a_bounds),
                    _ranges((at - own).astype(np.int64), held),
                ],
                ["doc_id", "a_ids", "b_ids", "first_b", "last_b", "cuts"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    lists = "a_ids array<int>, b_ids array<int>, first_b array<int>, last_b array<int>, cuts array<long>"
    return map_arrow(rows, run, f"doc_id {kind}, {lists}")


def _measure(rows: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """A row per document with its links as places in its chunk's list of id pairs, and that list.

    A chunk is some documents of one task. Its list is a row of its own with a null `links`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = pair_of(SparkFiles.get(a_file), SparkFiles.get(b_file))
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            links = np.concatenate([h[1] for h in held])
            seen = pa.array(links).dictionary_encode()
            places = seen.indices.to_numpy()
            at = 0
            for columns, own, bounds in held:
                n = len(columns[0])
                nulls = [pa.nulls(n, pa.list_(pa.int64()))] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, chunk)), *columns, _ranges(places[at : at + len(own)].astype(np.int32), bounds), *nulls], names
                )
                at += len(own)
            pairs = seen.dictionary.to_numpy()
            times = np.bincount(places, minlength=len(pairs)).astype(np.int64)
            empty = [pa.nulls(1, c.type) for c in held[0][0]]
            lists = [_ranges(v, np.array([0, len(v)])) for v in (pairs, times)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *empty, pa.nulls(1, pa.list_(pa.int32())), *lists], names)

        for block in _blocks(batches):
            a, a_bounds, b, b_bounds = pair.tokens(block.column(1))
            i, j, cut = merge(np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b]), a_bounds)
            group = np.cumsum(cut) - cut
            groups = (group[np.r_[True, i[1:] != i[:-1]][: len(i)]], group[np.r_[True, j[1:] != j[:-1]][: len(j)]])
            bounds = np.searchsorted(i, a_bounds)
            texts = group_texts(pair, a, b, groups, a_bounds + b_bounds)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            counts = [np.diff(a_bounds), np.diff(b_bounds), np.diff(np.r_[0, np.cumsum(cut)][bounds]), np.diff(bounds)]
            columns = [block.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string())]
            held.append((columns, a[i].astype(np.int64) * pair.width + b[j], bounds))
            size += len(i)
            if size >= CHUNK_LINKS:
                yield from flush()
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield from flush()

    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "times"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return map_arrow(rows, run, f"chunk long, doc_id {kind}, {numbers}, links array<int>, pairs array<long>, times array<long>")


def pair_counts(lists: DataFrame, width: int) -> DataFrame:
    """chunk, place, pair, count (links of the pair in all documents), best (highest of its B id).

    lists: chunk, pairs, times. B ids are as many as the vocabulary has, so their highest counts are
    broadcast.
    """
    rows = lists.select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "entry"))
    rows = rows.select("chunk", "place", F.col("entry.pairs").alias("pair"), F.col("entry.times").alias("times"))
    counted = rows.withColumn("count", F.sum("times").over(Window.partitionBy("pair"))).drop("times")
    path = shared_path(lists.sparkSession, "pair-counts")
    counted.write.option("compression", "zstd").parquet(path)
    stored = lists.sparkSession.read.parquet(path).withColumn("b", F.pmod("pair", F.lit(width)))
    highest = stored.groupBy("b").agg(F.max("count").alias("highest"))
    return stored.join(F.broadcast(highest), "b").select("chunk", "place", "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _weigh(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of a chunk with what their links' pairs count."""
    place = counts.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place] = counts.column("count").to_numpy()
    best[place] = counts.column("best").to_numpy().astype(np.int64)
    links = documents.column("links").combine_chunks()
    flat = links.flatten().to_numpy()
    bounds = np.r_[0, np.cumsum(links.value_lengths().to_numpy())]
    sums = [np.diff(np.r_[0, np.cumsum(v[flat])][bounds]) for v in (best, count)]
    kept = documents.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    See `align_documents` for texts and rows. Documents are tokenised and merged once and stored in
    chunks; id pairs are counted over all chunks, and each chunk gets back only the counts of its
    own pairs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    path = shared_path(docs.sparkSession, "links")
    measured = _measure(rows, _ship(docs, a_path), _ship(docs, b_path))
    measured.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    stored = docs.sparkSession.read.parquet(path)
    documents = stored.where("links IS NOT NULL").drop("pairs", "times")
    counts = pair_counts(stored.where("pairs IS NOT NULL").select("chunk", "pairs", "times"), width)
    some = documents.where("n_links > 0").groupBy("chunk").cogroup(counts.select("chunk", "place", "count", "best").groupBy("chunk"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    weighed = some.applyInArrow(_weigh, f"doc_id {kind}, {numbers}").select(*order)
    zero = F.lit(0).cast("long")
    others = documents.where("n_links = 0").withColumn("n_best", zero).withColumn("count_sum", zero)
    return weighed.unionByName(others.select(*order))
