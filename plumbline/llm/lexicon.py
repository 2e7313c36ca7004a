"""BPE encoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are compiled into a shared-suffix automaton. Its transitions
carry numbers whose sum along a word is the word's rank in the lexicon, and the rank leads to its
ids. The automaton is one file of flat arrays that every worker maps into memory; all new words of
a block walk it side by side. Words it doesn't hold are merged exactly, pair by pair, all at once.
"""

from __future__ import annotations

import json
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.llm.shared import cut, map_arrow, ship_file

#: Words that the lexicon holds, at most: the most frequent ones.
LEXICON_WORDS = 100_000
#: Bytes of text that are split and looked up together.
BLOCK_BYTES = 16 << 20
#: Words up to this many bytes are merged side by side, so many cells of their matrix at a time.
SIDE_BYTES, SIDE_CELLS = 48, 1 << 17
#: Fixed value: the pattern that splits text into words, as the tokenizer's file has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose class all Unicode versions agree on; a chunk with others is split by the library.
_SETTLED = re.compile("[!-~¡-ɏͰ-ϿЀ-ӿ‐-‧‰-⁞぀-ヿ一-鿿가-힣]*")
#: A word of letters with or without marks behind it, which needs no other rule.
_SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)$"
#: What stands before a special token among words; no word holds it.
_MARK = b"\n"
_WORD_END = "</w>"


# the automaton


class Builder:
    """Incremental construction from sorted keys (Daciuk et al. 2000): the last word's states stay
    open, and a closed state is replaced by an equal one that is there already."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[int, int]]] = [[]]
        self.final: list[bool] = [False]
        self.known: dict[tuple, int] = {}
        self.path = [0]
        self.last = b""

    def _close(self, depth: int) -> None:
        while len(self.path) > depth:
            state = self.path.pop()
            key = (self.final[state], tuple(self.edges[state]))
            same = self.known.setdefault(key, state)
            if same != state:
                byte, _ = self.edges[self.path[-1]][-1]
                self.edges[self.path[-1]][-1] = (byte, same)

    def add(self, word: bytes) -> None:
        if self.last and word <= self.last:
            raise ValueError("words have to come sorted and once")
        common = 0
        while common < min(len(word), len(self.last)) and word[common] == self.last[common]:
            common += 1
        self._close(common + 1)
        for byte in word[common:]:
            self.edges.append([])
            self.final.append(False)
            self.edges[self.path[-1]].append((byte, len(self.edges) - 1))
            self.path.append(len(self.edges) - 1)
        self.final[self.path[-1]] = True
        self.last = word

    def arrays(self) -> dict[str, np.ndarray]:
        """Reachable states renumbered; transitions sorted by state and byte, with their rank numbers."""
        self._close(1)
        order, stack = [], [(0, False)]
        seen: set[int] = set()
        while stack:  # children before parents
            state, done = stack.pop()
            if done:
                order.append(state)
            elif state not in seen:
                seen.add(state)
                stack.append((state, True))
                stack += [(to, False) for _, to in self.edges[state] if to not in seen]
        size: dict[int, int] = {}
        number = {s: n for n, s in enumerate(reversed(order))}
        rows = []
        for state in order:
            rank = int(self.final[state])
            for byte, to in self.edges[state]:
                rows.append((number[state] * 256 + byte, number[to], rank))
                rank += size[to]
            size[state] = rank
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        final = np.zeros(len(order), np.uint8)
        final[[number[s] for s in order if self.final[s]]] = 1
        return {"key": table[:, 0].copy(), "to": table[:, 1].astype(np.int32), "rank": table[:, 2].astype(np.int32), "final": final}


def save(arrays: dict[str, np.ndarray], file: Path) -> None:
    """Flat arrays behind one line of JSON that says where they are."""
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    start = -(-(len(head) + 9) // 64) * 64
    with file.open("wb") as out:
        out.write(f"{start:08d}".encode() + head + b"\n")
        for name, a in arrays.items():
            out.seek(start + places[name][0])
            out.write(a.tobytes())


class Lexicon:
    """A memory-mapped automaton with ids."""

    def __init__(self, file: str) -> None:
        with open(file, "rb") as f:
            start = int(f.read(8))
            places = json.loads(f.readline())
        self.arrays = {n: np.asarray(np.memmap(file, kind, "r", start + at, (size,))) if size else np.zeros(0, kind) for n, (at, kind, size) in places.items()}

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word in the lexicon, -1 for words that it doesn't hold. All words walk together."""
        a = self.arrays
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(lengths > 0)
        depth = 0
        if not len(a["key"]):
            return np.full(len(words), -1)
        fell = lengths == 0
        while len(alive):
            key = state[alive] * 256 + data[begin[alive] + depth]
            edge = np.minimum(np.searchsorted(a["key"], key), len(a["key"]) - 1)
            ok = a["key"][edge] == key
            fell[alive[~ok]] = True
            alive, edge = alive[ok], edge[ok]
            state[alive] = a["to"][edge]
            rank[alive] += a["rank"][edge]
            depth += 1
            alive = alive[lengths[alive] > depth]
        return np.where(~fell & (a["final"][state] == 1), rank, -1)

    def ids(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these ranks, one after the other, and how many each word has."""
        at = self.arrays["at"].astype(np.int64)
        counts = at[ranks + 1] - at[ranks]
        return self.arrays["ids"][np.repeat(at[ranks], counts) + _within(counts)].astype(np.int64), counts


# words and merges


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class SideMerger:
    """Merges many short words at once. inner, last: symbols of a byte within and at the end of a word."""

    def __init__(self, vocabulary: dict[str, int], merges: Sequence[Sequence[str]], inner: Sequence[str], last: Sequence[str]) -> None:
        self.inner = np.array([vocabulary[c] for c in inner], np.int64)
        self.last = np.array([vocabulary[c] for c in last], np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.results = np.array([vocabulary[a + b] for a, b in merges], np.int64)[order]

    def __call__(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of 1 to `width` bytes: each step merges one pair of every
        word that still has one, and words that are done leave the matrix."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        return self.cells(np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width), size)

    def cells(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for a row of bytes for each word, of which the first `size` count."""
        words, width = data.shape
        keys, ranks, results = self.keys, self.ranks, self.results
        never = np.iinfo(np.int64).max
        row = np.arange(words)
        part = self.inner[data]
        part[row, size - 1] = self.last[data[row, size - 1]]

        def places(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = left << 32 | right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return at, np.where(keys[at] == key, ranks[at], never)

        rank = np.full((words, width), never)
        real = np.arange(width - 1) < size[:, None] - 1
        rank[:, :-1][real] = places(part[:, :-1][real], part[:, 1:][real])[1]
        done, column, left = np.zeros((words, width), np.int64), np.arange(width), size.copy()
        owner = row
        while len(owner):
            row = np.arange(len(owner))
            best = rank.argmin(axis=1)
            over = rank[row, best] == never
            if over.any():
                done[owner[over]] = part[over]
                keep = ~over
                owner, part, rank, best = owner[keep], part[keep], rank[keep], best[keep]
                row = np.arange(len(owner))
                if not len(owner):
                    break
            at, _ = places(part[row, best], part[row, best + 1])
            behind = column >= best[:, None] + 1
            part = np.where(behind, np.roll(part, -1, axis=1), part)
            rank = np.where(behind, np.roll(rank, -1, axis=1), rank)
            part[row, best], rank[:, -1] = results[at], never
            left[owner] -= 1
            n = left[owner]
            rank[row, best] = never
            for other, ok in ((best, best < n - 1), (best - 1, best > 0)):
                r, c = row[ok], other[ok]
                rank[r, c] = places(part[r, c], part[r, c + 1])[1]
        return done[column < left[:, None]], left


class Bpe:
    """Word-level encoder: splits a chunk without white space into words and merges words exactly."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        self.path = path
        self.vocabulary: dict[str, int] = model["model"]["vocab"]
        self.merge_rank = {tuple(m): i for i, m in enumerate(model["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.token = {i: t for t, i in (self.vocabulary | self.special).items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(WORDS)
        self.letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.library = None

        self.side = SideMerger(self.vocabulary, model["model"]["merges"], self.letters, [c + _WORD_END for c in self.letters])

    def _plain_words(self, text: str) -> list[bytes]:
        if _SETTLED.fullmatch(text):
            text = text if text.isascii() else unicodedata.normalize("NFC", text)
            lowered = text.replace("Σ", "σ").lower()  # one letter at a time, as the library does
            return [w.encode() for w in self.pattern.findall(lowered)]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in p) for p, _ in pieces]

    def words(self, chunk: str) -> list[bytes]:
        """Words of a chunk (UTF-8), in order; special tokens come as _MARK and their name."""
        if self.special_pattern is None or "<" not in chunk:
            return self._plain_words(chunk)
        found: list[bytes] = []
        for i, part in enumerate(self.special_pattern.split(chunk)):
            found += [_MARK + part.encode()] if i % 2 else self._plain_words(part) if part else []
        return found

    def split(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all chunks, one after the other, and how many of them each chunk has."""
        found = pc.extract_regex(chunks, _SIMPLE)
        ok = found.is_valid().to_numpy(zero_copy_only=False)
        simple = found.drop_null()
        letters, marks = pc.utf8_lower(simple.field("word")), simple.field("marks")
        marked = pc.greater(pc.binary_length(marks), 0).to_numpy(zero_copy_only=False)
        others = [self.words(c) for c in chunks.filter(pa.array(~ok)).to_pylist()]
        counts = np.zeros(len(chunks), np.int64)
        counts[ok], counts[~ok] = 1 + marked, [len(w) for w in others]
        begin = np.cumsum(counts) - counts
        order = np.empty(int(counts.sum()), np.int64)
        order[begin[ok]] = np.arange(len(letters))
        order[begin[ok][marked] + 1] = len(letters) + np.flatnonzero(marked)
        rest = counts[~ok]
        order[np.repeat(begin[~ok], rest) + _within(rest)] = 2 * len(letters) + np.arange(int(rest.sum()))
        flat = pa.array([w for words in others for w in words], pa.binary())
        return pa.concat_arrays([letters.cast(pa.binary()), marks.cast(pa.binary()), flat]).take(pa.array(order)), counts

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair that was learnt first is merged until none is left."""
        parts = [self.letters[b] for b in word]
        parts[-1] += _WORD_END
        rank_of, never = self.merge_rank.get, 1 << 60
        ranks = [rank_of(p, never) for p in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), never)
        return [self.vocabulary[p] for p in parts]


    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many of them each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        counts = np.zeros(len(words), np.int64)
        ids, at = [], 0
        while at < len(order):
            width = max(8, -(-int(size[order[at]]) // 8) * 8)
            if width > SIDE_BYTES or words[order[at]].startswith(_MARK):
                stop = at + 1
                word = words[order[at]]
                found = np.array([self.special[word[1:].decode()]] if word.startswith(_MARK) else self.merge(word), np.int64)
                n = np.array([len(found)])
            else:
                stop = min(int(np.searchsorted(size[order], width, "right")), at + SIDE_CELLS // width)
                group = [words[i] for i in order[at:stop]]
                if marked := [k for k, w in enumerate(group) if w.startswith(_MARK)]:
                    stop = at + marked[0]
                    group = group[: marked[0]]
                found, n = self.side(group, width)
            ids.append(found)
            counts[order[at:stop]] = n
            at = stop
        values = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        sorted_counts = counts[order]
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(sorted_counts) - sorted_counts
        return values[np.repeat(start, counts) + _within(counts)], counts


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of these sizes, one group after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


@lru_cache(maxsize=2)
def bpe_of(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def lexicon_of(file: str) -> Lexicon:
    return Lexicon(file)


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about BLOCK_BYTES; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(size) - 1).clip(0) // BLOCK_BYTES
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(texts) else []
    for start, stop in zip(starts, [*starts[1:], len(texts)]):
        yield pc.fill_null(texts.slice(start, stop - start), "")


def _chunks(block: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """What stands between white space in all texts of a block, and each one's text."""
    lists = pc.ascii_split_whitespace(block)
    owner = np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy())
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # the ends of a text may give empty ones
    return flat.filter(real).dictionary_encode(), owner[real.to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """word (binary) and its number of occurrences over all whole texts."""
    tokenizer = ship_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(SparkFiles.get(tokenizer))
        for batch in batches:
            for block in _blocks(batch.column(0)):
                chunks, _ = _chunks(block)
                if not len(chunks):
                    continue
                times = np.bincount(chunks.indices.to_numpy(), minlength=len(chunks.dictionary))
                flat, counts = bpe.split(chunks.dictionary)
                words = flat.dictionary_encode()
                n = np.zeros(len(words.dictionary), np.int64)
                np.add.at(n, words.indices.to_numpy(), np.repeat(times, counts))
                plain = pc.invert(pc.starts_with(words.dictionary, _MARK))
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], ["word", "n"]).filter(plain)

    rows = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    return map_arrow(rows, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(words: list[bytes], path: str) -> dict[str, np.ndarray]:
    """Automaton and ids of distinct words, as arrays. The i-th word in byte order has rank i."""
    builder, bpe = Builder(), bpe_of(path)
    ordered = sorted(words)
    for w in ordered:
        builder.add(w)
    ids, counts = bpe.merge_all(ordered)
    return builder.arrays() | {"at": np.r_[0, np.cumsum(counts)].astype(np.int32), "ids": ids.astype(np.int32)}


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile the most frequent words of all texts and hand the file to every executor; its name there.

    Only up to `size` words, a parameter, come to the driver. How often a word has to occur is read
    off the number of words of each count, of which the `size` largest counts suffice; words that
    occur just that often fill what is left. What the lexicon holds changes no result.
    """
    counts = cut(count_words(docs, path, text_col))
    if counts.count() > size:
        # a bound on the count, so that nothing is sorted or sent that doesn't stay
        sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size + 1).collect()
        room = size
        for bound, words in sizes:
            if words > room:
                break
            room -= words
        counts = counts.where(F.col("n") > bound).unionByName(counts.where(F.col("n") == bound).limit(room))
    top = counts.collect()
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = Path(tempfile.mkdtemp(prefix="plumbline-")) / name
    save(compile_lexicon([bytes(r["word"]) for r in top], path), file)
    docs.sparkSession.sparkContext.addFile(str(file))
    return name


class Encoder:
    """Encodes blocks of texts with a lexicon, each distinct chunk and word of a block once."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon) -> None:
        self.bpe, self.lexicon = bpe, lexicon
        names = [bpe.token.get(i, "") for i in range(max(bpe.token) + 1)]
        self.decoded, self.decimal = pa.array(names, pa.string()), pa.array([str(i) for i in range(len(names))], pa.string())

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each word has."""
        listed = words.to_pylist()
        ranks = self.lexicon.ranks(listed)
        known = ranks >= 0
        unseen = [listed[i] for i in np.flatnonzero(~known)]
        counts = np.zeros(len(listed), np.int64)
        from_lexicon, counts[known] = self.lexicon.ids(ranks[known])
        merged, counts[~known] = self.bpe.merge_all(unseen)
        ids = np.empty(int(counts.sum()), np.int64)
        own = np.repeat(known, counts)
        ids[own], ids[~own] = from_lexicon, merged
        return ids, counts

    def encode(self, block: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Number of tokens, ids as text, and decoded text of each text of a block."""
        chunks, owner = _chunks(block)
        flat, n_words = self.bpe.split(chunks.dictionary)
        words = flat.dictionary_encode()
        ids, n_ids = self._word_ids(words.dictionary)
        # from words to the chunks that hold them
        of, begin = words.indices.to_numpy(), np.cumsum(n_ids) - n_ids
        times = n_ids[of]
        ids = ids[np.repeat(begin[of], times) + _within(times)]
        ends = np.r_[0, np.cumsum(times)][np.r_[0, np.cumsum(n_words)]]
        n_tokens = np.diff(ends)
        # from chunks to texts; a chunk may hold nothing but rare white space
        index = chunks.indices.to_numpy()
        real = n_tokens[index] > 0
        index, owner = index[real], owner[real]
        bounds = pa.array(np.searchsorted(owner, np.arange(len(block) + 1)), pa.int32())

        def joined(names: pa.Array) -> pa.Array:
            of_chunk = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(ids))), " ")
            return pc.binary_join(pa.ListArray.from_arrays(bounds, of_chunk.take(pa.array(index))), " ")

        total = np.bincount(owner, n_tokens[index], len(block)).astype(np.int64)
        return pa.array(total), joined(self.decimal), joined(self.decoded)


def encode_documents(docs: DataFrame, path: str, lexicon: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded (text of the ids) of every row.

    The result is the tokenizer's own whatever the lexicon holds. Null texts count as empty and have
    no tokens; texts are encoded whole. Null ids and repeated rows are rows like others; an empty
    table gives no rows. Other columns are ignored.
    """
    lexicon = lexicon or build_lexicon(docs, path, text_col=text_col)
    tokenizer = ship_file(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(bpe_of(SparkFiles.get(tokenizer)), lexicon_of(SparkFiles.get(lexicon)))
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), *encoder.encode(block)], ["doc_id", "n_tokens", "ids", "decoded"])
                at += len(block)

    kinds = [rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids", StringType()), StructField("decoded", StringType())]
    return map_arrow(rows, run, StructType(kinds))
