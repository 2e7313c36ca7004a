"""Toxic passages by maximum-scoring segments of token log-odds.

Every word has log-odds of standing in a toxic document, shrunk by Dirichlet priors: that of a
word is centred on the words that share its first characters, theirs on shorter beginnings, the
shortest on the base rate. A linear-time scan (Ruzzo and Tompa 1999) finds all maximal segments of
these scores in a text. Scores of the best segments of clean texts follow an extreme-value law in
the text's length, which is fitted and tells which segments are passages and what a text's
passages weigh together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import cut, map_arrow, shared_path

#: Counts are kept by hash in so many buckets, so the model has one size for any vocabulary.
BUCKETS = 1 << 21
#: Lengths of beginnings of words that have log-odds of their own.
STEMS = (4, 5, 6, 8)
#: Weight of each Dirichlet prior, in documents.
PRIOR = 10.0
#: Taken off each word's log-odds, so that segments of clean text have falling sums.
DRIFT = 0.5
#: A segment expected at most so often by chance in a clean text of the same length is a passage.
SIGNIFICANT = 0.01
#: Bytes of text that are cut into words at once.
BLOCK_BYTES = 8 << 20
#: Scales of the extreme-value law that are tried.
SCALES = [round(0.1 * 1.06**i, 4) for i in range(56)]
#: Share of an evidence bin; evidence is counted in bins to fit two parameters.
BIN = 1 / 16
#: Words: runs of anything but ASCII marks, Latin-1 marks and general or CJK punctuation.
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-"
_SPLIT = rf"[{_GAP}\x{{BF}}\x{{2000}}-\x{{206F}}\x{{3000}}-\x{{303F}}]+"
_WORD = re.compile(rf"[^{_GAP}\xBF -⁯　-〿]+")


@dataclass
class Model:
    """What is learnt: documents by bucket and class, the base rate, the law's scale and size, weights."""

    counts: np.ndarray
    base: float
    scale: float = 1.0
    size: float = 1.0
    weights: tuple[float, float] = (0.0, 0.0)


@dataclass
class Words:
    """Words of a block of texts: number of each place's word, places by text, distinct words."""

    codes: np.ndarray
    bounds: np.ndarray
    distinct: pa.Array


def words_of(texts: pa.Array) -> Words:
    """Cut texts into lower-case words; null texts count as empty."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=_SPLIT)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    seen = flat.filter(pa.array(full)).dictionary_encode()
    return Words(seen.indices.to_numpy(), np.r_[0, np.cumsum(full)][bounds], seen.dictionary)


def buckets_of(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each beginning and of the word, a row each; and whether the word is longer than it."""
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)
    rows, has = [], []
    for i, k in enumerate((*STEMS, None)):
        part = distinct if k is None else pc.utf8_slice_codeunits(distinct, 0, k)
        seen = part.dictionary_encode()
        hashed = pd.util.hash_array(seen.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
        mixed = (hashed + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append((mixed >> np.uint64(64 - 21)).astype(np.int64)[seen.indices.to_numpy()])
        has.append(np.ones(len(length), bool) if k is None else length > k)
    return np.array(rows).reshape(len(STEMS) + 1, -1), np.array(has).reshape(len(STEMS) + 1, -1)


def log_odds(model: Model, buckets: np.ndarray, has: np.ndarray, without: int | None = None) -> np.ndarray:
    """Score of each word; without: class of a document whose own words are taken out of the counts.

    At each level the documents that the next longer one also counts are left out, so that none
    speaks twice.
    """
    levels = [np.where(has, model.counts[c][buckets], 0.0) - (has if without == c else 0) for c in (0, 1)]
    clean, toxic = (np.maximum(x, 0.0) for x in levels)
    inner = [np.zeros(buckets.shape[1]), np.zeros(buckets.shape[1])]
    own: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(len(buckets) - 1, -1, -1):
        own.append((np.where(has[k], np.maximum(toxic[k] - inner[1], 0), 0), np.where(has[k], np.maximum(clean[k] - inner[0], 0), 0)))
        inner = [np.where(has[k], clean[k], inner[0]), np.where(has[k], toxic[k], inner[1])]
    rate = np.full(buckets.shape[1], model.base)
    for t, n in reversed(own):
        rate = (t + PRIOR * rate) / (t + n + PRIOR)
    return np.log(rate / (1 - rate)) - math.log(model.base / (1 - model.base)) - DRIFT


def segments(lows: list[float], highs: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a row of positive runs: first run, last run, score.

    lows and highs: the running total before and after each run. Linear time: each candidate
    points to the nearest one before it that starts lower.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    for i, (a, b) in enumerate(zip(lows, highs)):
        start, j = i, len(low) - 1
        while True:
            while j >= 0 and low[j] >= a:
                j = link[j]
            if j < 0 or high[j] >= b:
                break
            start, a = first[j], low[j]
            del first[j:], last[j:], low[j:], high[j:]
            before = link[j]
            del link[j:]
            j = before
        first.append(start)
        last.append(i)
        low.append(a)
        high.append(b)
        link.append(j)
    return [(f, z, b - a) for f, z, a, b in zip(first, last, low, high)]


def scan(scores: np.ndarray, bounds: np.ndarray) -> Iterator[list[tuple[int, int, float]]]:
    """Segments of each text (first word, number of words, score); scores lie end to end.

    Neighbouring words above zero are one run, so that the scan takes a step for each run only.
    """
    above = scores > 0
    heads = above & np.r_[True, ~above[:-1]][: len(above)]
    heads[bounds[:-1][bounds[:-1] < len(above)]] = above[bounds[:-1][bounds[:-1] < len(above)]]
    starts = np.flatnonzero(heads)
    total = np.r_[0.0, np.cumsum(scores)]
    # a run ends before the next word at or under zero, the next text or the next run
    stops = np.flatnonzero(np.r_[~above, True])
    ends = np.minimum(stops[np.searchsorted(stops, starts)], bounds[np.searchsorted(bounds, starts, "right")]) if len(starts) else starts
    cuts = np.searchsorted(starts, bounds)
    for a, b, at in zip(cuts[:-1].tolist(), cuts[1:].tolist(), bounds.tolist()):
        if a == b:
            yield []
            continue
        s, e = starts[a:b], ends[a:b]
        yield [(int(s[f]) - at, int(e[z] - s[f]), score) for f, z, score in segments(total[s].tolist(), total[e].tolist())]


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; a text is never cut."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _count(training: DataFrame) -> DataFrame:
    """bucket, clean, toxic: distinct training texts by class that hold it; bucket -1: all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros((2, BUCKETS), np.int64), [0, 0]
        for block in _blocks(batches, 0):
            words = words_of(block.column(0))
            kind = block.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            buckets, has = buckets_of(words.distinct)
            owner = np.repeat(np.arange(block.num_rows), np.diff(words.bounds))
            width = max(1, len(words.distinct))
            pairs = np.unique(owner * width + words.codes)
            owner, code = pairs // width, pairs % width
            for k in range(len(buckets)):
                some = has[k][code]
                met = np.unique(owner[some] * BUCKETS + buckets[k][code[some]])
                for c in (0, 1):
                    found = met[kind[met // BUCKETS] == c] % BUCKETS
                    counts[c] += np.bincount(found, minlength=BUCKETS)
            for c in (0, 1):
                texts[c] += int((kind == c).sum())
        met = np.flatnonzero(counts.any(axis=0))
        rows = [np.r_[-1, met], np.r_[texts[0], counts[0][met]], np.r_[texts[1], counts[1][met]]]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["bucket", "clean", "toxic"])

    found = map_arrow(training.select("text", "toxic"), run, "bucket long, clean long, toxic long")
    return found.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _segments_without_own(training: DataFrame, model: Model) -> DataFrame:
    """toxic, n_words, scores of a training text's segments, its own words taken out of the counts."""
    shared = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 0):
            words = words_of(block.column(0))
            buckets, has = buckets_of(words.distinct)
            kind = block.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(kind, np.diff(words.bounds))
            tables = [log_odds(shared.value, buckets, has, c).astype(np.float64) for c in (0, 1)]
            scores = np.where(owner == 1, tables[1][words.codes], tables[0][words.codes])
            found = [[s for _, _, s in row] for row in scan(scores, words.bounds)]
            yield pa.RecordBatch.from_arrays(
                [block.column(1).cast(pa.int32()), pa.array(np.diff(words.bounds), pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                ["toxic", "n_words", "scores"],
            )

    return map_arrow(training.select("text", "toxic"), run, "toxic int, n_words long, scores array<double>")


def _evidence(scale: float, size: float, scores: Column, n_words: Column) -> Column:
    """What a text's segments weigh beyond chance: the sum of their normalised scores above zero."""
    chance = F.log(F.greatest(F.lit(1.0), F.lit(size) * n_words))
    return F.aggregate(scores, F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), F.lit(scale) * s - chance))


def _law(segments_: DataFrame) -> tuple[float, float]:
    """Scale and size of the extreme-value law of clean texts' best segments, by maximum likelihood.

    P(best <= x) = exp(-size * n_words * exp(-scale * x)); the size follows from the scale, and
    all scales tried are summed in one pass.
    """
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    clean = segments_.where("toxic = 0 AND n_words > 0").select("n_words", best.alias("best"))
    sums = [F.sum(F.col("n_words") * F.exp(-F.lit(s) * F.col("best"))).alias(f"s{i}") for i, s in enumerate(SCALES)]
    row = clean.agg(F.count("*").alias("n"), F.sum("best").alias("best"), *sums).first()
    if not row["n"] or not row["best"]:
        return 1.0, 1.0
    n, total = row["n"], row["best"]
    fits = [(n * math.log(n / row[f"s{i}"]) + n * math.log(s) - s * total, s, n / row[f"s{i}"]) for i, s in enumerate(SCALES)]
    return max(fits)[1:]


def _logistic(bins: list[tuple[float, int, int]], base: float) -> tuple[float, float]:
    """Intercept and slope of the chance to be toxic over evidence, from (evidence, clean, toxic) counts."""
    start = (math.log(base / (1 - base)), 0.0)
    if not sum(b[1] for b in bins) or not sum(b[2] for b in bins):
        return start
    x, n0, n1 = (np.array(c, float) for c in zip(*bins))
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.array(start)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        slope = design.T @ (n1 - (n0 + n1) * p) - 1e-3 * w
        step = np.linalg.solve((design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def training_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, toxic (0 or 1) of every distinct text among docs that a label marks, once each.

    Copies of a text are one training text, which is toxic if at least half of their labels say so;
    an id with several labels is toxic by the same rule. Rows without id, text or label are left out.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    marks = labels.where("toxic IS NOT NULL").groupBy(F.col(id_col).alias("doc_id")).agg(F.avg("toxic").alias("share"))
    texts = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    chosen = (
        texts.join(marks, "doc_id")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), (F.avg("share") >= 0.5).cast("int").alias("toxic"))
    )
    own = rows.select(F.col("doc_id").alias("id"), "text", F.unhex(F.sha2("text", 256)).alias("own"))
    found = own.join(chosen, (F.col("own") == F.col("digest")) & (F.col("id") == F.col("doc_id")))
    # rows that agree in both already lie together, so repeated ones go without another shuffle of texts
    return found.dropDuplicates(["digest", "doc_id"]).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from all of docs that `labels` (id, toxic) marks; nothing is sampled.

    To the driver come at most `BUCKETS` counts, one row of sums and the bins of evidence. The law
    and the weights are fitted to training texts scored without their own counts. Without labelled
    rows, or with one class only, every text scores the smoothed base rate.
    """
    path = shared_path(docs.sparkSession, "toxic-training")
    training_texts(docs, labels, id_col, text_col).write.option("compression", "zstd").parquet(path)
    training = docs.sparkSession.read.parquet(path)
    found = _count(training).select(F.col("bucket").cast("int").alias("bucket"), F.col("clean").cast("float"), F.col("toxic").cast("float")).toArrow()
    bucket, clean, toxic = (c.to_numpy() for c in found.columns)
    counts = np.zeros((2, BUCKETS), np.float32)
    counts[0][bucket[bucket >= 0]] = clean[bucket >= 0]
    counts[1][bucket[bucket >= 0]] = toxic[bucket >= 0]
    n0, n1 = int(clean[bucket < 0].sum()), int(toxic[bucket < 0].sum())
    base = (n1 + 1) / (n0 + n1 + 2)
    model = Model(counts, base, weights=(math.log(base / (1 - base)), 0.0))
    if not n0 or not n1:
        return model
    parts = cut(_segments_without_own(training, model))
    model.scale, model.size = _law(parts)
    x = F.log1p(_evidence(model.scale, model.size, F.col("scores"), F.col("n_words")))
    bins = parts.groupBy(F.floor(x / BIN).alias("bin")).agg(
        F.avg(x).alias("x"), F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")
    )
    model.weights = _logistic([(r["x"], r["clean"], r["toxic"]) for r in bins.collect()], base)
    return model


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, evidence, score and passages of every whole text.

    passages: start and length in code points, score and e_value (how many as good a clean text of
    that length has by chance) of all maximal segments up to `SIGNIFICANT`, in order; they never
    overlap. score: chance of a toxic label, from 0 to 1. Null and empty texts have no words and
    score the base rate of texts without evidence. Repeated rows and null ids are rows like others,
    other columns are ignored, an empty table gives no rows; long texts are read whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in _blocks(batches, 1):
            words = words_of(block.column(1))
            scores = log_odds(m, *buckets_of(words.distinct))[words.codes]
            n_words = np.diff(words.bounds)
            evidence, found = [], []
            for i, parts in enumerate(scan(scores, words.bounds)):
                chance = max(1.0, m.size * float(n_words[i]))
                evidence.append(sum(max(0.0, m.scale * s - math.log(chance)) for _, _, s in parts))
                kept = [(a, n, s, chance * math.exp(-m.scale * s)) for a, n, s in parts]
                kept = [k for k in kept if k[3] <= SIGNIFICANT]
                if kept:
                    places = [w.span() for w in _WORD.finditer(block.column(1)[i].as_py())]
                    kept = [{"start": places[a][0], "length": places[a + n - 1][1] - places[a][0], "score": s, "e_value": e} for a, n, s, e in kept]
                found.append(kept)
            a, b = m.weights
            score = 1 / (1 + np.exp(-(a + b * np.log1p(np.array(evidence, float)))))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(n_words, pa.int64()), pa.array(evidence, pa.float64()), pa.array(score, pa.float64()), pa.array(found, pa.list_(passage))],
                ["doc_id", "n_words", "evidence", "score", "passages"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:long,length:long,score:double,e_value:double>>"
    return map_arrow(rows, run, f"doc_id {kind}, n_words long, evidence double, score double, passages {spans}")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label is never learnt; false for a null id, which has no label either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and whether it reaches 0.3, by a model of the other documents' labels."""
    model = learn(docs.where(~held_out()), labels)
    found = toxic_passages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
