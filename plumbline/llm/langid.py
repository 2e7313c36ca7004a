"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position with a probability for
each language, and a document's probabilities are the means over its positions. It is trained in
numpy by backpropagation through time on a bounded sample of labelled rows. With snippets made
strange as one more class it also tells positions that are in none of the languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from plumbline.llm.shared import map_arrow

UNKNOWN = "und"
HIDDEN = 8
#: Bound of the training sample: rows of each language, and snippets of so many characters of each row.
SAMPLE_ROWS, SNIPPETS, SNIPPET_CHARS = 300, 4, 60
EPOCHS, BATCH, RATE = 14, 128, 0.02
#: Bytes read in one go; the state starts anew after so many. Sequences that run side by side.
SPAN, SIDE = 128, 2048
#: First of the 24 letters that are taken of each script into which strange snippets are put.
_SCRIPTS = (0x3B1, 0x430, 0x5D0, 0x628, 0x905, 0xE01, 0x10D0, 0x3042, 0x4E00, 0xAC00)
_LETTER = re.compile(r"[^\W\d_]")


class Network(NamedTuple):
    """Weights. Gates are stacked: update, reset, candidate. Index 0 is forward, 1 backward."""

    languages: tuple[str, ...]
    table: np.ndarray  # (2, 3h, 256): what a byte adds to the gates
    recur: np.ndarray  # (2, 3h, h)
    out: np.ndarray  # (2, languages, h)
    bias: np.ndarray  # (languages,)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(table: np.ndarray, recur: np.ndarray, steps: np.ndarray, mask: np.ndarray | None = None, keep: bool = False) -> tuple[np.ndarray, list]:
    """States after each row of bytes in `steps` (time, side): (time, h, side); gate values if kept.

    Where mask is 0 there is padding: the state stays zero.
    """
    h = recur.shape[1]
    half = table.copy()
    half[: 2 * h] *= 0.5
    u_gates, u_cand = 0.5 * recur[: 2 * h], np.ascontiguousarray(recur[2 * h :])
    state = np.zeros((h, steps.shape[1]), np.float32)
    states = np.empty((len(steps), h, steps.shape[1]), np.float32)
    kept = []
    for t, row in enumerate(steps):
        add = half.take(row, axis=1)
        gates = u_gates @ state
        gates += add[: 2 * h]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        inner = u_cand @ state
        cand = gates[h:] * inner
        cand += add[2 * h :]
        np.tanh(cand, out=cand)
        if keep:
            kept.append((state, gates, inner, cand))
        state = states[t]
        np.subtract(kept[-1][0] if keep else (states[t - 1] if t else 0), cand, out=state)
        state *= gates[:h]
        state += cand
        if mask is not None and not mask[t].all():
            state *= mask[t]
    return states, kept


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=-2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=-2, keepdims=True)
    return logits


def position_probabilities(net: Network, steps: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Probability of each language at each position: (time, languages, side). mask: 0 for padding."""
    ahead, _ = _run(net.table[0], net.recur[0], steps)
    back, _ = _run(net.table[1], net.recur[1], steps[::-1], None if mask is None else mask[::-1])
    return _softmax(net.out[0] @ ahead + net.out[1] @ back[::-1] + net.bias[:, None])


def _gradients(net: Network, steps: np.ndarray, target: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over positions, by backpropagation through time."""
    h = net.recur.shape[2]
    runs = [_run(net.table[d], net.recur[d], steps[:: 1 - 2 * d], mask[:: 1 - 2 * d], True) for d in (0, 1)]
    ahead, back = runs[0][0], runs[1][0][::-1]
    p = _softmax(net.out[0] @ ahead + net.out[1] @ back + net.bias[:, None])
    p[:, target, np.arange(len(target))] -= 1
    p *= mask[:, None, :] / mask.sum()
    g_out = np.stack([np.einsum("tcb,thb->ch", p, s) for s in (ahead, back)])
    g_table, g_recur = np.zeros_like(net.table), np.zeros_like(net.recur)
    for d in (0, 1):
        order = slice(None, None, 1 - 2 * d)
        local, real = (net.out[d].T @ p)[order], mask[order]
        rows, kept = steps[order], runs[d][1]
        u = net.recur[d]
        flow = np.zeros_like(kept[0][0])
        for t in range(len(rows) - 1, -1, -1):
            before, gates, inner, cand = kept[t]
            z, r = gates[:h], gates[h:]
            flow = (flow + local[t]) * real[t]
            d_cand = flow * (1 - z) * (1 - cand * cand)
            pre = np.concatenate([flow * (before - cand) * z * (1 - z), d_cand * inner * r * (1 - r), d_cand])
            through = np.concatenate([pre[: 2 * h], d_cand * r])
            g_recur[d] += through @ before.T
            np.add.at(g_table[d].T, rows[t], pre.T)
            flow = flow * z + u.T @ through
    return [g_table, g_recur, g_out, p.sum(axis=(0, 2))]


def train(texts: list[bytes], labels: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit a network to labelled snippets with Adam; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    h, c = HIDDEN, len(languages)
    weights = [
        rng.normal(0, 0.3, (2, 3 * h, 256)).astype(np.float32),
        rng.normal(0, 0.3, (2, 3 * h, h)).astype(np.float32),
        rng.normal(0, 0.3, (2, c, h)).astype(np.float32),
        np.zeros(c, np.float32),
    ]
    if not texts:
        return Network(languages, *weights)
    width = min(SPAN, max(map(len, texts)))
    data = np.zeros((width, len(texts)), np.uint8)
    mask = np.zeros((width, len(texts)), np.float32)
    for i, t in enumerate(texts):
        data[: len(t), i] = np.frombuffer(t[:width], np.uint8)
        mask[: len(t), i] = 1
    target = np.array([languages.index(x) for x in labels])
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for w, g, m, v in zip(weights, _gradients(Network(languages, *weights), data[:, pick], target[pick], mask[:, pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(languages, *weights)


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; they are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def estranged(snippet: str, kind: int, rng: np.random.Generator) -> str:
    """A snippet with its spaces, digits and signs, which so speak for nothing, but letters of no language.

    By kind: exchanged by a map of the Latin alphabet drawn anew, put in another order, drawn anew
    one by one, letters of another script.
    """
    at = [i for i, c in enumerate(snippet) if _LETTER.match(c)]
    chars, old = list(snippet), [snippet[i] for i in at]
    if kind == 0:
        lower = "".join(map(chr, range(97, 123)))
        swap = dict(zip(lower, rng.permutation(list(lower)).tolist()))
        new = [swap[c] if c in swap else swap[c.lower()].upper() if c.lower() in swap else swap[lower[ord(c) % 26]] for c in old]
    elif kind == 1:
        new = [old[i] for i in rng.permutation(len(old))]
    elif kind == 2:
        new = [chr(97 + int(c)) for c in rng.integers(0, 26, len(old))]
    else:
        script = int(rng.choice(_SCRIPTS))
        new = [chr(script + int(c)) for c in rng.integers(0, 24, len(old))]
    for i, c in zip(at, new):
        chars[i] = c
    return "".join(chars)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", others: bool = False) -> Network:
    """Train on snippets of up to SAMPLE_ROWS rows of each language, spread by a hash over the table.

    Snippets are cut before rows are shuffled, and each task sends at most SAMPLE_ROWS rows of a
    language on. Rows that are held out or have a null text or label are left out. With `others`
    the network gets `und` as one more class, taught by as many estranged snippets as a language
    has on average.
    """
    text = F.col("text")
    size = F.length(text)

    def snippet(i: int) -> Column:
        at = F.pmod(F.xxhash64(F.lit(i), text), F.greatest(size - SNIPPET_CHARS, F.lit(1))) + 1
        return F.substring(text, at.cast("int"), F.lit(SNIPPET_CHARS))

    usable = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.where(~held_out(F.col("id")) & text.isNotNull() & F.col("lang").isNotNull() & text.rlike(r"\p{L}"))
    cut_up = usable.select("lang", F.xxhash64("text").alias("h"), F.array_distinct(F.array(*[snippet(i) for i in range(SNIPPETS)])).alias("snippets"))
    chosen = cut_up.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= SAMPLE_ROWS)
    rows = chosen.select("lang", "n", "snippets").collect()
    pairs = sorted((r["lang"], r["n"], s) for r in rows for s in r["snippets"] if s)
    texts, labels = [s.encode() for _, _, s in pairs], [lang for lang, _, _ in pairs]
    if others and texts:
        rng = np.random.default_rng(7)
        strange = [estranged(s, i % 4, rng).encode() for i, (_, _, s) in enumerate(pairs[:: len(set(labels))])]
        texts, labels = texts + strange, labels + [UNKNOWN] * len(strange)
    return train(texts, labels)


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text: (texts, languages). Every byte is read and labelled."""
    total = np.zeros((len(texts), len(net.languages)))
    owners, starts = [], []
    for i, t in enumerate(texts):
        n = -(-len(t) // SPAN)
        owners += [i] * n
        starts += range(0, len(t), SPAN)
    owner, start = np.array(owners, np.int64), np.array(starts, np.int64)
    for at in range(0, len(owner), SIDE):
        side = slice(at, at + SIDE)
        block = np.zeros((len(owner[side]), SPAN), np.uint8)
        lengths = np.empty(len(block), np.int64)
        for k, (i, s) in enumerate(zip(owner[side].tolist(), start[side].tolist())):
            part = texts[i][s : s + SPAN]
            lengths[k] = len(part)
            block[k, : len(part)] = np.frombuffer(part, np.uint8)
        steps = np.ascontiguousarray(block.T)
        mask = (np.arange(SPAN)[:, None] < lengths).astype(np.float32)
        p = position_probabilities(net, steps, mask)
        np.add.at(total, owner[side], np.einsum("tcb,tb->bc", p, mask))
    return total / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]


def judge(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, see identify."""
    lettered = [bool(t and net.languages and _LETTER.search(t)) for t in texts]
    p = document_probabilities(net, [t.encode() if ok else b"" for t, ok in zip(texts, lettered)])
    best = p.argmax(axis=1).tolist() if net.languages else [0] * len(texts)
    named = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
    return named, [min(1.0, float(row[b])) if ok else 0.0 for row, b, ok in zip(p, best, lettered)]


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id (as doc_id), held_out, lang_pred and score (probability of the prediction).

    A null text or one without a letter is `und` with score 0, as is any text if nothing could be
    learnt. Whole texts are read, of any length; only the text is an input. Null ids and repeated
    rows are rows like others; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, score = judge(net, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kinds = [rows.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return map_arrow(rows, run, StructType(kinds))


def known_shares(net: Network, texts: list[str | None]) -> list[float]:
    """Of each text, the mean probability that a position is in a language of the network and not `und`.

    Zero if the text is null or has no letter, or if nothing could be learnt.
    """
    lettered = [bool(t and net.languages and _LETTER.search(t)) for t in texts]
    p = document_probabilities(net, [t.encode() if ok else b"" for t, ok in zip(texts, lettered)])
    known = [i for i, x in enumerate(net.languages) if x != UNKNOWN]
    return [float(row[known].sum()) if ok else 0.0 for row, ok in zip(p, lettered)]


def in_known_language(docs: DataFrame, net: Network, least_share: float, text_col: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, that have a letter and a known share of at least least_share.

    A text in several known languages is as good as one in a single one. What is in none of them can
    only be told by a network that was taught with `others`.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = known_shares(net, batch.column(at).to_pylist())
            yield batch.filter(pa.array([x > 0 and x >= least_share for x in share], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
