"""Packing, SimHash, WARC, neighbours and chat formatting against brute force and exact round trips."""

import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import chat, neighbours, packing, queries, simhash, warc
from plumbline.llm.shared import connected_components

DOCS = "doc_id long, text string, sequence_id string, fingerprint string, component_id string, length string, id string, Fp int"


def rows_of(spark, rows, schema=DOCS):
    return spark.createDataFrame([(*r, *["x"] * 5, 1) for r in rows], schema)


def some_documents(n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "ndea", "erst", "onhe", "thing", "été", "straße", "42", "don't", "x,"]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 400)))) for _ in range(n)]
    texts += [texts[0], texts[1] + " tail", None, "", " \n\t ", "one", "a  b\n c", "long " * 4000, "<|endoftext|> a <|endoftext|>"]
    return list(enumerate(texts))


# packing


def brute_pieces(text):
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [2]
    rest = len(ids) % 1024
    cuts = [0] * bool(rest) + list(range(rest, len(ids), 1024))
    return [(k, a, ids[a : (cuts[k + 1] if k + 1 < len(cuts) else len(ids))]) for k, a in enumerate(cuts)]


def test_packing_places_every_piece_once_and_tightly(spark):
    docs = some_documents()
    found = queries.packed_digest(rows_of(spark, docs).repartition(5)).collect()
    expected = {(d, k): (a, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in docs for k, a, i in brute_pieces(t)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == expected
    assert len(found) == len(expected)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * -(-sum(r.length for r in found) // 1024) + 1


def test_token_bytes_equal_the_library():
    encoder = packing.encoder_of(public_tokenizers.path(queries.BYTE_BPE))
    texts = ["", " a", "a ", "  ", "a  b", "x\n y", "don't I'll", "é\xa0b", "\n", "a\nb c!\nd", "日本 語", "<|endoftext|> hi", "word" * 3000 + " b", "straße, naïve; Ωmega", "tab\tnew", "x" * 47 + " " + "y" * 48, "1 a1 !a"]
    found = packing.token_bytes(pa.array(texts), encoder).to_pylist()
    asked = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == asked
    assert packing.token_bytes(pa.array(["", ""]), encoder, b"end!").to_pylist() == [b"end!"] * 2


def test_packing_merges_residuals_over_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    items = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).alias("length"))
    found = packing.pack(items, 1024, local_items=40).collect()
    assert sorted(r.id for r in found) == list(range(2000))
    total = sum(r.length for r in found)
    assert len({r.sequence_id for r in found}) <= 1.05 * -(-total // 1024)


def test_best_fit_takes_the_fullest_open_bin():
    assert packing.best_fit(np.array([600, 400, 500, 424, 100]), 1024).tolist() == [0, 1, 1, 0, 1]


def test_packing_of_empty_table_and_repeated_rows(spark):
    assert queries.packed_digest(rows_of(spark, [])).count() == 0
    assert queries.packed_digest(rows_of(spark, [(1, "a"), (1, "a"), (None, "a")])).count() == 3


# SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {d: d for d, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, f in prints:
        for b, g in prints:
            if a < b and (f ^ g).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in prints}


def test_simhash_equals_brute_force(spark):
    docs = some_documents()
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_classes(rows_of(spark, docs)).collect()}
    prints = [(d, brute_fingerprint(t)) for d, t in docs]
    components = brute_components(prints)
    assert found == {d: (f"{f:016x}", components[d]) for d, f in prints}


def test_ball_links_connect_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 20, dtype=np.int64)
    prints = sorted({int(b) ^ int(m) for b in base for m in [0, *(sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 5), replace=False)) for _ in range(12))]})
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    expected = brute_components([(p, p) for p in prints])
    assert {p: got.get(p, p) for p in prints} == expected


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_simhash_nulls_repeats_and_empty_table(spark):
    rows = [(5, "same words here"), (5, "same words here"), (None, "same words here"), (None, "nobody else says this"), (3, None), (4, "")]
    found = [(r.doc_id, r.component_id) for r in simhash.simhash_classes(rows_of(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(5, 5), (5, 5), (None, 5), (None, None), (3, 3), (4, 3)], key=str)
    assert simhash.simhash_classes(rows_of(spark, [])).count() == 0
    kept = simhash.keep_one_of_each(rows_of(spark, rows))
    assert kept.columns == rows_of(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 5, None, None]


# WARC


def test_archives_round_trip_and_revisits(spark, tmp_path):
    big, other = "<p>ä</p>" * 40, "<b>" + "y" * 5000
    rows = [(3, "http://a/ b", big), (1, "http://c", big), (2, None, big), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (None, "u", big), (5, "u", other), (5, "u", other), (1, "http://c", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "w")
    found = warc.archive_pages(pages, folder).collect()
    assert len(found) == len(rows)
    stored = [r for r in found if r.record_type == "response"]
    assert sorted((r.page_id for r in stored), key=str) == sorted([1, 1, 7, 8, 9, None, 5, 5], key=str)
    assert sorted((r.page_id, r.refers_to) for r in found if r.record_type == "revisit") == [(2, 1), (3, 1)]
    texts = {(i, (h or "").encode()) for i, _, h in rows}
    assert {(r.page_id, bytes(r.payload)) for r in stored} <= texts
    for r in found:
        want = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(want), hashlib.sha256(want).hexdigest())


def test_dictionary_leads_the_archive_and_serves_single_records():
    records = [warc.record_bytes(i, f"http://x/{i}", (f"<html>{i}" + "common markup " * 20).encode(), "d", None) for i in range(400)]
    data = warc.archive_bytes(records)
    assert data[:4] == warc.SKIPPABLE
    assert list(warc.read_archive(io.BytesIO(data))) == records
    assert warc.build_dictionary(records)


def test_archives_of_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages, str(tmp_path / "e")).count() == 0


# neighbours


@pytest.mark.parametrize("sizes", [(7, 11), (64, 4096)])
def test_nearest_equals_brute_force(spark, sizes):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 24)).astype(np.float32)
    vectors[100:180] = vectors[99]
    vectors[200] = 0
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    rows += [(400, None, "x"), (401, [], "x"), (402, [None] * 24, "x"), (403, [float("nan")] * 24, "x"), (404, [1.0, float("inf")], "x"), (405, [1.0, 2.0], "x"), (420, [2.0, 1.0], "x"), (None, rows[1][1], "x"), rows[40], rows[41]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    found = defaultdict(list)
    for r in neighbours.nearest(table.repartition(3), F.col("vec_id") % 20 == 0, query_rows=sizes[0], candidate_rows=sizes[1]).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    usable = [i for i in range(300) if i != 200]
    exact = vectors.astype(np.float64)
    for q in [i for i in usable if i % 20 == 0]:
        score = {c: float(np.cumsum(exact[q] * exact[c])[-1]) for c in usable if c != q}
        want = sorted(score, key=lambda c: (-score[c], c))[:20]
        assert [(k + 1, c, score[c]) for k, c in enumerate(want)] == sorted(found.pop(q))
    assert found == {420: [(1, 405, 4.0)]}


def test_nearest_of_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(table, F.col("vec_id") % 20 == 0).count() == 0


# chat


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "\\\\", "<|turn|", "<<<SYS>>", "<|turn|><|turn|>", "<|<|end|>end|>", "é\n\\<|text|>"])
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in chat.CONTROL)


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_conversations_round_trip(spark, limit):
    rows = [(1, 2, "assistant", "ünï </s>"), (1, 1, "user", None), (2, None, "assistant", "first"), (2, 0, None, "<|end|>"), (None, 0, "a\n<|text|>", "x"), (3, 0, "assistant", "y" * 3000), (3, 0, "assistant", "y" * 3000)]
    table = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn int, role string, text string, chunk int, loss string")
    chunks = chat.format_conversations(table, limit)
    found = {r.conv_id: r for r in queries.conversation_digest(chunks).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want[c].append((role or "", text or ""))
    assert set(found) == set(want)
    for c, turns in want.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        got = found[c]
        assert (got.n_turns, got.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert queries.conversation_digest(chat.format_conversations(table.limit(0))).count() == 0
