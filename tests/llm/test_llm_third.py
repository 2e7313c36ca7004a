"""Prefix trie, toxic passages and tokenizer alignment against brute force, SQL and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import align, queries, simhash, toxicity, trie
from plumbline.llm.oracles import ORACLES
from plumbline.llm.shared import running_totals

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# running totals


def test_running_totals_carry_over_partitions(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 3500, 7).otherwise(F.col("id") % 40).cast("long").alias("k"), "id", (F.col("id") % 5 - 2).alias("v")
    )
    found = running_totals(rows.repartition(9), "k", ["id"], {"upto": "v", "again": "id"}).collect()
    sums, again = Counter(), Counter()
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.id)):
        sums[r.k] += r.v
        again[r.k] += r.id
        expected[r.id] = (sums[r.k], again[r.k])
    assert {r.id: (r.upto, r.again) for r in found} == expected
    assert len({r.upto for r in found if r.k == 7}) > 2


# prefix trie

TURNS = "conv_id long, turn int, role string, text string, depth string, first_id int, Weight int, l1 string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], TURNS).repartition(5)


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + said[h:]
    members = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += kids[k] == 0
    found = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        found.append((min(m), len(k), parent, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=str)


def some_turns(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(60), -3, -5, 10**12 + 2, 10**12]:
        for t in range(int(rng.integers(1, 14))):
            rows.append((c, t, ["user", "assistant"][t % 2], str(rng.choice(["a", "bé", "ccc", ""]))))
    rows += [(200 + 5 * i, t, "user", f"same {t}") for i in range(40) for t in range(4)]
    rows += [(301, t, "user", f"long {t}") for t in range(300)]
    rows += [(None, 1, "user", "a"), (302, None, None, None), (302, 1, "user", None), (302, 1, "user", "b"), (302, 1, "user", "b")]
    return rows


def trie_rows(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_TURNS", 16)
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rows = some_turns()
    assert trie_rows(trie.trie_digest(turns_of(spark, rows))) == brute_trie(rows)


def test_trie_of_empty_table_and_of_one_turnless_conversation(spark):
    assert trie.trie_digest(turns_of(spark, [])).count() == 0
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(lone, 0, "user", "a")]
    assert trie_rows(trie.trie_digest(turns_of(spark, rows))) == brute_trie(rows)
    assert brute_trie(rows)[0][1] == 0 and len(brute_trie(rows)) == 1


def test_trie_without_rebuilding_and_texts_of_its_nodes(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "c"), (3, 0, "user", "a")]
    nodes, ends = trie.prefix_trie(turns_of(spark, rows), rebuild=False)
    found = {(r.conv_id, r.depth): r for r in trie.texts_of(nodes, turns_of(spark, rows), rebuild=False).collect()}
    assert {k: (r.role, r.text, r.n_convs, r.n_ends) for k, r in found.items()} == {
        (1, 0): (None, None, 3, 0), (1, 1): ("user", "a", 3, 1), (1, 2): ("bot", "b", 1, 1), (2, 2): ("bot", "c", 1, 1)
    }
    assert sorted(r.conv_id for r in ends.collect()) == [1, 2, 3]


def test_trie_query_equals_its_sql(spark):
    got = queries.QUERIES["op11_trie"](spark, SF)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    wanted = connection.execute(ORACLES["op11_trie"])
    assert got.columns == [d[0] for d in wanted.description]
    assert trie_rows(got) == sorted(wanted.fetchall(), key=str)


# toxic passages


def brute_segments(scores):
    """Maximal segments by their definition: best segment first, then the same to its left and right."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > best + 1e-12:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    left, right = brute_segments(scores[:i]), brute_segments(scores[j:])
    return [*left, (i, j - i, best), *[(a + j, n, s) for a, n, s in right]]


@pytest.mark.parametrize("seed", range(40))
def test_segments_equal_their_definition(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(-9, 7, int(rng.integers(0, 25))) / 7 + rng.random() / 97 for _ in range(6)]
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    found = list(toxicity.scan(np.concatenate(texts), bounds))
    assert len(found) == len(texts)
    for got, text in zip(found, texts):
        want = brute_segments(list(text))
        assert [(a, n) for a, n, _ in got] == [(a, n) for a, n, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_words_are_those_of_the_pattern():
    texts = [None, "", "Ab, cd-EF  été «x» “y” 漢字。z 1a", "...", "one"]
    words = toxicity.words_of(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, words.bounds[:-1], words.bounds[1:]):
        assert [words.distinct[int(c)].as_py() for c in words.codes[a:b]] == [w.lower() for w in toxicity._WORD.findall(t or "")]


DOCUMENTS = "doc_id long, text string, score double, toxic string, n_words int, evidence string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", 1, "y") for r in rows], DOCUMENTS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def planted(n=600):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, int(rng.integers(5, 200)))]
        toxic = i % 8 == 0
        if toxic:
            at = int(rng.integers(0, len(text)))
            text[at:at] = ["zzdreck", "zzdreckig", "Zzdreck"]
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxic_passages_are_found_where_they_were_planted(spark):
    rows, marks = planted()
    rows += [(9000, "Clean start. zzdreck, ZZDRECKER zzdreck! and a clean end"), (9001, None), (9002, ""), (9003, "."), (None, "abc"), (9000, "x")]
    rows += [(9004, "cab " * 30000 + "zzdreck zzdreckis zzdreck" + " bad" * 30000)]
    model = toxicity.learn(docs_of(spark, rows), labels_of(spark, marks))
    found = toxicity.toxic_passages(docs_of(spark, rows).repartition(3), model).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    truth = dict(marks)
    assert all((by_id[i][0].score >= 0.3) == bool(t) for i, t in truth.items())
    named = max(by_id[9000], key=lambda r: r.n_words)
    assert [rows[600][1][p.start : p.start + p.length] for p in named.passages] == ["zzdreck, ZZDRECKER zzdreck"]
    assert named.score >= 0.3 and named.passages[0].e_value <= toxicity.SIGNIFICANT
    for i in (9001, 9002, 9003):
        assert by_id[i][0].n_words == 0 and 0 < by_id[i][0].score < 0.3 and by_id[i][0].passages == []
    long = by_id[9004][0]
    assert long.n_words == 60003 and [p.length for p in long.passages] == [25]


def test_toxicity_without_labels_or_rows(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    model = toxicity.learn(docs, labels_of(spark, []))
    assert [r.score for r in toxicity.toxic_passages(docs, model).collect()] == [pytest.approx(0.5)] * 2
    one_class = toxicity.learn(docs, labels_of(spark, [(1, 0), (2, None), (None, 1)]))
    assert toxicity.toxic_passages(docs_of(spark, []), one_class).count() == 0


def test_training_takes_each_text_once_with_the_majority_of_its_labels(spark):
    docs = docs_of(spark, [(1, "a"), (2, "a"), (3, "a"), (3, "a"), (4, "b"), (4, "c"), (5, None), (6, "d")])
    labels = labels_of(spark, [(1, 1), (2, 0), (3, 0), (4, 1), (4, 1), (5, 1), (7, 1)])
    found = sorted((r.text, r.toxic) for r in toxicity.training_texts(docs, labels).collect())
    assert found == [("a", 0), ("b", 1), ("c", 1)]


def test_toxicity_query_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    found = toxicity.toxicity_digest(some, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    caught = sum(r.toxic and r.predicted for r in held)
    assert caught >= 0.85 * sum(r.toxic for r in held)
    assert caught >= 0.85 * sum(r.predicted for r in held)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


# alignment


def brute_alignment(rows):
    a_tok = Tokenizer.from_file(A_PATH)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    back = align._byte_of_char()
    found, count = [], Counter()
    for doc_id, text in rows:
        found.append([doc_id, 0, 0, 0, [], ""])
        if not text:
            continue
        a, b = a_tok.encode(f" {text}", add_special_tokens=False).ids, b_tok.encode(text)
        a_bytes = [bytes(back[c] for c in a_tok.id_to_token(i)) for i in a]
        b_bytes = []
        for piece in map(b_tok.id_to_piece, b):
            m = re.fullmatch("<0x(..)>", piece)
            b_bytes.append(bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode())
        if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            continue
        a_ends, b_ends = np.cumsum(list(map(len, a_bytes))), np.cumsum(list(map(len, b_bytes)))
        links, groups, low = [], [], 0
        for i, (s, e) in enumerate(zip(a_ends - list(map(len, a_bytes)), a_ends)):
            j = int(np.searchsorted(b_ends, s, "right"))
            while j < len(b) and b_ends[j] - len(b_bytes[j]) < e:
                links.append((a[i], b[j]))
                j += 1
        for c in sorted(set(a_ends) & set(b_ends)):
            parts = [",".join(str(t) for t, e in zip(ids, ends) if low < e <= c) for ids, ends in ((a, a_ends), (b, b_ends))]
            groups.append("|".join(parts))
            low = c
        count.update(links)
        found[-1] = [doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()]
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        [(d, a, b, g, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), h) for d, a, b, g, ls, h in found], key=str
    )


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n c "), (5, "<|endoftext|> hi <s> </s><unk>"), (6, "▁x y"), (7, "日本語 テキスト ＡＢＣ ﬁ"),
    (8, "\x00 a\x1cb \x1f c"), (9, "été " * 900), (10, "tab\t x \n\ny"), (None, "null id"), (None, "null id"), (11, " lead"), (12, "😀😀 ok z"),
    (13, "a" * 3000), (14, "x \ny"), (15, "\ny z"), (16, "é a   b"), (17, "the the thing"), (17, "the other"),
]


def aligned_rows(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, links string, chunk int, n_a string")
    return sorted([tuple(r) for r in align.alignment_digest(frame.repartition(3), A_PATH, B_PATH).collect()], key=str)


def test_alignment_equals_brute_force(spark):
    assert aligned_rows(spark, ODD) == brute_alignment(ODD)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    assert aligned_rows(spark, docs) == brute_alignment(docs)


def test_alignment_of_empty_table(spark):
    assert aligned_rows(spark, []) == []


def test_lanes_and_blocks_don_t_change_the_links(monkeypatch):
    pair = align.pair_of(A_PATH, B_PATH)
    texts = pa.array([t for _, t in ODD], pa.string())
    a, a_bounds, b, b_bounds = pair.tokens(texts)
    whole = align.merge(np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b]), a_bounds)
    monkeypatch.setattr(align, "LANE_TOKENS", 3)
    cut = align.merge(np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b]), a_bounds)
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut))
    monkeypatch.setattr(align, "MEMORY", 2)
    again = align.Pair(A_PATH, B_PATH).tokens(texts)
    assert all(np.array_equal(x, y) for x, y in zip((a, a_bounds, b, b_bounds), again))


def test_aligned_documents_give_links_and_cuts(spark):
    frame = spark.createDataFrame([(1, "unbelievable things"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in align.align_documents(frame, A_PATH, B_PATH).collect()}
    pair = align.pair_of(A_PATH, B_PATH)
    r = rows[1]
    a_ends, b_ends = np.cumsum(pair.a_length[r.a_ids]), np.cumsum(pair.b_length[r.b_ids])
    assert r.cuts == sorted(set(a_ends.tolist()) & set(b_ends.tolist())) and r.cuts[-1] == len(" unbelievable things")
    for i, (first, last) in enumerate(zip(r.first_b, r.last_b)):
        s = a_ends[i] - pair.a_length[r.a_ids[i]]
        assert first == np.searchsorted(b_ends, s, "right") and last == np.searchsorted(b_ends, a_ends[i], "left")
    assert rows[2].a_ids == [] and rows[2].cuts == []


# keeping one of each group of near copies


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue white black"

    def kept(rows):
        frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hash int")
        return sorted(((r.doc_id, r.text) for r in simhash.keep_one_of_each(frame).collect()), key=str)

    assert kept([(5, a), (5, c)]) == [(5, a), (5, c)]
    assert kept([(3, b), (5, a), (5, b)]) == [(3, b), (5, a)]
    assert kept([(1, a), (1, a), (2, a), (4, c)]) == [(1, a), (4, c)]
    assert kept([(None, a), (None, a), (2, a), (7, None), (8, "")]) == [(2, a), (7, None), (None, a), (None, a)]
    assert kept([]) == []
