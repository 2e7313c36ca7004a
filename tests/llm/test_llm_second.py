"""Language ID, BPE lexicon, surrogates, syncmers, license scan and the pipeline."""

import hashlib
import random
import re
import string
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import langid, lexicon, licenses, pii, queries, syncmers

CLASHING = "doc_id long, text string, found string, words string, start string, sketch string, id string, kind int"
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5, 1) for r in rows], CLASHING)


def is_native(df) -> bool:
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# language ID


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = langid.train([b"abcab", b"xyzzyx"], ["a", "b"], epochs=0)
    net = langid.Network(net.languages, *[w.astype(np.float64) for w in net[1:]])
    steps = rng.integers(97, 100, (5, 3))
    target, mask = np.array([0, 1, 1]), np.array([[1, 1, 1]] * 4 + [[1, 0, 1]], float)

    def loss(weights):
        p = langid.position_probabilities(langid.Network(net.languages, *weights), steps)
        return -(np.log(p[:, target, np.arange(3)]) * mask).sum() / mask.sum()

    # states are single precision, so differences are taken wide
    for k, g in enumerate(langid._gradients(net, steps, target, mask)):
        for at in [tuple(rng.integers(0, s) for s in g.shape) for _ in range(4)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            plus, minus = [w.copy() for w in net[1:]], [w.copy() for w in net[1:]]
            plus[k][at] += 0.02
            minus[k][at] -= 0.02
            assert abs((loss(plus) - loss(minus)) / 0.04 - g[at]) < 2e-3


def test_documents_pool_their_positions():
    net = langid.train([b"aaaa", b"bbbb"], ["a", "b"], epochs=30)
    text = b"a" * 300 + b"b" * 100
    parts = [text[i : i + langid.SPAN] for i in range(0, len(text), langid.SPAN)]
    rows = [langid.position_probabilities(net, np.frombuffer(p, np.uint8)[:, None])[:, :, 0] for p in parts]
    assert np.allclose(langid.document_probabilities(net, [text, b""])[0], np.concatenate(rows).mean(axis=0), atol=1e-5)
    assert np.allclose(np.concatenate(rows).sum(axis=1), 1, atol=1e-5)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark):
    rows = [(1, "le la les des une", "fr"), (2, "the of and with", "en"), (3, None, "en"), (4, "", None), (5, "12 .. %", "en"), (None, "the " * 30000, None), (2, "the of and with", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert len(found) == 7
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {3, 4, 5}
    assert langid.learn(docs.limit(0)).languages == ()
    assert langid.identify(docs.limit(0), langid.learn(docs)).count() == 0
    kept = langid.in_known_language(docs, langid.learn(docs), 0.0)
    assert kept.columns == docs.columns and kept.count() == 4
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


# BPE

ODD = ["", None, "a", "   x", "İstanbul ΣΑΣ", "<|startoftext|>Hi<|endoftext|>there <|endoftext|>", "don't I'LL 've", "été é", "日本語 テスト", "½ ² ٣ ①", "🙂 ok🙂", "a\x1cb\x85c", "x y 　 z", "tab\tnew\nline", "the&&& and%%%", "͸ \U0001f9ff", "word " * 20000, "x" * 3000]


def test_encoding_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = {r.doc_id: r for r in lexicon.encode_documents(frame(spark, list(enumerate(ODD))), path).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (found[i].n_tokens, found[i].ids) == (len(ids), " ".join(map(str, ids)))
        assert found[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert lexicon.encode_documents(frame(spark, []), path).count() == 0


def test_merging_side_by_side_equals_merging_one_word():
    bpe = lexicon.bpe_of(public_tokenizers.path(queries.WORD_BPE))
    special = next(iter(bpe.special))
    words = ["a", "the", "aaaaaaaaaaaa", "naïve", "€", "ab" * 23, "ab" * 24, "x" * 49, "lengthy" * 60, "!!!!!!!!", "0"]
    listed = [w.encode() for w in words] + [lexicon._MARK + special.encode()] + [b"".join(w) for w in zip([b"th", b"an", b"zq"] * 40, [b"%d" % i for i in range(120)])]
    ids, counts = bpe.merge_all(listed)
    ends = np.cumsum(counts)
    expected = [[bpe.special[special]] if w.startswith(lexicon._MARK) else bpe.merge(w) for w in listed]
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == expected
    assert [len(x) for x in bpe.merge_all([])] == [0, 0]


def test_blocks_without_words_and_bounded_blocks(tmp_path, monkeypatch):
    path = public_tokenizers.path(queries.WORD_BPE)
    lexicon.save(lexicon.compile_lexicon([b"the", b"cat"], path), tmp_path / "l.bin")
    encoder = lexicon.Encoder(lexicon.bpe_of(path), lexicon.Lexicon(str(tmp_path / "l.bin")))
    assert [a.to_pylist() for a in encoder.encode(pa.array(["", " \n ", ""]))] == [[0, 0, 0], [""] * 3, [""] * 3]
    monkeypatch.setattr(lexicon, "BLOCK_BYTES", 10)
    texts = ["the cat", None, "sat on a very long mat", "", "x"]
    blocks = list(lexicon._blocks(pa.array(texts)))
    assert [t for b in blocks for t in b.to_pylist()] == [t or "" for t in texts] and len(blocks) > 1
    assert list(lexicon._blocks(pa.array([], pa.string()))) == []


def test_automaton_is_minimal_and_numbers_its_words(tmp_path):
    words = sorted({(a + b + c).encode() for a in ("", "re", "un") for b in ("do", "tie", "é", "lock") for c in ("", "s", "ing", "er")})
    builder = lexicon.Builder()
    for w in words:
        builder.add(w)
    arrays = builder.arrays()
    lexicon.save(arrays, tmp_path / "l.bin")
    found = lexicon.Lexicon(str(tmp_path / "l.bin"))
    assert found.ranks([*words, b"", b"unknown", b"d", b"dos!"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    suffixes = {frozenset(w[i:] for w in words if w.startswith(p)) for v in words for i in range(len(v) + 1) for p in [v[:i]]}
    assert len(arrays["final"]) == len(suffixes)  # one state for each distinct set of endings


def test_word_counts_cover_all_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame(spark, [(1, "The the THE, it's 42"), (2, None), (3, "the <|endoftext|>")])
    assert {bytes(r.word): r.n for r in lexicon.count_words(docs, path).collect()} == {b"the": 4, b",": 1, b"it": 1, b"'s": 1, b"4": 1, b"2": 1}


# surrogates


def replaced(spark, texts):
    return [r.text for r in pii.replace_entities(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def test_surrogates_keep_kind_shape_and_identity(spark):
    texts = [
        "Mail jo.45@mail7.example.com or +1 (301) 555-0346.",
        "jo.45@mail7.example.com### (301) 555-0346 from 10.0.0.1",
        "card 4111 1111 1111 1111 and 4539578763621486%%%",
        'token = "681c09b8e90e7e8c9575180f595f646cf2969054"',
        "Mrs Anna Smith met Mr. John Smith and Dr. Иван Петров",
        "GB82 WEST 1234 5698 7654 32 and 123-45-6789",
    ]
    mail, second, card, secret, names, more = replaced(spark, texts)
    found = re.fullmatch(r"Mail ([a-z]{2}\.\d\d@\w+\.example\.\w{3}) or (\+1 \(\d{3}\) \d{3}-\d{4})\.", mail)
    assert found and found[1] not in texts[0] and found[2] not in texts[0]
    assert second.startswith(found[1] + "### (")
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", card)
    assert len(cards) == 2 and all(luhn(c.replace(" ", "")) and c not in texts[2] for c in cards)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', secret) and secret != texts[3]
    given_f, smith, given_m, smith2, ivan, petrov = re.fullmatch(r"Mrs (\w+) (\w+) met Mr\. (\w+) (\w+) and Dr\. (\w+) (\w+)", names).groups()
    assert smith == smith2 != "Smith" and given_f.endswith("a") and given_m.endswith("n")
    assert re.fullmatch("[А-Я][а-я]{3}", ivan) and re.fullmatch("[А-Я][а-я]{5}", petrov)
    iban = re.search(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", more)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_other_text_stays(spark):
    clean = ["Die Frau ging 1234 mal.", "not 4111 1111 1111 1112", "999.1.1.1 and v1.2.3.4.5", "a@b", "", None, "12 34 56", "deadbeef", "x" * 50000]
    assert replaced(spark, clean) == clean


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    def few(stream):
        return F.concat(F.lit("10.0.0."), F.pmod(F.conv(F.substring(stream, 1, 4), 16, 10).cast("int"), F.lit(200)).cast("string"))

    monkeypatch.setattr(pii, "_octets", few)
    values = [f"10.0.0.{i}" for i in range(60)]
    made = replaced(spark, values + [f"{v} and {v}" for v in values])
    single = made[: len(values)]
    assert len(set(single)) == len(values)
    assert not set(single) & set(values)
    assert made[len(values) :] == [f"{v} and {v}" for v in single]


def test_short_names_do_not_run_out_of_surrogates(spark):
    names = [a + b for a in "ABCDEFGH" for b in "aeiouxyz"][:60]
    made = replaced(spark, [f"Ms {n} Wang" for n in names])
    given = [re.fullmatch(r"Ms ([A-Z][a-z]*a) [A-Z][a-z]{3}", m)[1] for m in made]
    assert len(set(given)) == 60 and not set(given) & set(names)


@pytest.mark.parametrize(
    "text",
    [
        "pay #4111111111111111# 123",
        "pay #4111 1111 1111 1111# 12 times",
        "order 77 #4111-1111-1111-1111# now",
        "#4111 1111 1111 1111# #4539578763621486#",
        "call #555-123-4567# today",
        "call #+33 1 23 45 67 89# today",
        "call #0171 1234567#.",
        "7 #4111 1111 1111 1111# #555-123-4567# end",
    ],
)
def test_cards_between_groups_and_national_phones(spark, text):
    values = text.split("#")[1::2]
    plain = text.replace("#", "")
    made = replaced(spark, [plain])[0]
    pattern = "".join(re.escape(p) if i % 2 == 0 else re.sub("[0-9]", "[0-9]", re.escape(p)) for i, p in enumerate(text.split("#")))
    assert re.fullmatch(pattern, made) and not any(v in made for v in values)


def test_all_names_and_later_mentions_go(spark):
    made = replaced(spark, ["Mr John Paul Smith came. Later John and Smith's dog left, Smithson stayed.", "John and Smith"])
    john, paul, smith, john2, smith2 = re.fullmatch(r"Mr (\w+) (\w+) (\w+) came\. Later (\w+) and (\w+'?\w*) dog left, Smithson stayed\.", made[0]).groups()
    assert (john, smith) == (john2, smith2.removesuffix("'s")) and not {john, paul, smith} & {"John", "Paul", "Smith"}
    assert made[1] == "John and Smith"


def test_surrogates_keep_rows_and_columns(spark):
    docs = frame(spark, [(None, "a.b@c.de"), (1, "a.b@c.de"), (1, "a.b@c.de"), (2, None)])
    found = pii.replace_entities(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert len(rows) == 4 and len({r.text for r in rows}) == 2
    assert is_native(found)
    assert pii.replace_entities(frame(spark, [])).count() == 0


# syncmers


def chained(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return struct.unpack("<q", struct.pack("<Q", h))[0]


def brute_anchors(text):
    words = re.sub(r"[\t\n\x0b\f\r ]+", " ", text).strip(" ").lower().split(" ")
    h = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)))[0] for w in words]
    if len(h) < 5:
        return [(0, chained(*h) & 0x7FFFFFFF)]
    pairs = [chained(*h[i : i + 2]) for i in range(len(h) - 1)]
    found = [(i, chained(*h[i : i + 5]) & 0x7FFFFFFF) for i in range(len(h) - 4) if min(pairs[i : i + 4]) in (pairs[i], pairs[i + 3])]
    return found or [(0, chained(*h) & 0x7FFFFFFF)]


TEXTS = ["the quick brown fox jumps over the lazy dog and runs on " * 3, "", " ", "one two", "a b c d e", "été ça va bien et toi mon ami de toujours", "a b c d e", "x y z " * 200, *(f"five words are here {i}" for i in range(12))]


def test_anchors_equal_brute_force(spark):
    found = {r.doc_id: [(a.place, a.hash) for a in r.anchors] for r in syncmers.anchors(frame(spark, list(enumerate(TEXTS)))).collect()}
    assert found == {i: brute_anchors(t) for i, t in enumerate(TEXTS)}


def brute_likeness(a, b):
    a, b = ({h for _, h in brute_anchors(t)} for t in (a, b))
    a, b = set(sorted(a)[:64]), set(sorted(b)[:64])
    both = sorted(a | b)[:64]
    return len(set(both) & a & b) / len(both)


def test_edited_texts_and_likeness_equal_brute_force(spark):
    order = [5, 3, 9, 1, 20, 7, 2, 11, *range(30, 42)]
    docs = sorted(zip(order, TEXTS))
    found = {r.doc_id: r for r in syncmers.fingerprint_digest(syncmers.compare_with_edit(frame(spark, list(zip(order, TEXTS))).repartition(3))).collect()}
    for k, (i, text) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == brute_likeness(text, edited) and r.near_next == brute_likeness(text, following)
    assert found[3].fingerprint == found[9].fingerprint or TEXTS[1] != TEXTS[2]
    assert found[20].fingerprint == found[2].fingerprint


def test_syncmer_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "p q r s t u v w"), (3, "k l m n o p q")]
    found = syncmers.fingerprint_digest(syncmers.compare_with_edit(frame(spark, rows))).collect()
    assert sorted((r.doc_id, r.n_chars) for r in found if r.doc_id) == [(1, 11), (1, 11), (2, 0), (3, 13)]
    assert next(r for r in found if r.doc_id is None).edited_sha256 == hashlib.sha256(b"p q r s ").hexdigest()
    assert syncmers.compare_with_edit(frame(spark, [])).count() == 0
    alone = syncmers.fingerprint_digest(syncmers.compare_with_edit(frame(spark, [(4, "a b c d e f g h i")]))).first()
    assert alone.near_next == 1.0
    assert is_native(syncmers.fingerprints(frame(spark, rows)))


def test_common_anchors_match_places(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, "intro words here " + passage), (2, passage + " and an end")])
    a, b = [r.anchors for r in syncmers.anchors(docs).orderBy("doc_id").collect()]
    both = spark.createDataFrame([(a, b)], "l array<struct<place:int,hash:int>>, r array<struct<place:int,hash:int>>")
    pairs = both.select(syncmers.matched_places(F.col("l"), F.col("r")).alias("p")).first().p
    assert len(pairs) >= 8 and {p.left - p.right for p in pairs} == {3}


# licenses


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_phrases_equal_brute_force(spark):
    texts = ["The MIT License, mit-license", "cc by cc by-sa", "gnu general public license gnu general public", "apache  LICENSE\nApache License", None, "", "...", "committed license", "été mit license é", "cc byé", "ſ MİT license", "mit license " * 3000]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300).collect()
    rows = list(enumerate(texts)) + [(1000 + r.doc_id, r.text) for r in docs]
    found = {r.doc_id: r for r in licenses.license_digest(licenses.scan_licenses(frame(spark, rows))).collect()}
    for i, text in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0", ["apache-2.0"]),
        ("SPDX-License-Identifier: GPL-3.0-or-later", ["gpl-3.0"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["cc-by-nc-sa-4.0"]),
        ("GNU Lesser General Public License, version 2.1", ["lgpl-2.1"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["mit"]),
        ("the MIT License and the Apache License", ["mit", "apache"]),
        ("a license to read", []),
    ],
)
def test_rules_and_their_suppression(spark, text, labels):
    found = licenses.scan_licenses(frame(spark, [(1, text)])).first().detections
    assert [d.label for d in found] == labels
    assert all(not (a is not b and a.start <= b.start and b.stop <= a.stop) for a in found for b in found)


def test_rules_are_many_and_keyed():
    keys = re.compile("|".join(licenses.KEYWORDS))
    assert 200 < len(licenses.rules()) < 500
    assert all(keys.fullmatch(r.keyword) or r.keyword in ("gplv2", "gplv3") for r in licenses.rules())


def examples(parsed, pick):
    """One text that a parsed pattern matches."""
    made = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            made += chr(arg)
        elif op == "NOT_LITERAL":
            made += "a"
        elif op == "IN":
            kind, value = arg[0]
            made += "a" if str(kind) == "NEGATE" else chr(value if str(kind) == "LITERAL" else value[0])
        elif op == "BRANCH":
            made += examples(pick(arg[1]), pick)
        elif op == "SUBPATTERN":
            made += examples(arg[3], pick)
        elif op == "MAX_REPEAT":
            made += "".join(examples(arg[2], pick) for _ in range(pick([arg[0], min(arg[1], arg[0] + 1)])))
        else:
            raise ValueError(op)
    return made


def test_every_rule_opens_for_its_own_text_alone(spark):
    pick = random.Random(1).choice
    rules = licenses.rules()
    rows = [(i, examples(re._parser.parse(r.pattern), p)) for i, r in enumerate(rules) for p in (lambda x: x[0], lambda x: x[-1], pick, pick)]
    found = licenses.scan_licenses(frame(spark, [(k, text) for k, (_, text) in enumerate(rows)])).collect()
    bad = []
    for d in found:
        rule, text = rules[rows[d.doc_id][0]], rows[d.doc_id][1]
        n = len(re.findall("[0-9a-z]+", text))
        if not any(x.start == 0 and x.stop == n and x.confidence >= rule.confidence for x in d.detections):
            bad.append((rule.label, text))
    assert not bad
    assert len(found) == 4 * len(rules)


@pytest.mark.parametrize(
    ("text", "label"),
    [("LGPLv3", "lgpl-3.0"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"), ("GPL2", "gpl-2.0"), ("GPL3", "gpl-3.0"), ("just do what the fuck", None), ("You just do what the fuck you want to.", "wtfpl"), ("released under CC BY 4.0", "cc-by,cc-by-4.0")],
)
def test_forms_in_one_word_open_their_rules(spark, text, label):
    row = licenses.license_digest(licenses.scan_licenses(frame(spark, [(1, f"x {text} y")]))).first()
    assert row.labels == (label or "") and row.score == (0.9 if text.startswith("released") else 0.7 if label else 0.0)


def test_license_scan_is_native_and_takes_odd_tables(spark):
    assert is_native(licenses.license_digest(licenses.scan_licenses(frame(spark, [(1, "x")]))))
    assert licenses.scan_licenses(frame(spark, [])).count() == 0
    assert licenses.scan_licenses(frame(spark, [(None, "mit license"), (None, "mit license")])).count() == 2


# pipeline


def test_pipeline_stages(spark):
    prose = {"en": "the people of this place went on with their work and their days ", "fr": "les gens de cette ville sont allés avec leurs travaux et leurs jours "}
    rows = [(i, prose[lang] * 4 + f"{lang} number {w} " * 6, lang, "s", 1) for i, (lang, w) in enumerate((x, y) for x in prose for y in ("alpha", "beta", "gamma"))]
    rows += [(50, rows[0][1], "en", "s", 1), (51, "12345 %%%", "en", "s", 1), (52, None, None, None, None), (53, rows[1][1] + " mail bob.7@mail.example.com", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {51, 52}
    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert single.columns == docs.columns and 50 not in {r.doc_id for r in single.collect()}
    safe = corpus_pipeline.private_data(spark, single, SF)
    assert safe.columns == docs.columns and safe.count() == single.count()
    assert not safe.where(F.col("text").contains("bob.7@mail")).count()
    packed = corpus_pipeline.packing(spark, safe, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in single.collect()}


def test_pipeline_rejects_what_is_in_no_learnt_language(spark):
    rng = random.Random(3)
    parts = {"en": ["th", "er", "an", "re", "tion", "hand", "ing", "wh"], "de": ["sch", "ung", "ein", "ver", "keit", "ä", "ch", "zu"]}
    prose = {x: lambda n, p=p: " ".join("".join(rng.choices(p, k=rng.randint(1, 4))) for _ in range(n)) + "." for x, p in parts.items()}
    rows = [(i, prose[lang](60), lang) for i, lang in enumerate(["en", "de"] * 60)]
    both = [(900, prose["en"](40) + " " + prose["de"](40), None), (901, prose["de"](8), None)]
    strange = [
        "A magyar nyelv az uráli nyelvcsalád tagja, a finnugor nyelvek közé tartozó ugor nyelvek egyike. ",
        "Русский язык является одним из восточнославянских языков. ",
        "def f(x):\n    return [y**2 for y in range(x) if y % 3 == 0]\n",
        "sdfkj asdlkfj qwpoeiru zxmcnv lksjdf qpwoeiru mnbzxcv lkjasdf ",
        "汉语是世界上使用人数最多的语言。",
        "12345 %%%",
    ]
    docs = spark.createDataFrame([*rows, *both, *[(1000 + i, t * 5, None) for i, t in enumerate(strange)], (2000, None, "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == {r[0] for r in rows + both}


def test_strange_snippets_keep_all_but_letters():
    text = "Été à la mer, 12 jours!"
    made = [langid.estranged(text, kind, np.random.default_rng(1)) for kind in range(4)]
    assert len({text, *made}) == 5
    assert {re.sub(r"[^\W\d_]", "x", t) for t in made} == {re.sub(r"[^\W\d_]", "x", text)}
    assert sorted(made[1]) == sorted(text)


def test_pipeline_runs_over_a_folder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = corpus_pipeline.run(spark, SF)
    ids = {r.doc_id for r in found.select("doc_id").collect()}
    firsts = {r.doc_id for r in queries.op2_simhash(spark, SF).where("doc_id = component_id").collect()}
    assert ids == firsts and len(ids) < docs.count()


def test_packed_sequences_hold_the_ids(spark):
    texts = ["one two three " * 900, "été 日本", "", None, "one two three " * 900]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "again"])] + [(5, "again"), (None, "x y")], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [[*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()]
    found = corpus_pipeline.packing(spark, docs, SF).collect()
    sequences = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        at = sequences.setdefault(r.sequence_id, [])
        assert r.offset == len(at) and r.length == len(r.ids) // 4
        at.extend(np.frombuffer(r.ids, "<u4").tolist())
    assert max(map(len, sequences.values())) <= 1024
    assert sorted(x for s in sequences.values() for x in s) == sorted(x for e in expected for x in e)
    for i in range(5):
        mine = sorted((r.start, r.ids) for r in found if r.doc_id == i)
        assert np.frombuffer(b"".join(ids for _, ids in mine), "<u4").tolist() == expected[i]
    assert sum(r.doc_id == 5 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1
