"""License scan with ordered signature rules.

Texts become lower-case words joined by single spaces. One cheap keyword test lets most documents
through untouched; for the others only the rules of the keywords found are run. Detections are
ordered by start, length and priority, and one that lies within another is suppressed. All of it
is DataFrame expressions over a fixed table of rules; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words once A-Z are lower-case, and the base phrases with their labels.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_LIC = "licen[sc]e"

#: Families: label, words of the SPDX tag, how texts name it, keyword (one of KEYWORDS' words).
FAMILIES = [
    ("apache-1.0", "apache 1 0", rf"apache (?:software )?{_LIC}(?: version| v)? 1 0", _LIC),
    ("apache-1.1", "apache 1 1", rf"apache (?:software )?{_LIC}(?: version| v)? 1 1", _LIC),
    ("apache-2.0", "apache 2 0", rf"apache (?:software )?{_LIC}(?: version| v)? 2(?: 0)?", _LIC),
    ("gpl-1.0", "gpl 1 0", rf"gnu general public {_LIC}(?: version| v)? 1(?: 0)?", _LIC),
    ("gpl-2.0", "gpl 2 0", rf"(?:gnu )?general public {_LIC}(?: version| v)? 2(?: 0)?", _LIC),
    ("gpl-3.0", "gpl 3 0", rf"(?:gnu )?general public {_LIC}(?: version| v)? 3(?: 0)?", _LIC),
    ("lgpl-2.0", "lgpl 2 0", rf"(?:gnu )?(?:library|lesser) general public {_LIC}(?: version| v)? 2(?: 0)?", _LIC),
    ("lgpl-2.1", "lgpl 2 1", rf"(?:gnu )?lesser general public {_LIC}(?: version| v)? 2 1", _LIC),
    ("lgpl-3.0", "lgpl 3 0", rf"(?:gnu )?lesser general public {_LIC}(?: version| v)? 3(?: 0)?", _LIC),
    ("agpl-3.0", "agpl 3 0", rf"(?:gnu )?affero general public {_LIC}(?: version| v)?(?: 3)?(?: 0)?", _LIC),
    ("gfdl-1.1", "gfdl 1 1", rf"gnu free documentation {_LIC}(?: version| v)? 1 1", _LIC),
    ("gfdl-1.2", "gfdl 1 2", rf"gnu free documentation {_LIC}(?: version| v)? 1 2", _LIC),
    ("gfdl-1.3", "gfdl 1 3", rf"gnu free documentation {_LIC}(?: version| v)? 1 3", _LIC),
    ("mit", "mit", rf"(?:the )?(?:mit|expat) {_LIC}", _LIC),
    ("mit-0", "mit 0", rf"mit no attribution(?: {_LIC})?", "mit no attribution"),
    ("x11", "x11", rf"(?:the )?x11 {_LIC}", _LIC),
    ("isc", "isc", rf"(?:the )?isc {_LIC}", _LIC),
    ("bsd-2-clause", "bsd 2 clause", rf"(?:simplified|freebsd|2 clause|two clause) bsd {_LIC}|bsd (?:2|two) clause {_LIC}", _LIC),
    ("bsd-3-clause", "bsd 3 clause", rf"(?:new|modified|revised|3 clause|three clause) bsd {_LIC}|bsd (?:3|three) clause {_LIC}", _LIC),
    ("bsd-4-clause", "bsd 4 clause", rf"(?:original|4 clause|four clause) bsd {_LIC}|bsd (?:4|four) clause {_LIC}", _LIC),
    ("0bsd", "0bsd", rf"zero clause bsd {_LIC}|bsd zero clause {_LIC}", _LIC),
    ("bsd", "bsd", rf"(?:the )?bsd (?:style )?{_LIC}", _LIC),
    ("mpl-1.0", "mpl 1 0", rf"mozilla public {_LIC}(?: version| v)? 1 0", _LIC),
    ("mpl-1.1", "mpl 1 1", rf"mozilla public {_LIC}(?: version| v)? 1 1", _LIC),
    ("mpl-2.0", "mpl 2 0", rf"mozilla public {_LIC}(?: version| v)? 2(?: 0)?", _LIC),
    ("epl-1.0", "epl 1 0", rf"eclipse public {_LIC}(?: version| v)? 1(?: 0)?", _LIC),
    ("epl-2.0", "epl 2 0", rf"eclipse public {_LIC}(?: version| v)? 2(?: 0)?", _LIC),
    ("edl-1.0", "bsd 3 clause edl", rf"eclipse distribution {_LIC}(?: version| v)?(?: 1 0)?", _LIC),
    ("cddl-1.0", "cddl 1 0", rf"common development and distribution {_LIC}(?: version| v)?(?: 1 0)?", _LIC),
    ("cddl-1.1", "cddl 1 1", rf"common development and distribution {_LIC}(?: version| v)? 1 1", _LIC),
    ("cpl-1.0", "cpl 1 0", rf"common public {_LIC}(?: version| v)?(?: 1 0)?", _LIC),
    ("eupl-1.1", "eupl 1 1", rf"european union public {_LIC}(?: version| v)? 1 1", _LIC),
    ("eupl-1.2", "eupl 1 2", rf"european union public {_LIC}(?: version| v)? 1 2", _LIC),
    ("osl-3.0", "osl 3 0", rf"open software {_LIC}(?: version| v)?(?: 3 0)?", _LIC),
    ("afl-3.0", "afl 3 0", rf"academic free {_LIC}(?: version| v)?(?: 3 0)?", _LIC),
    ("artistic-1.0", "artistic 1 0", rf"artistic {_LIC}(?: version| v)? 1(?: 0)?", _LIC),
    ("artistic-2.0", "artistic 2 0", rf"artistic {_LIC}(?: version| v)? 2(?: 0)?", _LIC),
    ("bsl-1.0", "bsl 1 0", rf"boost software {_LIC}(?: version| v)?(?: 1 0)?", _LIC),
    ("busl-1.1", "busl 1 1", rf"business source {_LIC}(?: version| v)?(?: 1 1)?", _LIC),
    ("sspl-1.0", "sspl 1 0", rf"server side public {_LIC}(?: version| v)?(?: 1)?", _LIC),
    ("elastic-2.0", "elastic 2 0", rf"elastic {_LIC}(?: version| v)?(?: 2(?: 0)?)?", _LIC),
    ("zlib", "zlib", rf"(?:the )?zlib(?: libpng)? {_LIC}", _LIC),
    ("libpng", "libpng", rf"(?:the )?(?:libpng|png reference library) {_LIC}", _LIC),
    ("openssl", "openssl", rf"(?:the )?openssl {_LIC}", _LIC),
    ("curl", "curl", rf"(?:the )?curl {_LIC}", _LIC),
    ("python-2.0", "python 2 0", rf"(?:python software foundation|psf|python) {_LIC}(?: agreement)?(?: version| v)?(?: 2(?: 0)?)?", _LIC),
    ("php-3.01", "php 3 01", rf"(?:the )?php {_LIC}(?: version| v)?(?: 3 01)?", _LIC),
    ("ruby", "ruby", rf"(?:the )?ruby {_LIC}", _LIC),
    ("postgresql", "postgresql", rf"(?:the )?postgresql {_LIC}", _LIC),
    ("ncsa", "ncsa", rf"(?:university of illinois )?(?:ncsa open source|ncsa) {_LIC}", _LIC),
    ("ofl-1.1", "ofl 1 1", rf"(?:sil )?open font {_LIC}(?: version| v)?(?: 1 1)?", _LIC),
    ("unicode", "unicode dfs 2016", rf"unicode (?:inc )?{_LIC}(?: agreement)?", _LIC),
    ("w3c", "w3c", rf"w3c software(?: notice and)? {_LIC}", _LIC),
    ("ms-pl", "ms pl", rf"microsoft public {_LIC}", _LIC),
    ("ms-rl", "ms rl", rf"microsoft reciprocal {_LIC}", _LIC),
    ("apsl-2.0", "apsl 2 0", rf"apple public source {_LIC}(?: version| v)?(?: 2 0)?", _LIC),
    ("upl-1.0", "upl 1 0", rf"universal permissive {_LIC}(?: version| v)?(?: 1 0)?", _LIC),
    ("odbl-1.0", "odbl 1 0", rf"open (?:data commons open )?database {_LIC}(?: version| v)?(?: 1 0)?", _LIC),
    ("odc-by-1.0", "odc by 1 0", rf"open data commons attribution {_LIC}(?: version| v)?(?: 1 0)?", _LIC),
    ("pddl-1.0", "pddl 1 0", rf"public domain dedication and {_LIC}", _LIC),
    ("mulan-2.0", "mulanpsl 2 0", rf"mulan permissive software {_LIC}(?: version| v)?(?: 2)?", _LIC),
    ("wtfpl", "wtfpl", rf"do what the fuck you want to public {_LIC}", _LIC),
    ("cecill-2.1", "cecill 2 1", rf"cecill free software {_LIC}(?: agreement)?(?: version| v)?(?: 2 1)?", _LIC),
    ("openrail-m", "openrail", rf"(?:creativeml )?open ?rail(?: m| \+\+ m)? {_LIC}", _LIC),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
]

#: Texts that identify a license without its name: label, pattern, keyword.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products derived", "endorse"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", _LIC),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", _LIC),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", _LIC),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", _LIC),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", _LIC),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", _LIC),
    ("bsl-1.0", "distributed under the boost software license version 1 0", _LIC),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("public-domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain"),
    ("public-domain", "in the public domain", "public domain"),
    ("all-rights-reserved", "all rights reserved", "reserved"),
    ("copyright-notice", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", "copyright"),
    ("cc0-1.0", "cc0(?: 1 0)?", "cc0"),
    ("cc0-1.0", "creative commons zero(?: v1 0| 1 0)?(?: universal)?", "creative commons"),
    ("gpl-2.0", "gpl ?v?2(?: 0)?(?: or later| only)?", "gpl"),
    ("gpl-3.0", "gpl ?v?3(?: 0)?(?: or later| only)?", "gpl"),
    ("gpl-2.0", "gplv2|gpl2", "gpl"),
    ("gpl-3.0", "gplv3|gpl3", "gpl"),
    ("gpl", "gpl", "gpl"),
    ("lgpl-2.0", "lgpl ?v?2(?: 0)?(?: or later| only)?", "lgpl"),
    ("lgpl-2.1", "lgpl ?v?2 1(?: or later| only)?", "lgpl"),
    ("lgpl-3.0", "lgpl ?v?3(?: 0)?(?: or later| only)?", "lgpl"),
    ("lgpl", "lgpl", "lgpl"),
    ("agpl-3.0", "agpl ?v?3(?: 0)?(?: or later| only)?", "agpl"),
    ("agpl", "agpl", "agpl"),
    ("gpl", f"gnu general public {_LIC}", _LIC),
    ("lgpl", f"gnu (?:lesser|library) general public {_LIC}", _LIC),
    ("apache", f"apache {_LIC}", _LIC),
    ("cc", f"creative commons {_LIC}", _LIC),
]

#: Words (or pairs) whose presence opens a document to the rules that name them. Every match of a
#: rule's pattern has to hold the rule's keyword.
KEYWORDS = ["licen[sc]e[ds]?", "unlicense", "permission", "redistribution", "copyright", "warranty", "reserved", "public domain", "creative commons", "cc", "cc0", "gpl", "[la]?gplv?[23]", "lgpl", "agpl", "spdx", "mit no attribution", "endorse", "fuck"]
#: Forms of a keyword and the keyword they stand for.
FORMS = [("^licen[sc]e[ds]?$", "license"), ("^([la]?gpl)v?[23]$", "$1")]


class Rule(NamedTuple):
    """Among detections of the same words the highest priority stays."""

    label: str
    keyword: str
    priority: int
    confidence: float
    pattern: str


def _creative_commons() -> list[tuple[str, str, str]]:
    """Label, tag words and long name of every Creative Commons kind and version."""
    long = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s"}
    made = []
    for parts, version in product(("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1.0", "2.0", "2.5", "3.0", "4.0", "")):
        words = version.replace(".", " ")
        tail = f" {words}" if version else ""
        name = " ".join(long[p] for p in parts.split())
        made.append((f"cc-{parts.replace(' ', '-')}{'-' * bool(version)}{version}", f"cc {parts}{tail}", f"creative commons {name}{tail}"))
    return made


def rules() -> list[Rule]:
    """All rules in order: tags, notices, names, texts. About 410."""
    made = []
    for label, tag, name, key in FAMILIES:
        key = "license" if key == _LIC else key
        made += [
            Rule(label, "spdx", 90, 1.0, f"spdx {_LIC} identifier {tag}(?: only| or later)?"),
            Rule(label, key, 70, 0.9, f"(?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:{name})"),
            Rule(label, key, 50, 0.8, name),
        ]
    for label, tag, name in _creative_commons():
        made += [
            Rule(label, "spdx", 90, 1.0, f"spdx {_LIC} identifier {tag}"),
            *[Rule(label, key, 70, 0.9, f"(?:licensed|released|available) under (?:a |the )?(?:{form})") for key, form in (("cc", tag), ("creative commons", name))],
            Rule(label, "cc", 50, 0.8, tag),
            Rule(label, "creative commons", 50, 0.8, f"{name}|{name.replace('creative commons ', 'creative commons (?:license )?')}"),
        ]
    made += [Rule(label, "license" if key == _LIC else key, 40, 0.7, pattern) for label, pattern, key in TEXTS]
    return made


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def normalised(text: Column) -> Column:
    """Words of a text, A-Z lower-case, each between single spaces."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), GAPS, " ")


def _places(segments: Column, found: Column, make) -> Column:
    """make(first word, number of words) of each match, in order, from the text between and in matches."""
    start = F.struct(F.lit(-1).cast("int").alias("words"), F.array().cast("array<struct<start:int,size:int>>").alias("out"))

    def step(state: Column, i: Column) -> Column:
        at = state["words"] + _spaces(F.get(segments, i))
        inner = _spaces(F.get(found, i))
        place = F.struct(at.cast("int").alias("start"), (inner + 1).cast("int").alias("size"))
        return F.struct((at + inner).cast("int").alias("words"), F.array_append(state["out"], place).alias("out"))

    places = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["out"])
    return F.when(F.size(found) > 0, F.transform(places, make))


KIND = "array<struct<start:int,reach:int,rank:int,label:string,stop:int,confidence:double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base phrases and detections of every row.

    base_found: base phrases in order; first_word, last_word: where the first and last stand.
    detections: the rules' matches that are not within another one, by start: start, stop (word
    numbers, stop exclusive), label, confidence. Equal spans go to the higher priority, then to the
    earlier rule; detections that merely overlap all stay. Null text counts as empty; null ids,
    repeated rows and very long texts are treated like any other; other columns are ignored.
    """
    table = rules()
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("words"))
    gate = _whole("|".join(KEYWORDS))
    base_rule = _whole("|".join(BASE))
    rows = rows.select("doc_id", "words", F.col("words").rlike(gate).alias("open"))
    rows = rows.select(
        "doc_id",
        F.when(F.col("open"), F.col("words")).alias("words"),
        (_spaces(F.col("words")) - 1).alias("n_words"),
    )
    w = F.col("words")
    keys = F.transform(F.regexp_extract_all(w, F.lit(gate), F.lit(0)), lambda k: reduce(lambda c, form: F.regexp_replace(c, *form), FORMS, k))
    rows = rows.select("doc_id", "n_words", "words", F.array_distinct(keys).alias("keys"), F.regexp_extract_all(w, F.lit(base_rule), F.lit(0)).alias("base_found"), F.split(w, base_rule, -1).alias("base_between"))

    def entry(order: int, rule: Rule) -> Column:
        rank = rule.priority * 10_000 + len(table) - order
        return F.struct(F.lit(rule.keyword).alias("keyword"), F.lit(_whole(rule.pattern)).alias("pattern"), F.lit(rank).alias("rank"), F.lit(rule.label).alias("label"), F.lit(rule.confidence).alias("confidence"))

    all_rules = F.array(*[entry(i, r) for i, r in enumerate(table)])

    def detections(rule: Column) -> Column:
        found = F.regexp_extract_all(w, rule["pattern"], F.lit(0))
        between = F.split(w, rule["pattern"], F.lit(-1))
        return _places(
            between,
            found,
            lambda p: F.struct(
                p["start"].alias("start"),
                (-(p["start"] + p["size"])).alias("reach"),
                (-rule["rank"]).alias("rank"),
                rule["label"].alias("label"),
                (p["start"] + p["size"]).alias("stop"),
                rule["confidence"].alias("confidence"),
            ),
        )

    due = F.filter(all_rules, lambda r: F.array_contains(F.col("keys"), r["keyword"]) & F.rlike(w, r["pattern"]))
    everything = F.sort_array(F.flatten(F.transform(due, detections)))

    def keep(state: Column, d: Column) -> Column:
        outer = d["stop"] > state["stop"]
        return F.struct(F.greatest(state["stop"], d["stop"]).alias("stop"), F.when(outer, F.array_append(state["out"], d)).otherwise(state["out"]).alias("out"))

    kept = F.aggregate(everything, F.struct(F.lit(0).cast("int").alias("stop"), F.array().cast(KIND).alias("out")), keep, lambda s: s["out"])
    n = F.size("base_found")
    some = n > 0
    none = F.array().cast(KIND)
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("base_found", F.array().cast("array<string>")).alias("base_found"),
        F.when(some, _spaces(F.get("base_between", F.lit(0))) - 1).cast("long").alias("first_word"),
        F.when(some, F.col("n_words") - _spaces(F.get("base_between", n)) - _spaces(F.get("base_found", n - 1))).cast("long").alias("last_word"),
        F.coalesce(F.when(F.size("keys") > 0, kept), none).alias("detections"),
    )


def license_digest(found: DataFrame) -> DataFrame:
    """Labels and counts of a scan. score: the highest confidence of a detection, 0.7 for a base phrase alone."""
    names = F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair])
    base = F.array_distinct(F.transform("base_found", lambda p: names[p]))
    found = found.withColumn("base", base).withColumn("labels", F.array_union("base", F.transform("detections", lambda d: d["label"])))
    best = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_found").cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array("labels"), ",").alias("labels"),
        F.coalesce(best, F.when(F.size("base_found") > 0, 0.7), F.lit(0.0)).alias("score"),
    )
