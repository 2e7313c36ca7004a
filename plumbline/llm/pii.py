"""Surrogates for personal data.

Entities are found by one ordered pattern and told apart by checks (address ranges, Luhn digits,
titles before names). Each distinct value gets a keyed surrogate of the same shape: digits for
digits, letters of the same case and script, valid check digits, names of the same gender. Equal
values get equal surrogates everywhere; values whose surrogates collide, with each other or with a
value that occurs, draw again until all are distinct. All of it is DataFrame expressions and joins
of the values, not of texts; only documents with a redrawn value are joined.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import cut

KEY = b"plumbline surrogate key"

#: Titles before personal names, by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Srta", "Madame", "Mademoiselle", "Mme", "Mlle")
MALE = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur")
NEUTRAL = ("Dr", "Prof", "Mx")
_TITLE = "(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.?"
_NAME = r"\p{Lu}\p{Ll}(?:[\p{L}-]|['’](?!s(?!\p{L}))){0,30}"
#: Names behind a title that are looked back over, so a titled name has up to one more.
_NAMES_BEFORE = 5
_BEFORE = r"\p{Lu}\p{Ll}[\p{L}'’-]{0,30} "
_BEHIND_TITLE = "|".join(rf"(?<=(?<!\p{{L}}){_TITLE} {n * _BEFORE})" for n in range(_NAMES_BEFORE + 1))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Phones with a country code (groups of three or four digits, or of two), area code
#: in brackets, three groups with one separator, national ones with a leading zero.
_PHONE = "(?:" + "|".join(
    [
        r"(?<![\p{N}+])\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\p{N}])",
        r"(?<![\p{N}+])\+[1-9][0-9]{0,2}[ .-]?(?:\(0\) ?)?[0-9]{1,3}(?:[ .-][0-9]{2}){3,5}(?![\p{N}]|[ .-]?[0-9])",
        r"(?<![\p{N}+])\+[1-9][0-9]{0,2}[ .-]?(?:\(0\) ?)?[0-9]{2,4}[ ./-][0-9]{4,8}(?![\p{N}])",
        r"(?<![\p{N}])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\p{N}])",
        *[rf"(?<![\p{{L}}\p{{N}}+.-])[2-9][0-9]{{2}}{sep}[0-9]{{3}}{sep}[0-9]{{4}}(?![\p{{L}}\p{{N}}-])" for sep in (" ", r"\.", "-")],
        r"(?<![\p{L}\p{N}+.-])0[1-9](?:[ .-][0-9]{2}){4}(?![\p{L}\p{N}-])",
        r"(?<![\p{L}\p{N}+.-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![\p{L}\p{N}-])",
    ]
) + ")"
_SSN = r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"
#: Patterns of the entity kinds, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[0-9a-f]{0,31}[0-9])[0-9a-f]{32,128}|(?=[0-9A-F]{0,31}[0-9])[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
    "phone": _PHONE,
    "ssn": _SSN,
    "ip": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\p{{N}}|\.\p{{N}})",
    "card": rf"(?<![\p{{L}}\p{{N}}-])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{_PHONE}|{_SSN})[0-9]++(?![\p{{L}}]|\.[0-9]))*+(?![\p{{L}}\p{{N}}])",
    "name": rf"(?=\p{{Lu}}\p{{Ll}})(?<= )(?:{_BEHIND_TITLE}){_NAME}",
}
ANY = "|".join(PATTERNS.values())
#: Pieces of text one of which is in every text with an entity that has neither a digit nor an @.
SIGNS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "Mr", "Ms", "Miss", "Frau", "Señor", "Sr", "Mad", "Mme", "Mlle", "Herr", "Monsieur", "Dr", "Prof", "Mx")


def hinted(text: Column) -> Column:
    """A cheap test that every text with an entity passes; false for null."""
    signs = [F.contains(text, F.lit(s)) for s in SIGNS]
    return F.coalesce(reduce(or_, signs, text.rlike("[@0-9]")), F.lit(False))


#: Draws after which a name's surrogate gets one more letter, again and again.
WIDEN_AFTER = 3
#: Between any two characters.
_EACH = r"(?s)(?<=.)(?=.)"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Letters that stand for letters of each script; alphabets in order.
SCRIPTS = (
    (r"[а-яё]", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    (r"[А-ЯЁ]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"),
    (r"[ά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[Ά-Ϋ]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"[一-鿿]", "天地人山川日月星雲風雨雪花木林石田水火金"),
    (r"\p{Ll}", "àáâäçèéêëìíîïñòóôöùúûü"),
    (r"\p{Lu}", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"),
    (r"\p{L}", _LOWER),
)
#: Last letters of surrogate given names, by gender and script.
ENDINGS = {"given_f": ("a", "а", "α"), "given_m": ("n", "н", "ν")}


def keyed_hash(kind: Column, value: Column, attempt: Column, key: bytes) -> Column:
    """HMAC-SHA256 (RFC 2104) of kind, value and attempt, as hex."""
    block = key.ljust(64, b"\0")
    if len(block) > 64:
        raise ValueError("a key has at most 64 bytes")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\u0000", kind, value, attempt.cast("string")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _number(stream: Column, i: Column) -> Column:
    """The i-th byte of a stream of hex digits, which begins again when used up."""
    at = (F.pmod(i, F.lit(31)) * 2 + 1).cast("int")
    return F.conv(F.substring(stream, at, F.lit(3)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _same_shape(text: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Every digit becomes a digit, every letter one of its case and script; the rest stays."""
    low, up = ("abcdef", "ABCDEF") if hexadecimal else (_LOWER, _UPPER)

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        out = F.when(c.rlike("^[0-9]$"), _pick(_DIGITS, n)).when(c.rlike("^[a-z]$"), _pick(low, n)).when(c.rlike("^[A-Z]$"), _pick(up, n))
        for pattern, alphabet in SCRIPTS:
            out = out.when(c.rlike(f"^{pattern}$"), _pick(alphabet, n))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, _EACH), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn checksum of a text of digits, last digit undoubled."""
    reverse = F.split(F.reverse(digits), _EACH)
    value = F.transform(reverse, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + 1))
    value = F.transform(F.arrays_zip(value.alias("v"), reverse.alias("c")), lambda z: F.when(z["c"] == "0", 0).otherwise(z["v"]))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b)


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _with_luhn(shaped: Column) -> Column:
    """A card number in its format with its last digit set so that the Luhn sum is right."""
    head = F.regexp_replace(shaped, "[0-9]$", "0")
    check = F.pmod(10 - F.pmod(_luhn_sum(_only_digits(head)), F.lit(10)), F.lit(10))
    return F.concat(F.regexp_replace(shaped, "[0-9]$", ""), check.cast("string"))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's letters and digits, moved by four, by 97."""
    plain = F.replace(text, F.lit(" "))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        n = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(a * F.when(n < 10, 10).otherwise(100) + n, F.lit(97))

    return F.aggregate(F.split(moved, _EACH), F.lit(0), step)


def _with_check97(value: Column, shaped: Column) -> Column:
    country = F.substring(value, 1, 2)
    rest = F.substring(shaped, F.lit(5), F.length(shaped))
    check = 98 - _mod97(F.concat(country, F.lit("00"), rest))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


def _octets(stream: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(F.conv(F.substring(stream, 1 + 4 * i, 4), 16, 10).cast("int"), F.lit(254)) + 1).cast("string") for i in range(4)])


def _name_like(value: Column, stream: Column, kind: Column, attempt: Column) -> Column:
    """A capitalised name in the script of the value; given names end like their gender's.

    Every WIDEN_AFTER attempts it gets one more letter, so short names never run out of surrogates.
    """
    shaped = _same_shape(value, stream)
    lead, tail = F.substring(shaped, F.lit(1), F.length(shaped) - 1), F.substring(shaped, F.length(shaped), F.lit(1))
    script = F.when(value.rlike(r"^[Ѐ-ӿ]"), 1).when(value.rlike(r"^[Ͱ-Ͽ]"), 2).otherwise(0)
    for gender, letters in ENDINGS.items():
        last = F.get(F.array(*map(F.lit, letters)), script)
        tail = F.when(kind == gender, last).otherwise(tail)

    def letter(k: Column) -> Column:
        n = _number(stream, F.length(value) + k)
        return F.when(script == 1, _pick(SCRIPTS[0][1], n)).when(script == 2, _pick(SCRIPTS[2][1], n)).otherwise(_pick(_LOWER, n))

    extra = F.floor(attempt / WIDEN_AFTER).cast("int")
    more = F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), letter), "")).otherwise("")
    return F.concat(lead, more, tail)


def surrogate(kind: Column, value: Column, h: Column, attempt: Column) -> Column:
    """Replacement of a value, of its kind and shape, drawn from its keyed hash.

    h has to be a column or a field: an expression would run again for every character.
    """
    shaped = _same_shape(value, h)
    at = F.instr(value, "@")
    local = _same_shape(F.substring(value, F.lit(1), at - 1), h)
    site = F.concat(F.lower(F.substring(h, 41, 8)), F.lit(".example."), F.get(F.array(*map(F.lit, ("com", "net", "org"))), F.pmod(_number(h, F.lit(30)), F.lit(3))))
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])|^", 0)
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), site))
        .when(kind == "secret", _same_shape(value, h, hexadecimal=True))
        .when(kind == "iban", _with_check97(value, shaped))
        .when(kind == "phone", F.concat(code, F.substring(shaped, F.length(code) + 1, F.length(shaped))))
        .when(kind == "ip", _octets(h))
        .when(kind == "card", _with_luhn(shaped))
        .when(kind.isin("given_f", "given_m", "given", "surname"), _name_like(value, h, kind, attempt))
        .otherwise(shaped)
    )


def _kind(found: Column, before: Column, after: Column) -> Column:
    """Kind of a match by what stands in and around it; null if it is none after all."""
    def titled(titles: tuple[str, ...]) -> Column:
        return before.rlike(r"(?<!\p{L})(?:" + "|".join(titles) + r")\.? $")

    given = after == " "  # another name follows at once
    return (
        F.when(found.contains("@"), "email")
        .when(found.rlike(f"^(?:{PATTERNS['secret']})$"), "secret")
        .when(found.rlike(f"^(?:{PATTERNS['iban']})$"), F.when(_mod97(found) == 1, "iban"))
        .when(found.rlike(f"^{_PHONE}$"), "phone")
        .when(found.rlike(f"^(?:{PATTERNS['ssn']})$"), "ssn")
        .when(found.rlike(f"^(?:{PATTERNS['ip']})$"), "ip")
        .when(found.rlike("^[0-9]"), F.lit(None))  # cards are told by their groups
        .when(titled(FEMALE) & given, "given_f")
        .when(titled(MALE) & given, "given_m")
        .when(titled(NEUTRAL) & given, "given")
        .otherwise("surname")
    )


def _item(value: Column, kind: Column) -> Column:
    return F.struct(value.alias("value"), kind.cast("string").alias("kind"))


_NO_ITEMS = "array<struct<value:string,kind:string>>"


def _cards(run: Column) -> Column:
    """Items of a run of digit groups: the cards in it and the groups between.

    From left to right, the longest row of whole groups with 13 to 19 digits and a right Luhn sum
    is a card. A separator belongs to the group before it.
    """
    groups = F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0))

    def step(state: Column, i: Column) -> Column:
        def window(k: Column) -> Column:
            return F.array_join(F.slice(state["groups"], i + 1, k), "")

        def valid(k: Column) -> Column:
            digits = _only_digits(window(k))
            return F.length(digits).between(13, 19) & (F.pmod(_luhn_sum(digits), F.lit(10)) == 0)

        most = F.least(F.lit(19), F.size(state["groups"]) - i)
        best = F.coalesce(F.get(F.filter(F.reverse(F.sequence(F.lit(1), most)), valid), F.lit(0)), F.lit(0))
        text = window(best)
        bare = F.regexp_replace(text, "[ -]$", "")
        card = F.array(_item(bare, F.lit("card")), _item(F.substring(text, F.length(bare) + 1, F.length(text)), F.lit(None)))
        plain = F.array(_item(F.get(state["groups"], i), F.lit(None)))
        moved = F.struct(
            state["groups"].alias("groups"),
            F.when(best > 0, i + best).otherwise(i + 1).cast("int").alias("next"),
            F.concat(state["out"], F.when(best > 0, card).otherwise(plain)).alias("out"),
        )
        return F.when(i < state["next"], state).otherwise(moved)

    start = F.struct(groups.alias("groups"), F.lit(0).alias("next"), F.array().cast(_NO_ITEMS).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda s: s["out"])


#: Kinds that are names, and a word that may be one.
_NAME_KINDS = ("given_f", "given_m", "given", "surname")
_NAME_WORD = rf"(?<![\p{{L}}\p{{N}}]){_NAME}(?![\p{{L}}\p{{N}}])"


def _parsed(texts: DataFrame) -> DataFrame:
    """Adds `found`: the whole text in items of value and kind, in order; kind is null between
    entities, and `found` where a text has no entity for sure.

    A document's titled names are also found where they stand without a title.
    """
    due, text = F.col("due"), F.col("text")
    rows = texts.withColumn("due", hinted(text))
    rows = rows.withColumn("between", F.when(due, F.split(text, ANY, -1))).withColumn("raw", F.when(due, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    b = F.col("between")
    rows = rows.withColumn("told", F.transform("raw", lambda v, i: _item(v, _kind(v, F.get(b, i), F.get(b, i + 1)))))

    def items(e: Column) -> Column:
        run = e["kind"].isNull() & e["value"].rlike("^[0-9][0-9 -]*$")
        return F.when(run, _cards(e["value"])).otherwise(F.array(e))

    told = F.col("told")
    parts = F.flatten(F.transform(b, lambda x, i: F.concat(F.array(_item(x, F.lit(None))), F.when(i < F.size(told), items(F.get(told, i))).otherwise(F.array().cast(_NO_ITEMS)))))
    rows = rows.withColumn("parts", parts)
    named = F.filter("told", lambda e: e["kind"].isin(*_NAME_KINDS))
    kinds = F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda e: e["value"])), lambda v: F.struct(v.alias("name"), F.get(F.filter(F.col("named"), lambda e: e["value"] == v), F.lit(0))["kind"].alias("kind"))))
    rows = rows.withColumn("named", named).withColumn("kinds", kinds)

    def mentions(e: Column) -> Column:
        words = F.regexp_extract_all(e["value"], F.lit(_NAME_WORD), F.lit(0))
        gaps = F.split(e["value"], _NAME_WORD, -1)
        cut_up = F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), words.alias("word")), lambda z: F.array(_item(z["gap"], F.lit(None)), _item(F.coalesce(z["word"], F.lit("")), F.try_element_at(F.col("kinds"), z["word"])))))
        return F.when(e["kind"].isNull(), cut_up).otherwise(F.array(e))

    found = F.when(F.size("named") > 0, F.flatten(F.transform("parts", mentions))).otherwise(F.col("parts"))
    return rows.withColumn("found", found).drop("raw", "due", "between", "told", "parts", "named", "kinds")


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind and value of every entity, in any order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _parsed(rows).select("doc_id", F.explode("found").alias("e")).where("e.kind is not null").select("doc_id", "e.kind", "e.value")


def redrawn_values(values: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, value and attempt (1 or more) of the distinct values whose first surrogates collide.

    A surrogate is drawn again while another value of its kind has it too (one of them keeps it) or
    while it is itself a value that occurs. Names widen with the attempt; the other kinds have at
    least a hundred million surrogates of any shape.
    """
    drawn = values.select("kind", "value", F.lit(0).alias("attempt"))
    while True:
        drawn = drawn.withColumn("h", keyed_hash(F.col("kind"), F.col("value"), F.col("attempt"), key))
        drawn = cut(drawn.withColumn("made", surrogate(F.col("kind"), F.col("value"), F.col("h"), F.col("attempt"))).drop("h"))
        keeps = drawn.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value")).alias("first")).where("n > 1").select("kind", "made", F.col("first.value").alias("keeper"))
        clash = drawn.join(keeps, ["kind", "made"]).where("value <> keeper").select("kind", "value")
        occurs = drawn.join(values.select("kind", F.col("value").alias("made")), ["kind", "made"], "left_semi").select("kind", "value")
        again = cut(clash.unionByName(occurs).distinct())
        if again.isEmpty():
            return drawn.where("attempt > 0").select("kind", "value", "attempt")
        moved = drawn.join(again.withColumn("again", F.lit(1)), ["kind", "value"], "left")
        drawn = moved.select("kind", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))


def replace_entities(docs: DataFrame, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every entity of text_col replaced by its surrogate; columns and order are kept.

    Null and empty texts stay, texts of any length are searched whole, texts without an entity are
    not changed at all. Null ids and repeated rows are rows like others, as nothing depends on ids
    but the join of redrawn values, which takes nulls as equal. An empty table gives no rows.
    """
    columns = docs.columns
    values = cut(entities(docs, id_col, text_col).groupBy("kind", "value").agg(F.count("*").alias("n")).drop("n"))
    redrawn = cut(redrawn_values(values, key))
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("text"))
    no_attempts = F.create_map().cast("map<string,int>")
    if redrawn.isEmpty():
        parsed = _parsed(rows).withColumn("attempts", no_attempts)
    else:
        uses = _parsed(rows).select("own_id", F.xxhash64("text").alias("hash"), F.explode("found").alias("e")).where("e.kind is not null").select("own_id", "hash", "e.kind", "e.value")
        per_doc = uses.join(redrawn, ["kind", "value"]).distinct().groupBy("own_id", "hash").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "kind", "value"), "attempt"))).alias("attempts")
        )
        per_doc = per_doc.select(F.col("own_id").alias("id"), F.col("hash").alias("text_hash"), "attempts")
        same = F.col("own_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash"))
        joined = rows.where(hinted(F.col("text"))).join(per_doc, same, "left").drop("id", "text_hash")
        plain = rows.where(~hinted(F.col("text"))).withColumn("attempts", no_attempts)
        parsed = _parsed(joined.withColumn("attempts", F.coalesce("attempts", no_attempts)).unionByName(plain))

    def with_hash(e: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(F.col("attempts"), F.concat_ws(" ", e["kind"], e["value"])), F.lit(0))
        h = F.when(e["kind"].isNotNull(), keyed_hash(e["kind"], e["value"], attempt, key))
        return F.struct(e["value"].alias("value"), e["kind"].alias("kind"), h.alias("h"), attempt.alias("attempt"))

    def new(e: Column) -> Column:
        return F.when(e["kind"].isNull(), e["value"]).otherwise(surrogate(e["kind"], e["value"], e["h"], e["attempt"]))

    parsed = parsed.withColumn("swap", F.transform(F.transform("found", with_hash), new))
    made = parsed.select("row", F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join("swap", "")).alias("text"))
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns])
