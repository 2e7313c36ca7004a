"""Document fingerprints from closed syncmers over words.

A k-mer of words is an anchor if the smallest hash of its inner s-mers is the first or the last
one. Whether it is depends on its own words only, so the same passage gives the same anchors in
any context, and common anchors match passages by position. A fingerprint is the sketch of a
document's anchors with the smallest hashes; a text without any closed syncmer, such as one of
under five words, has one anchor of all its words. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import cut

#: Words of a k-mer and of its inner substrings, and anchors that a fingerprint keeps.
K, S, SKETCH = 5, 2, 64
#: Anchor hashes are cut to 31 bits, eight hex digits each.
_LOW = 0x7FFFFFFF


def _id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # an alias for nothing would keep the two uses of one shuffle from being recognised
    doc_id = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    return docs.select(doc_id, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _with_pairs(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds arrays of word hashes and of hashes of neighbouring words (the inner s-mers)."""
    words = F.split(F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " "))), " ", -1)
    rows = rows.withColumn(f"{name}_w", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col(f"{name}_w")
    pairs = F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.size(w) - S), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    rows = rows.withColumn(f"{name}_p", pairs)
    return rows.withColumn(f"{name}_c", _closed(name))


def _closed(name: str) -> Column:
    """Word numbers at which the closed syncmers start."""
    p = F.col(f"{name}_p")
    inner = K - S

    def closed(i: Column) -> Column:
        return F.least(F.get(p, i), F.get(p, i + inner)) <= F.least(*[F.get(p, i + j) for j in range(1, inner)])

    return F.when(p.isNotNull(), F.filter(F.sequence(F.lit(0), F.size(p) - 1 - inner), closed))


def _chosen(name: str) -> Column:
    """Where anchors start; -1 stands for all words of a text without a closed syncmer."""
    c = F.col(f"{name}_c")
    return F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(-1)))


def _hash_at(name: str, i: Column) -> Column:
    w = F.col(f"{name}_w")
    return F.when(i < 0, F.xxhash64(w)).otherwise(F.xxhash64(*[F.get(w, i + j) for j in range(K)])).bitwiseAND(F.lit(_LOW)).cast("int")


def anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its anchors in order: place (word number) and hash. Null text counts as empty."""
    rows = _id_and_text(docs, id_col, text_col)
    rows = _with_pairs(rows, "text", "t")
    return rows.select("doc_id", F.transform(_chosen("t"), lambda i: F.struct(F.greatest(i, F.lit(0)).alias("place"), _hash_at("t", i).alias("hash"))).alias("anchors"))


def matched_places(left: Column, right: Column) -> Column:
    """Pairs of places (left, right) of the anchors that stand exactly once in both documents."""

    def single(a: Column) -> Column:
        # by hash, so equal ones are neighbours
        s = F.sort_array(F.transform(a, lambda x: F.struct(x["hash"].alias("hash"), x["place"].alias("place"))))
        return F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["hash"] != x["hash"]))

    def repeated(a: Column) -> Column:
        s = F.sort_array(F.transform(a, lambda x: x["hash"]))
        return F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))

    common = F.array_except(
        F.array_intersect(F.transform(left, lambda x: x["hash"]), F.transform(right, lambda x: x["hash"])),
        F.concat(repeated(left), repeated(right)),
    )

    def places(a: Column) -> Column:
        return F.map_from_entries(single(a))

    pairs = F.transform(common, lambda h: F.struct(F.element_at(places(left), h).alias("left"), F.element_at(places(right), h).alias("right")))
    return F.sort_array(pairs)


def _sketch(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sketch: the SKETCH smallest distinct anchor hashes, ascending."""
    rows = _with_pairs(rows, text, name)
    hashes = F.transform(_chosen(name), lambda i: _hash_at(name, i))
    sketch = F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)
    return rows.withColumn(name, sketch).drop(f"{name}_w", f"{name}_p", f"{name}_c")


def fingerprint_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common anchors: of the smallest hashes of both sketches, those in both."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex, up to 64 hashes), n_chars for every row.

    Null and blank texts have the fingerprint of one empty word. Null ids and repeated rows are rows like others; an empty table gives no rows.
    """
    rows = _id_and_text(docs, id_col, text_col)
    found = _sketch(rows, "text", "sketch")
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), fingerprint_text(F.col("sketch")).alias("fingerprint"))


def _following(ids: DataFrame) -> DataFrame:
    """doc_id and the next larger one (of the largest: the smallest) of distinct, non-null ids.

    Ids are sorted over range partitions; within one the next id is the following row, and the last
    of one partition goes on with the first of the next, of which there are as many as partitions.
    """
    placed = cut(ids.orderBy("doc_id").withColumn("part", F.spark_partition_id()))
    inside = placed.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = cut(placed.groupBy("part").agg(F.min("doc_id").alias("first_id")).coalesce(1))
    edge = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first_id").over(edge), F.first("first_id").over(edge)).alias("first_after"))
    return inside.join(after, "part").select("doc_id", F.coalesce("next_id", "first_after").alias("next_id"))


def _order(rows: DataFrame) -> DataFrame:
    """For every id: the id before it, how much of the text that one needs, and which row it takes."""
    thin = cut(
        rows.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"), F.min(F.xxhash64("text")).alias("pick"), F.count("*").alias("copies"))
    )
    following = cut(_following(thin.select("doc_id")))
    before = thin.join(following, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("before_id"), F.col("half").alias("before_half"))
    return cut(before.join(thin.select("doc_id", "pick", "copies"), "doc_id"))


def _once(given: DataFrame, order: DataFrame) -> DataFrame:
    """One row per id of what the next document gives; repeated rows give it more than once."""
    if order.where("copies > 1").isEmpty():
        return given.drop("copies")
    return given.where("copies = 1").unionByName(given.where("copies > 1").dropDuplicates(["doc_id"])).drop("copies")


def _edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    known = rows.where(F.col("doc_id").isNotNull())
    picked = F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0  # no join key, so the shuffle by id serves both joins
    given = known.join(order, "doc_id").where(picked).select(F.col("before_id").alias("doc_id"), F.expr("substring(text, 1, before_half)").alias("start"), "copies")
    paired = known.join(_once(given, order), "doc_id").unionByName(rows.where(F.col("doc_id").isNull()).withColumn("start", F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("start"), F.lit(1), half))
    return paired.select("doc_id", "text", edited.alias("edited"))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and edited text of every row.

    In the edited text the last floor(n_chars / 2) code points are replaced by the first as many of
    the next document, by ascending id; after the last comes the first. Of several rows with an id
    the one with the smallest text hash is the next document of the id before. A null id has no
    place in the order: its next document is an empty text. Texts are shuffled once whole by id and
    once in part, as far as the document before needs them.
    """
    rows = _id_and_text(docs, id_col, text_col)
    return _edited(rows, _order(rows))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every document, of its edited text (see edited_texts) and of the next document.

    Returns doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch (of a null id that of
    an empty text). Every text is sketched once.
    """
    rows = _id_and_text(docs, id_col, text_col)
    order = _order(rows)
    found = _sketch(_sketch(_edited(rows, order), "text", "sketch"), "edited", "edited_sketch")
    found = cut(
        found.select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.xxhash64("text").alias("hash"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "sketch",
            "edited_sketch",
        )
    )
    given = found.select("doc_id", "hash", "sketch").join(order, "doc_id").where("hash = pick")
    given = given.select(F.col("before_id").alias("doc_id"), F.col("sketch").alias("next_sketch"), "copies")
    empty = _sketch(docs.sparkSession.range(1).select(F.lit("").alias("text")), "text", "e").first()["e"]
    none = F.array(*[F.lit(h).cast("int") for h in empty])
    return found.drop("hash").join(_once(given, order), "doc_id", "left").withColumn("next_sketch", F.coalesce("next_sketch", none))


def fingerprint_digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("sketch")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
