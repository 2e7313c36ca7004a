"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits both lie within one bit of some common variant.
So every distinct fingerprint emits itself and its 64 one-bit variants, variants are shuffled, and
fingerprints that meet are linked. A variant is met by 65 different fingerprints at most, whatever
the data, so no bucket needs a cap; copies have been merged into one fingerprint before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from plumbline.llm.shared import connected_components, cut, map_arrow

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Shingle hashes unpacked to bits at once.
BLOCK = 1 << 16


def fingerprint_of(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half the shingle hashes."""
    found = text.lower().split()  # of bytes: lowers A-Z only, splits at ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(found) - words + 1].tolist()
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    packed = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(packed), BLOCK):
        block = packed[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(packed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and its fingerprint as a signed long, for every row. Null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint_of(t or b"", words) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(rows, run, StructType([rows.schema["doc_id"], StructField("fp", LongType())]))


def ball_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints `fp` within `radius` (2) bits.

    Of the fingerprints that meet at a variant each is linked with the smallest, which connects
    the same ones as all their pairs would.
    """
    if radius != 2:
        raise ValueError("variants of one flipped bit serve a radius of two")
    masks = [0] + [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    spread = nodes.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant")
    )
    met = spread.withColumn("low", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> low")
    links = met.select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    return links.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, links of its fingerprint.

    component_id is the smallest id reachable over links of fingerprints. Null and wordless texts
    have fingerprint zero and are linked like any other. A null id is never a component_id: its row
    takes the component of its fingerprint, or null if no document with an id is reachable.
    Repeated rows stay repeated. Other columns of the input are ignored, whatever their names.
    An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    links = cut(ball_links(nodes))
    components = connected_components(links)
    named = nodes.join(components.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    lowest = cut(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    by_print = cut(named.join(lowest, "component").select("fp", "component_id"))
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest id, once.

    Rows are told apart by id and text, so an id with several texts may stay with one and go with
    another; among equal ids of a component the smaller hash of the text stays. Rows that agree in
    both stay once. Rows with a null id can't be named, so they stay. Columns and their order are kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    named = docs.where(F.col(id_col).isNotNull())
    classes = simhash_classes(named.select(key.alias("key"), text.alias("text")), "key", "text", SHINGLE_WORDS)
    kept = cut(classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times")))
    columns = [F.col("doc_id.id").alias("_kept_id"), F.col("doc_id.hash").alias("_kept_hash")]
    once, often = kept.where("times = 1").select(*columns), kept.where("times > 1").select(*columns)
    own = (F.col(id_col) == F.col("_kept_id")) & (F.xxhash64(text) == F.col("_kept_hash"))
    copies = named.join(often, own, "left_semi").withColumn("_hash", F.xxhash64(text)).dropDuplicates([id_col, "_hash"])
    return (
        named.join(once, own, "left_semi")
        .unionByName(copies.drop("_hash"))
        .unionByName(docs.where(F.col(id_col).isNull()))
        .select(*docs.columns)
    )
