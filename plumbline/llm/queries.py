"""Registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.align import alignment_digest
from plumbline.llm.chat import CHUNK_BYTES, format_conversations, read_turns, unescape
from plumbline.llm.langid import identify, learn
from plumbline.llm.lexicon import encode_documents
from plumbline.llm.licenses import license_digest, scan_licenses
from plumbline.llm.neighbours import nearest
from plumbline.llm.packing import pack_documents
from plumbline.llm.pii import replace_entities
from plumbline.llm.shared import map_arrow, table
from plumbline.llm.simhash import simhash_classes
from plumbline.llm.syncmers import compare_with_edit, fingerprint_digest
from plumbline.llm.toxicity import toxicity_digest
from plumbline.llm.trie import trie_digest
from plumbline.llm.warc import archive_pages

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
OWN_CONVERSATION = -7
OWN_TEXT = "</s>[INST] ok [/INST]"


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of packed documents with their ids and places."""
    return pack_documents(docs, public_tokenizers.path(BYTE_BPE))


def packed_digest(docs: DataFrame) -> DataFrame:
    """Pieces of packed documents with a checksum of the ids that packing returns in their place."""
    return packed(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_digest(table(spark, folder, "documents"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_classes(table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return identify(docs, learn(docs))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = encode_documents(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return replace_entities(table(spark, folder, "documents")).select("doc_id", "text")


def op8_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_digest(compare_with_edit(table(spark, folder, "documents")))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, folder, "documents")))


def conversation_digest(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted chunks, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, said, loss, turns, loss_chars, chars = None, None, None, 0, 0, 0

        def row() -> pa.RecordBatch:
            values = [[open_id], [turns], [said.hexdigest()], [loss_chars], [loss.hexdigest()], [chars]]
            kinds = [id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            id_kind = batch.column(0).type
            out = []
            for chunk in batch.to_pylist():
                if chunk["chunk"] == 0:
                    if said is not None:
                        out.append(row())
                    open_id, said, loss, turns, loss_chars, chars = chunk["conv_id"], hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                text = chunk["text"]
                for role, words in read_turns(text):
                    said.update(f"{role}\n{words}\n".encode())
                    turns += 1
                data = text.encode()
                for span in chunk["loss"]:
                    part = unescape(data[span["start"] : span["start"] + span["length"]].decode())
                    loss.update(part.encode())
                    loss_chars += len(part)
                chars += len(text)
            yield from out
        if said is not None:
            yield row()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = chunks.schema["conv_id"].dataType.simpleString()
    return map_arrow(chunks, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(OWN_CONVERSATION, i, role, OWN_TEXT) for i, role in enumerate(("user", "assistant"))], rows.schema)
    return conversation_digest(format_conversations(rows.unionByName(own), CHUNK_BYTES))


def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie_digest(table(spark, folder, "conversations"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return alignment_digest(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_neighbours": op4_neighbours,
    "op5_langid": op5_langid,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_syncmers": op8_syncmers,
    "op9_licenses": op9_licenses,
    "op10_chat": op10_chat,
    "op11_trie": op11_trie,
    "op12_toxicity": op12_toxicity,
    "op13_alignment": op13_alignment,
}
