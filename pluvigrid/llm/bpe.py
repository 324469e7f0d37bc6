"""Byte-pair encoding and decoding of whole texts.

Method: a segment tree over the ranks of adjacent pairs (``tokens.MergeTree``). The root
is the leftmost pair of the lowest rank; each merge updates two or three leaves in
logarithmic time. Words seen before are looked up in a memo of bounded size.

A null or empty text has no ids, and no ids decode to the empty text. A very long word
costs n log n. Rows are independent: repeated rows and ids, empty tables and other columns
need no care. A column named like a result is replaced.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames, tokens

VOCABULARY = "byte_bpe_50k.json"


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Replaces ``text`` by ``ids``: binary, one little-endian unsigned 32-bit integer each.

    Special tokens inside a text get their own id, none is added.
    """
    kept = [c for c in df.columns if c not in (text, ids)]
    source = df.select(*kept, frames.text_column(text))
    schema = ", ".join([*(frames.ddl(source, c) for c in kept), f"`{ids}` binary"])

    def run(batch):
        tree = tokens.merge_tree(path or tokens.vocabulary_path(VOCABULARY))
        encoded = [tree.encode(t) for t in frames.texts_as_str(batch, text)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(encoded, pa.binary())], names=[*kept, ids]
        )

    return frames.map_batches(source, run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ``text``, decoded from ``ids``; special tokens show as their text."""
    kept = [c for c in df.columns if c != text]
    source = df.select(*kept)
    schema = ", ".join([*(frames.ddl(source, c) for c in kept), f"`{text}` string"])

    def run(batch):
        tree = tokens.merge_tree(path or tokens.vocabulary_path(VOCABULARY))
        decoded = [tree.decode(i or b"") for i in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(decoded, pa.string())], names=[*kept, text]
        )

    return frames.map_batches(source, run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids and digests of the ids and of the text decoded from them.

    Encodes and decodes in one pass, so that a task has one vocabulary in memory.
    """
    source = docs.select("doc_id", frames.text_column())
    schema = f"{frames.ddl(source, 'doc_id')}, ids binary, text string"

    def run(batch):
        tree = tokens.merge_tree(path or tokens.vocabulary_path(VOCABULARY))
        encoded = [tree.encode(t) for t in frames.texts_as_str(batch)]
        decoded = [tree.decode(ids) for ids in encoded]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(encoded, pa.binary()), pa.array(decoded, pa.string())],
            names=["doc_id", "ids", "text"],
        )

    return frames.map_batches(source, run, schema).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
