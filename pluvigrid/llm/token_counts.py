"""Token counts of whole texts, without ids.

Method: byte-pair merging by a heap over a linked list (``tokens.MergeCount``); a word has
as many tokens as symbols at first, less its merges. Counts of words seen before are
looked up in a memo of bounded size, and a text's count is the sum over its words.

A null or empty text has 0 bytes and 0 tokens. Repeated rows and ids give a row each, an
empty table no row; other columns are dropped.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames, tokens

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``."""
    source = docs.select("doc_id", frames.text_column())
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def run(batch):
        counter = tokens.merge_count(path or tokens.vocabulary_path(VOCABULARY))
        texts = frames.texts_as_bytes(batch)
        counts = [counter.count(t.decode()) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    return frames.map_batches(source, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
