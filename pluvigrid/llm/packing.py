"""Packing of token ids into sequences of bounded length.

Method: Karmarkar-Karp differencing for many windows. Each piece starts as a partial
partition with one filled window; the two partial partitions of largest imbalance are
merged, fullest windows with emptiest, until one is left. If its fullest window exceeds
the capacity, the number of windows rises by one and the batch is differenced again.

Whole windows of long documents are cut off first. The rests are cut into pieces of at
most ``piece`` ids, and batches of about ``windows`` windows are differenced inside the
input partitions, so nothing is shuffled and memory holds one batch. A batch is filled
to ``fill`` of its windows, the last piece being cut to fit: near-equal windows then
nearly always stay within the capacity.

A null or empty text is a document of the end id alone. Repeated rows and ids are
documents of their own; an empty table gives no piece; other columns are dropped.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames, tokens
from pluvigrid.llm.bpe import VOCABULARY

CAPACITY = 2048
END_ID = 1
WINDOWS, PIECE, FILL = 64, 512, 0.995


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Numbers of the pieces in each window, by multiway differencing."""
    empty = windows - 1
    heap = [(-n, i, [0] * empty + [n], [[] for _ in range(empty)] + [[i]]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    for made in range(len(lengths), 2 * len(lengths) - 1):
        _, _, sums, groups = heapq.heappop(heap)
        _, _, other_sums, other_groups = heapq.heappop(heap)
        sums = [a + b for a, b in zip(sums, reversed(other_sums))]
        groups = [a + b for a, b in zip(groups, reversed(other_groups))]
        order = sorted(range(windows), key=sums.__getitem__)
        sums, groups = [sums[w] for w in order], [groups[w] for w in order]
        heapq.heappush(heap, (sums[0] - sums[-1], made, sums, groups))
    return heap[0][3]


def near_equal_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the least possible number on, that differencing fills within capacity."""
    windows = -(-sum(lengths) // capacity)
    while True:
        groups = difference(lengths, windows)
        if max(sum(lengths[i] for i in group) for group in groups) <= capacity:
            return groups
        windows += 1


class Packer:
    """Pieces of one input partition, batch by batch."""

    def __init__(self, first_sequence: int, capacity: int):
        self.sequence, self.capacity = first_sequence, capacity
        self.room = int(WINDOWS * capacity * FILL)
        self.waiting: list[tuple] = []
        self.filled = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while total - start >= self.capacity:
            self._place([(doc_id, start, ids[start : start + self.capacity].tobytes(), total)])
            start += self.capacity
        while start < total:
            length = min(total - start, PIECE, self.capacity, self.room - self.filled)
            self.waiting.append((doc_id, start, ids[start : start + length].tobytes(), total))
            self.filled += length
            start += length
            if self.filled == self.room:
                self.close()

    def close(self) -> None:
        if self.waiting:
            for group in near_equal_windows([len(p[2]) // 4 for p in self.waiting], self.capacity):
                if group:
                    self._place([self.waiting[i] for i in group])
        self.waiting, self.filled = [], 0

    def _place(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            self.out.append((doc_id, start, length, ids, total, self.sequence, offset))
            offset += length
        self.sequence += 1

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * len(schema)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` is binary, little-endian unsigned 32-bit integers. Sequence ids are unique and
    ascend inside an input partition, whose number is in their upper bits.
    """
    source = docs.select("doc_id", frames.text_column())
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        encode = tokens.library_ids(path or tokens.vocabulary_path(VOCABULARY))
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        end = np.array([end_id], "<u4")
        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema(
                    [("doc_id", batch.schema.field("doc_id").type), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
                )
            for start in range(0, batch.num_rows, frames.SLICE):
                part = batch.slice(start, frames.SLICE)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), frames.texts_as_str(part)):
                    packer.add(doc_id, np.concatenate([encode(text).astype("<u4"), end]))
                if packer.out:
                    yield packer.take(arrow)
        packer.close()
        if packer.out:
            yield packer.take(arrow)

    return frames.map_arrow(source, run, schema)


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``pack`` with a checksum in place of the ids."""
    return pack(docs, path=path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
