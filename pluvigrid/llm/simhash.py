"""Near-duplicate documents by SimHash, and their groups.

Method: anchor-point covering. Anchors are the words of a covering code: the product of two
binary Golay codes on bits 0-22 and 23-45 of the fingerprint, each of which comes within
``RADIUS`` bits of every word, by exactly one code word. A fingerprint is at home at its one
anchor within the radius, and is replicated to every anchor within radius plus threshold: as
many bits as a code word lies beyond the radius, over both parts, must fit the threshold. Two
fingerprints within the threshold meet at the home of either: what separates them can put the other
only so much farther from that anchor. Per anchor, those at home are compared with all
replicas by a join whose condition counts the differing bits, so only links leave it.

Equal fingerprints are one node from the start, so copies cost nothing more. A node has at
most 2,080 others within two bits (64 at one bit, 2,016 at two), which bounds the links however
large a group is. Hot anchors are split by adaptive execution (a plain equi-join, merged and
spilling), hot fingerprints and components by salted lookups.

A text with fewer words than a shingle is one shingle; without words (null, empty or blank) its
fingerprint is zero and is linked like any other. Repeated rows and ids are rows of their own
with the component of their fingerprint. A component is named by the smallest id of its rows
(null if none has one). A very long text is read in runs of shingles. An empty table gives no
row; other columns are dropped.
"""

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames, words
from pluvigrid.llm.components import components
from pluvigrid.operators.lookup import lookup

SHINGLE, DISTANCE, SEED = 3, 2, 42
RUN = 1 << 16  # shingles of a text that are hashed at once
LENGTH, CHECKS, RADIUS = 23, 11, 3
POLYNOMIAL = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the Golay code
PARTS = 2
MASK = np.uint64((1 << LENGTH) - 1)


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is one if it is in over half of the hashes of the text's shingles."""
    split = words.split(text.lower())
    if not split:
        return 0
    joined = b" ".join(split)
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    starts = np.cumsum(lengths + 1) - lengths - 1
    width = min(size, len(split))
    count = len(split) - width + 1
    firsts, lasts = starts[:count].tolist(), (starts + lengths)[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, count, RUN):
        shingles = map(joined.__getitem__, map(slice, firsts[at : at + RUN], lasts[at : at + RUN]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def _remainder(word: int) -> int:
    """What a word leaves when divided by the code's polynomial: zero for code words."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= POLYNOMIAL << (bit - CHECKS)
    return word


@lru_cache(maxsize=4)
def code(distance: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Remainders of single bits, and patterns by how far they reach beyond the radius.

    ``patterns[e]`` has a row per remainder: all words of that remainder with ``RADIUS + e``
    bits (for ``e = 0`` the only one with at most ``RADIUS``), filled up with -1. A word with
    one of them taken away is a code word at that distance.
    """
    bits = np.array([_remainder(1 << i) for i in range(LENGTH)], np.int64)
    patterns = []
    for excess in range(distance + 1):
        weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
        found = []
        for weight in weights:
            chosen = [*combinations(range(LENGTH), weight)]
            at = np.array(chosen, np.int64).reshape(len(chosen), weight)
            found.append(np.stack([np.bitwise_xor.reduce(bits[at], axis=1), (1 << at).sum(axis=1)]))
        left, pattern = np.concatenate(found, axis=1)
        order = np.argsort(left, kind="stable")
        left, pattern = left[order], pattern[order]
        counts = np.bincount(left, minlength=1 << CHECKS)
        table = np.full((1 << CHECKS, counts.max()), -1, np.int64)
        table[left, np.arange(len(left)) - np.repeat(np.cumsum(counts) - counts, counts)] = pattern
        patterns.append(table)
    return bits, patterns


def anchors(points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place in points, anchor)`` of all anchors within radius plus ``distance`` bits of each."""
    bits, patterns = code(distance)
    near = []  # per part and excess: code words, one row per point, and which of them exist
    for part in range(PARTS):
        word = (points >> np.uint64(part * LENGTH) & MASK).astype(np.int64)
        left = np.zeros(len(points), np.int64)
        for i in range(LENGTH):
            left ^= (word >> i & 1) * bits[i]
        taken = [table[left] for table in patterns]
        near.append([((word[:, None] ^ p) << part * LENGTH, p >= 0) for p in taken])
    places, found = [], []
    for one in range(distance + 1):
        for other in range(distance + 1 - one):
            (a, a_there), (b, b_there) = near[0][one], near[1][other]
            there = a_there[:, :, None] & b_there[:, None, :]
            places.append(np.nonzero(there)[0])
            found.append((a[:, :, None] | b[:, None, :])[there])
    return np.concatenate(places), np.concatenate(found)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` (its 64 bits as long) per row of ``docs``."""
    source = docs.select("doc_id", frames.text_column())

    def run(batch):
        found = np.array([fingerprint(t, size) for t in frames.texts_as_bytes(batch)], np.uint64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"]
        )

    return frames.map_batches(source, run, f"{frames.ddl(source, 'doc_id')}, fingerprint long")


def replicas(points: DataFrame, distance: int) -> DataFrame:
    """``anchor, point``: each fingerprint at every anchor within radius plus ``distance``."""

    def run(batch):
        point = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        place, anchor = anchors(point.view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(point[place])], names=["anchor", "point"])

    return frames.map_batches(points.select("fingerprint"), run, "anchor long, point long", rows=4_000)


def links(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``u, v``: pairs of different fingerprints of ``points`` with at most ``distance`` differing bits, once each."""
    # Those at home are the replicas within the radius alone: one per fingerprint.
    home = replicas(points, 0).withColumnRenamed("point", "u")
    away = replicas(points, distance).withColumnRenamed("point", "v")
    differing = F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
    # Merged at every size: adaptive execution splits a hot anchor, and its rows may spill.
    return home.hint("merge").join(away, "anchor").where((F.col("u") < F.col("v")) & (differing <= distance)).select("u", "v")


def groups(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``; the fingerprint as 16 hex digits."""
    rows = frames.stored(fingerprints(docs, size), "fingerprints")
    points = frames.stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    found = components(links(points, distance)).withColumnRenamed("node", "fingerprint")
    labelled = points.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = lookup(labelled, names, "component").select("fingerprint", "component_id")
    return lookup(rows, named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )

