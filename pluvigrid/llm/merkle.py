"""A Merkle manifest of a table: leaf digests, a tree per source, one root over all sources.

Method: van Emde Boas layout. Trees are cut into blocks, aligned subtrees of ``LEVELS`` levels
of hashing over at most ``FAN ** LEVELS`` leaves. A block stores its digests in van Emde Boas
order: the upper half of its rows of nodes first, then each subtree below, every part laid out
the same way. ``addresses`` says by arithmetic alone where a node lies; construction and the
retrieval of siblings both go through it. The roots of blocks are the leaves of the next
round of blocks, until one is left; the roots of sources are the leaves of a tree of their own.

Leaves are ranked by a range partitioning and one count per partition and source, so that a source of any
size spreads over tasks. Proofs come down the rounds: each block hands every leaf the siblings
inside the block and those above it. No path of a document leaves the task that folds it.

A leaf is the digest of its fields, each ``-`` if null, else its bytes in UTF-8, ``:`` and its
value. Rows of a source ascend by id, null first, then by leaf, so equal rows have neighbouring
places and repeated ids are leaves of their own. A null source is a source, before all others.
An empty or very long text is a value like any other. A lone leaf is its source's root, a lone
source's root is the root; their proofs hold no sibling. An empty table gives no row and no
root. Extra columns are dropped.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvigrid.llm import frames

FAN, LEVELS = 16, 3
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tree_size(rows: int) -> int:
    """Nodes of a full tree with so many rows of nodes."""
    return (FAN**rows - 1) // (FAN - 1)


def addresses(rows: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` below the root of a tree with ``rows`` rows."""
    if rows == 1:
        return np.zeros_like(index)
    top = rows // 2
    if depth < top:
        return addresses(top, depth, index)
    width = FAN ** (depth - top)
    inside = addresses(rows - top, depth - top, index % width)
    return tree_size(top) + index // width * tree_size(rows - top) + inside


def height(leaves: int) -> int:
    """Levels of hashing over so many leaves."""
    levels = 0
    while FAN**levels < leaves:
        levels += 1
    return levels


def digest_of(hex_digests: str) -> str:
    return hashlib.sha256(hex_digests.encode()).hexdigest()


class Block:
    """An aligned subtree: ``leaves`` digests and all above them, up to one root ``levels`` higher."""

    def __init__(self, nodes: np.ndarray, leaves: int, levels: int):
        self.nodes, self.leaves, self.levels = nodes, leaves, levels

    @classmethod
    def built(cls, leaves: bytes, levels: int) -> "Block":
        count = len(leaves) // DIGEST
        last = int(addresses(levels + 1, levels, np.array([count - 1]))[0])
        block = cls(np.zeros((last + 1, DIGEST), np.uint8), count, levels)
        block._set(levels, leaves)
        for depth in range(levels, 0, -1):
            block._set(depth - 1, b"".join(bytes.fromhex(digest_of(run)) for run in block.runs(depth)))
        return block

    def width(self, depth: int) -> int:
        return -(-self.leaves // FAN ** (self.levels - depth))

    def _places(self, depth: int) -> np.ndarray:
        return addresses(self.levels + 1, depth, np.arange(self.width(depth)))

    def _set(self, depth: int, digests: bytes) -> None:
        self.nodes[self._places(depth)] = np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)

    def runs(self, depth: int) -> list[str]:
        """The digests at ``depth`` as hex text, one entry for the children of each node above."""
        row = self.nodes[self._places(depth)].tobytes().hex()
        step = 2 * DIGEST * FAN
        return [row[i : i + step] for i in range(0, len(row), step)]

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def paths(self, depth: int | None = None) -> list[list[tuple[str, str]]]:
        """For each node at ``depth`` (the leaves): per level, what its siblings are before and after it."""
        depth = self.levels if depth is None else depth
        if depth == 0:
            return [[]]
        above, size = self.paths(depth - 1), 2 * DIGEST
        return [
            [(run[:at], run[at + size :]), *above[i]]
            for i, run in enumerate(self.runs(depth))
            for at in range(0, len(run), size)
        ]


def fold(leaf: str, path) -> str:
    """The root that follows from a leaf and its siblings."""
    for before, after in path:
        leaf = digest_of(before + leaf + after)
    return leaf


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: tuple[str, ...] = FIELDS, **replaced: Column) -> Column:
    """Hex digest of the row's fields; a field may be ``replaced`` by another expression."""
    return F.sha2(F.concat(*(_field(replaced.get(c, F.col(c))) for c in fields)), 256)


def tree_key(column: str = "source") -> Column:
    """A text that is never null and sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` (``tree``, ``leaf``, ...) with ``rank`` in its tree and ``n``, the tree's leaves."""
    placed = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # Stored: places must not change when a lost executor's work is repeated.
    placed = frames.stored(placed.withColumn("at", F.monotonically_increasing_id()), "leaves")
    placed = placed.withColumn("run", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "run").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    # A tree has one row per partition here.
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree",
        "run",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(tree).alias("n"),
    )
    found = placed.join(starts, ["tree", "run"])
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "run", "shift")


def _grouped(rows: DataFrame, levels: int) -> DataFrame:
    """Leaves by block, in order; a block is of bounded size."""
    carried = [c for c in rows.columns if c not in ("tree", "n", "rank", "leaf")]
    block = F.shiftright("rank", 4 * levels).alias("block")
    leaves = F.array_sort(F.collect_list(F.struct("rank", "leaf", *carried))).alias("leaves")
    return rows.groupBy("tree", "n", block).agg(leaves)


def _build(rows: DataFrame, done: int, levels: int) -> DataFrame:
    """Blocks of leaves that lie ``done`` levels above the first ones, with digests and root."""
    grouped = _grouped(rows, levels)

    def run(batch):
        nodes, roots = [], []
        for n, leaves in zip(batch.column("n").to_pylist(), batch.column("leaves")):
            digests = b"".join(leaves.values.field("leaf").to_pylist())
            block = Block.built(digests, min(levels, height(n) - done))
            nodes.append(block.nodes.tobytes())
            roots.append(block.root())
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())],
            names=[*batch.schema.names, "nodes", "root"],
        )

    return frames.stored(
        frames.map_batches(grouped, run, f"{frames.ddl(grouped)}, nodes binary, root binary", rows=16), "blocks"
    )


@dataclass(frozen=True)
class Forest:
    """Blocks of all trees: ``rounds[0]`` holds the leaves, each later one the roots of the one before."""

    rounds: list[DataFrame]
    levels: int

    def finished(self, number: int) -> DataFrame:
        """The blocks of a round that are the last of their tree."""
        return self.rounds[number].where(F.col("n") <= FAN ** (self.levels * (number + 1)))

    def unfinished(self, number: int) -> DataFrame:
        return self.rounds[number].where(F.col("n") > FAN ** (self.levels * (number + 1)))

    def roots(self) -> DataFrame:
        """``tree, leaf``: the root of each tree."""
        parts = [self.finished(i).where("block = 0").select("tree", F.col("root").alias("leaf")) for i in range(len(self.rounds))]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole


def grow(rows: DataFrame, levels: int = LEVELS) -> Forest:
    """Blocks of so many levels over ranked leaves, round after round."""
    rounds = [_build(rows, 0, levels)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > FAN ** (levels * len(rounds)):
        below = Forest(rounds, levels).unfinished(len(rounds) - 1)
        roots = below.select("tree", "n", F.col("block").alias("rank"), F.col("root").alias("leaf"))
        rounds.append(_build(roots, levels * len(rounds), levels))
    return Forest(rounds, levels)


def _block_of(row, levels: int, done: int = 0) -> Block:
    nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
    return Block(nodes, len(row["leaves"]), min(levels, height(row["n"]) - done))


def _as_path(pairs) -> list[dict]:
    return [{"before": before, "after": after} for before, after in pairs]


def _handed_down(blocks: DataFrame, levels: int, done: int) -> DataFrame:
    """What each leaf of a block gets: ``tree, block`` (its rank), ``subroot, root, path``."""
    schema = f"tree string, block long, subroot string, root string, path {PATH}"

    def run(batch):
        out = []
        for row in batch.to_pylist():
            for leaf, path in zip(row["leaves"], _block_of(row, levels, done).paths()):
                out.append((row["tree"], leaf["rank"], row["subroot"], row["root_of_all"], _as_path(path) + row["path"]))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "block", "subroot", "root", "path"]
        )

    return frames.map_batches(blocks, run, schema, rows=16)


def descended(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The blocks of leaves with ``subroot``, ``root_of_all`` and ``path``: the siblings above the block.

    ``above`` gives ``tree, root, path`` of each tree in the tree of trees; without it a
    tree's root is the root of all.
    """
    hexed = F.lower(F.hex("root"))
    known = None
    for number in range(len(forest.rounds) - 1, -1, -1):
        ends = forest.finished(number).select("tree", "block", hexed.alias("subroot"))
        if above is None:
            ends = ends.select("*", F.col("subroot").alias("root"), F.array().cast(PATH).alias("path"))
        else:
            ends = ends.join(above.select("tree", "root", "path"), "tree")
        known = ends if known is None else known.unionByName(ends)
        known = known.withColumnRenamed("root", "root_of_all")
        blocks = forest.rounds[number].join(known, ["tree", "block"])
        if number:
            known = _handed_down(blocks, forest.levels, forest.levels * number)
    return blocks


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", levels: int = LEVELS
) -> tuple[Forest, DataFrame]:
    """The trees of all sources, and per source ``tree, subroot, root, path``: its place in the tree of sources.

    Leaves carry ``doc_id`` and, for rows that :func:`tampered` picks, the digest of the changed row.
    """
    changed = F.when(tampered(), F.unhex(leaf_digest(fields, text=F.translate("text", UPPER, LOWER))))
    digests = docs.select(tree_key(tree).alias("tree"), "doc_id", F.unhex(leaf_digest(fields)).alias("leaf"), changed.alias("tampered"))
    # Texts are read and hashed once; the range partitioning reads its input twice.
    sources = grow(ranked(frames.stored(digests, "digests"), "doc_id", "leaf"), levels)
    listed = frames.stored(sources.roots(), "subroots")
    over = grow(ranked(listed.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "leaf"), "key"), levels)
    return sources, _places_of_sources(over)


def _places_of_sources(over: Forest) -> DataFrame:
    """``tree, root, path`` of each source."""
    schema, levels = f"tree string, root string, path {PATH}", over.levels

    def run(batch):
        out = []
        for row in batch.to_pylist():
            for leaf, path in zip(row["leaves"], _block_of(row, levels).paths()):
                out.append({"tree": leaf["key"], "root": row["root_of_all"], "path": _as_path(path) + row["path"]})
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.RecordBatch.from_pylist(out, pa.schema([("tree", pa.string()), ("root", pa.string()), ("path", kind)]))

    return frames.stored(frames.map_batches(descended(over), run, schema, rows=16), "places")


def tampered() -> Column:
    """The rows whose change the report shows."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, path``: each row's siblings on the way to the root, for ``fold``."""
    sources, above = manifest(docs, levels=levels)
    blocks = descended(sources, above)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, path {PATH}"

    def run(batch):
        out = []
        for row in batch.to_pylist():
            for leaf, path in zip(row["leaves"], _block_of(row, levels).paths()):
                out.append((leaf["doc_id"], leaf["leaf"].hex(), row["subroot"], row["root_of_all"], _as_path(path) + row["path"]))
        leaf_ids = pa.array([o[0] for o in out], _id_type(batch))
        path_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [leaf_ids, *(pa.array([o[i] for o in out], pa.string()) for i in (1, 2, 3)), pa.array([o[4] for o in out], path_type)],
            names=["doc_id", "leaf", "subroot", "root", "path"],
        )

    return frames.map_batches(blocks, run, schema, rows=1)


def _id_type(batch: pa.RecordBatch) -> pa.DataType:
    return batch.schema.field("leaves").type.value_type.field("doc_id").type


def report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per row ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``folded_root`` is recomputed from the leaf, or from that of the changed row, and the
    siblings of the original one.
    """
    sources, above = manifest(docs, levels=levels)
    blocks = descended(sources, above)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = f"doc_id {kind}, " + ", ".join(f"{name} string" for name in names[1:])

    def run(batch):
        out = []
        for row in batch.to_pylist():
            block = _block_of(row, levels)
            above_block = [(p["before"], p["after"]) for p in row["path"]]
            shared = tail = None
            for i, (leaf, path) in enumerate(zip(row["leaves"], block.paths())):
                if i % FAN == 0:  # above the run, its leaves have the same siblings
                    shared = [*path[1:], *above_block]
                    tail = "".join(before + after for before, after in shared)
                own = path[:1]
                # Without levels in the block, all siblings are above it.
                proof = "".join(before + after for before, after in own) + tail
                digest = leaf["leaf"].hex()
                start = digest if leaf["tampered"] is None else leaf["tampered"].hex()
                folded = fold(start, [*own, *shared])
                out.append((leaf["doc_id"], digest, row["subroot"], row["root_of_all"], digest_of(proof), folded))
        columns = list(zip(*out)) or [()] * len(names)
        kinds = [_id_type(batch), *[pa.string()] * (len(names) - 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    reported = frames.map_batches(blocks, run, schema, rows=1)
    return reported.withColumn("verified", F.col("folded_root") == F.col("root"))
