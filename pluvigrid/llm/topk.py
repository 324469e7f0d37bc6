"""Exact search for the vectors of highest inner product.

Method: multi-resolution segment statistics. A vector is cut into segments; from the mean m
and the deviation s of a segment of length L in query and candidate, its part of the inner
product is at most L (m m' + s s') by Cauchy-Schwarz. Sums of these bounds, first over a few
long segments and then over many short ones, rule out candidates that cannot enter the
query's best; survivors get the exact product. (Bounds from below on distances are, for inner
products, bounds from above.)

Components are floor(1024 x), scores exact integers (beyond 64 bits, the nearest of 64). The stated queries meet all candidates
in blocks: a task gets one block of queries and one run of candidates, holds the best so far
per query, and passes on only those; so neither side is broadcast and the data that moves
grows with the results. Ties go to the smaller id.

Vectors that are null or hold null or non-finite components, and rows with a null id, take
no part. Vectors of different lengths are not compared. Repeated rows with one id count as
one row, that of the least vector. An empty table gives no row; other columns are dropped.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvigrid.llm import frames

QUERY_STEP = 100
BEST = 10
SCALE = 1024
QUERY_BLOCK = 256  # queries in a task
RUN = 16_384  # candidates in a task
CHUNK = 2_048  # candidates bounded at once
RESOLUTIONS = (4, 16)  # segments, coarse to fine
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part: whole numbers as doubles."""
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    sound = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))
    )
    return (
        vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & sound)
        .select(F.col(vec_id).alias("vec_id"), whole.alias("vector"))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def statistics(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Per row and segment sqrt(L) m, and sqrt(L) s: products of such rows are bounds."""
    edges = np.linspace(0, matrix.shape[1], min(segments, matrix.shape[1]) + 1).astype(int)
    parts = []
    for start, end in zip(edges, edges[1:]):
        part = matrix[:, start:end]
        root = np.sqrt(end - start)
        parts += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(parts, axis=1) if parts else np.zeros((len(matrix), 0))


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(queries.shape[1], 1)
    if most < EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in candidates]
    return np.array([[sum(int(a) * b for a, b in zip(q, c)) for c in whole] for q in queries], dtype=object)


class Best:
    """The best so far of a block of queries, by score and then by smaller id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, best: int):
        self.ids, self.matrix, self.best = ids, matrix, best
        self.levels = [statistics(matrix, r) for r in RESOLUTIONS]
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted
        self.least = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """One chunk of candidates."""
        alive = self.ids[:, None] != ids[None, :]
        for segments, own in zip(RESOLUTIONS, self.levels):
            other = statistics(matrix, segments)
            # Room for rounding, by the size of the terms, since they may be negative or cancel out;
            # a tie with the least score can still win by its id.
            room = 1e-9 * (np.abs(own) @ np.abs(other).T) + 1
            alive &= own @ other.T + room >= self.least[:, None]
        rows = np.flatnonzero(alive.any(axis=1))
        columns = np.flatnonzero(alive.any(axis=0))
        if not len(rows) or not len(columns):
            return
        scores = products(self.matrix[rows], matrix[columns])
        for row, line in zip(rows, scores):
            keep = np.flatnonzero(alive[row, columns] & (line >= self.least[row]))
            if len(keep) > 8 * self.best:  # all that reach the best-th highest score, ties included
                cut = np.partition(line[keep].astype(float), -self.best)[-self.best]
                keep = keep[line[keep] >= cut]
            more = [(-int(line[j]), int(ids[columns[j]])) for j in keep]
            self.found[row] = sorted(self.found[row] + more)[: self.best]
            if len(self.found[row]) == self.best:
                self.least[row] = -self.found[row][-1][0]

    def rows(self) -> pd.DataFrame:
        flat = [(int(q), v, max(-LONG, min(LONG, -s))) for q, found in zip(self.ids, self.found) for s, v in found]
        return pd.DataFrame(flat, columns=["query_id", "vec_id", "score"])


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def search(queries: DataFrame, candidates: DataFrame, best: int = BEST) -> DataFrame:
    """``query_id, rank, vec_id, score`` from frames as ``scaled`` makes them."""
    spark = candidates.sparkSession
    dims = F.size("vector").alias("dims")
    candidates = frames.stored(candidates.select("vec_id", "vector", dims), "vectors")
    queries = frames.stored(queries.select("vec_id", "vector", dims), "queries")
    # Blocks and runs by hash, of about the stated size; counts are two numbers.
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    runs = -(-candidates.count() // RUN) or 1
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    left = queries.select("*", spread).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)).cast("array<bigint>")))
    right = candidates.select(
        "*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(runs)).alias("run"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"),
    )
    cell = ["block", "run", "dims"]

    def meet(asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(seen):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        asked, seen = asked.sort_values("vec_id"), seen.sort_values("vec_id")
        state = Best(asked["vec_id"].to_numpy(), _matrix(asked["vector"]), best)
        ids = seen["vec_id"].to_numpy()
        for start in range(0, len(ids), CHUNK):
            state.see(ids[start : start + CHUNK], _matrix(seen["vector"].iloc[start : start + CHUNK]))
        return state.rows()

    frames.importable(spark)
    partial = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame) -> DataFrame:
    """The best of every vector whose id is divisible by ``QUERY_STEP``."""
    every = scaled(vectors)
    return search(every.where(F.col("vec_id") % QUERY_STEP == 0), every)
