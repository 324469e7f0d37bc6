"""Toxicity scores from confirmed toxic examples and unlabelled text.

Method: non-negative positive-unlabelled learning. With class prior p, the risk of a linear
classifier f under logistic loss is p E_toxic[l(f)] + max(0, E_any[l(-f)] - p E_toxic[l(-f)]);
where the second part falls below zero, its gradient is followed back up. Labels of
non-toxic documents serve the prior alone. Features are words and the beginnings of words
(4 to 6 characters), present or not, so that inflected forms share weight.

Nothing is sampled. Features are counted over all confirmed toxic documents first; only those in
more than ``SURPRISE`` of them can be typical. One pass over all texts then writes which of these
each document has. From that table come their counts over all documents that are not held out, the
choice of the typical ones, the different sets of them and, after the fit, the scores. Every step of
the fit sums the risk over all sets in one Spark job; the driver gets a row per feature. Sums are of
multiples of ``GRID``, so that they are the same in any order. The driver and the tasks hold the
features that may be typical: words of several toxic documents, a vocabulary and not a corpus.

Documents with crc32(doc_id as text) mod 5 = 0 are held out; a null id is not. A null or empty
text has the score of no feature. Without a confirmed toxic document every score is 0.
A document with several label rows is toxic if one of them says so. Repeated rows get a
score each; ties need no order; an empty table gives no row; other columns are not read.
"""

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames, words
from pluvigrid.llm.tokens import Memo

COUNTED = 500_000  # features that a task counts before it passes the counts on
LONGEST = 64  # bytes of a word that a memo may keep
SENT = 4_000_000  # ids of confirmed documents that are broadcast; beyond that both sides are shuffled
PLACES = 16_000_000  # features present that a task of the fit sums: its work outweighs the row per feature it passes on
BLOCK = 5_000  # different documents that a task sums at once
GRID = 2.0**-26
SURPRISE = 4  # standard deviations above its share of all documents that a feature must have
BEGINNINGS = (4, 5, 6)
FOLDS = 5
STEPS, RATE, DECAY = 100, 0.1, 1e-4
# The decay falls with the number of documents: what a feature needs against it stays a number
# of documents and does not become a share, which rare sources never reach.
DECAY_ROWS = 20_000
PRIOR_RANGE = (0.01, 0.9)
EDGES = b".,!?;:\"'()[]"


def held_out():
    remainder = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(False))


def features_of_word(word: bytes) -> list[int]:
    """Signed 64-bit numbers of the word's features."""
    plain = word.strip(EDGES).decode("utf-8", "replace")
    if not plain:
        return []
    names = [plain, *(plain[:n] + "*" for n in BEGINNINGS if len(plain) > n)]
    return [xxhash.xxh64_intdigest(name) - (1 << 63) for name in names]


def features(text: bytes) -> set[int]:
    return {f for word in set(words.split(text.lower())) for f in features_of_word(word)}


class WordMemo(Memo):
    """A memo that takes no long words, so that its number of entries bounds its bytes too."""

    def __missing__(self, word):
        return self.compute(word) if len(word) > LONGEST else super().__missing__(word)


@dataclass(frozen=True)
class Model:
    """Weight per feature and a constant."""

    weights: dict[int, float]
    constant: float

    def scorer(self):
        """Score of a text; per word the few features with a weight are kept in a memo."""
        known = WordMemo(lambda word: tuple(f for f in features_of_word(word) if f in self.weights))

        def score(text: bytes) -> float:
            found = {f for word in set(words.split(text.lower())) for f in known[word]}
            total = self.constant + sum(self.weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return score


def confirmed(labels: DataFrame) -> DataFrame:
    """Ids of confirmed toxic documents that are not held out; up to ``SENT`` go to the texts, not texts to them."""
    ids = labels.where((F.col("toxic") == 1) & ~held_out()).select("doc_id").distinct()
    return F.broadcast(ids) if ids.count() <= SENT else ids


def prior(labels: DataFrame) -> float:
    """Share of toxic documents among the labelled ones that are not held out."""
    per_doc = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = per_doc.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return float(np.clip(share or 0.0, *PRIOR_RANGE))


def candidates(toxic: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features in more than ``SURPRISE`` of the confirmed documents ``toxic``, sorted, and in how many.

    With ``e`` expected, ``(n - e) / sqrt(e + 1) > SURPRISE`` needs ``n > SURPRISE``, so no other
    feature can be chosen, whatever its count in the other documents.
    """

    def counted(counts):
        columns = [pa.array(c, pa.int64()) for c in (counts.keys(), counts.values())]
        return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic"])

    def run(batches):
        known, counts = WordMemo(lambda word: tuple(features_of_word(word))), Counter()
        for batch in batches:
            for text in frames.texts_as_bytes(batch):
                counts.update({f for word in set(words.split(text.lower())) for f in known[word]})
                if len(counts) >= COUNTED:
                    yield counted(counts)
                    counts = Counter()
        if counts:
            yield counted(counts)

    partial = frames.map_arrow(toxic.select(frames.text_column()), run, "feature long, toxic long")
    total = partial.groupBy("feature").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") > SURPRISE)
    found = total.toArrow().sort_by("feature")
    return found["feature"].to_numpy(), found["toxic"].to_numpy()


def present(docs: DataFrame, features: np.ndarray) -> DataFrame:
    """``doc_id, held_out, places``: the places in ``features`` of those that each text has, ascending.

    The only pass over all texts; what follows reads the table it writes.
    """

    def run(batches):
        place = {int(f): i for i, f in enumerate(features)}
        known = WordMemo(lambda word: tuple(place[f] for f in features_of_word(word) if f in place))
        for whole in batches:
            for start in range(0, whole.num_rows, frames.SLICE):
                batch, values, ends = whole.slice(start, frames.SLICE), array("i"), [0]
                for text in frames.texts_as_bytes(batch):
                    values.extend(sorted({i for word in set(words.split(text.lower())) for i in known[word]}))
                    ends.append(len(values))
                places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(values, np.int32)))
                columns = [batch.column("doc_id"), batch.column("held_out"), places]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "places"])

    rows = docs.select("doc_id", held_out().alias("held_out"), frames.text_column())
    schema = f"{frames.ddl(rows, 'doc_id')}, held_out boolean, places array<int>"
    return frames.stored(frames.map_arrow(rows, run, schema), "toxic-places")


def _added(parts: DataFrame, width: int, *names: str) -> np.ndarray:
    """Sums by ``place``, one row per name; added up by executors, so the driver gets ``width`` rows."""
    total = parts.groupBy("place").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((len(names), width))
    out[:, total["place"].to_numpy()] = [total[n].to_numpy() for n in names]
    return out


def typical(free: DataFrame, toxic: np.ndarray, toxic_rows: int, any_rows: int) -> np.ndarray:
    """For each candidate, whether it is typical of toxic documents, by its count in all of ``free``."""

    def run(batches):
        counts = np.zeros(len(toxic), np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("places").flatten(), minlength=len(toxic))
        place = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(counts[place])], names=["place", "other"])

    parts = frames.map_arrow(free.select("places"), run, "place int, other long")
    (other,) = _added(parts, len(toxic), "other")
    expected = toxic_rows * (other + 1) / (any_rows + 2)
    return (toxic - expected) / np.sqrt(expected + 1) > SURPRISE


def reduced(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``rows`` with ``columns`` in place of ``places``: what is left with the chosen candidates alone.

    A set is the sorted places of its features, then the place of the constant, as int32.
    """
    kept = [c for c in rows.columns if c != "places"]
    place = np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)
    constant = int(chosen.sum())

    def run(batches):
        for batch in batches:
            lists = batch.column("places")
            values = place[lists.flatten().to_numpy()]
            lengths = lists.value_lengths().to_numpy(False)
            row = np.repeat(np.arange(len(batch)), lengths)
            row, values = row[values >= 0], values[values >= 0]
            # One more place at the end of each row, for the constant.
            ends = np.cumsum(np.bincount(row, minlength=len(batch)) + 1)
            filled = np.full(ends[-1] if len(ends) else 0, constant, np.int32)
            filled[np.arange(len(values)) + row] = values
            buffers = [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int32)), pa.py_buffer(filled)]
            sets = pa.Array.from_buffers(pa.binary(), len(batch), buffers)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], names=[*kept, "columns"])

    return frames.map_arrow(rows, run, f"{frames.ddl(rows, *kept)}, columns binary")


def distinct_sets(free: DataFrame, toxic_ids: DataFrame) -> DataFrame:
    """``columns, toxic, other``: the different sets of ``free`` and how often they occur."""
    marked = free.join(toxic_ids.withColumn("toxic", F.lit(True)), "doc_id", "left")
    sets = marked.groupBy("columns").agg(F.count("toxic").alias("toxic"), F.count(F.lit(1)).alias("other"))
    sets = frames.stored(sets, "toxic-sets")
    places = sets.agg(F.sum(F.length("columns") / 4)).first()[0] or 0
    return sets.coalesce(1 + int(places // PLACES))


class Sets:
    """Rows of ``reduced``."""

    def __init__(self, columns: pa.Array, toxic: pa.Array, other: pa.Array, width: int):
        columns = columns.cast(pa.large_binary())
        ends = np.frombuffer(columns.buffers()[1], np.int64)[columns.offset : columns.offset + len(columns) + 1] // 4
        self.columns = np.frombuffer(columns.buffers()[2], np.int32)[ends[0] : ends[-1]]
        self.lengths = np.diff(ends)
        self.starts = ends[:-1] - ends[0]
        self.counts = np.array([toxic.to_numpy(False), other.to_numpy(False)], float)
        self.width = width

    def values(self, at: np.ndarray) -> np.ndarray:
        """Sum of the weights ``at`` of each set; no set is empty, for each holds the constant."""
        return np.add.reduceat(at[self.columns], self.starts) if len(self.starts) else np.empty(0)

    def sums(self, at: np.ndarray) -> np.ndarray:
        """For toxic and other documents: the loss as negatives, then its slope by feature and constant."""
        value = self.values(at)
        loss = np.round(np.logaddexp(0, value) / GRID) * GRID
        slope = np.round(1 / (1 + np.exp(-np.clip(value, -30, 30))) / GRID) * GRID
        out = np.empty((2, self.width + 2))
        for line, times in zip(out, self.counts):
            line[0] = (times * loss).sum()
            line[1:] = np.bincount(self.columns, np.repeat(times * slope, self.lengths), self.width + 1)
        return out


def summed(sets: DataFrame, width: int):
    """A function from weights to ``Sets.sums`` over all of ``sets``: one Spark job a call, whatever their number."""

    def everywhere(at):
        def run(batches):
            total = np.zeros((2, width + 2))
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    total += Sets(*(part.column(c) for c in ("columns", "toxic", "other")), width).sums(at)
            place = np.flatnonzero(total.any(axis=0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (place, *total[:, place])], names=["place", "toxic", "other"])

        parts = frames.map_arrow(sets, run, "place int, toxic double, other double")
        return _added(parts, width + 2, "toxic", "other")

    return everywhere


def fit(sums, toxic: np.ndarray, any_rows: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and constant that minimise the non-negative risk, by Adam on all documents.

    ``toxic``: confirmed documents by feature, and their number.
    """
    toxic_rows = toxic[-1]
    decay = DECAY / (1 + any_rows / DECAY_ROWS)
    at = np.zeros(len(toxic))
    at[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, STEPS + 1):
        on_toxic, on_any = sums(at)
        as_negative = on_any[0] / any_rows - prior * on_toxic[0] / toxic_rows
        if as_negative >= 0:
            slope = on_any[1:] / any_rows - prior * toxic / toxic_rows
        else:  # the risk of negatives is below zero: step back
            slope = prior * on_toxic[1:] / toxic_rows - on_any[1:] / any_rows
        slope[:-1] += decay * at[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope * slope
        at -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return at[:-1], float(at[-1])


def _trained(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame | None]:
    """The model, and ``doc_id, held_out, columns`` of all documents, or None without a chosen feature."""
    ids = docs.where(~held_out()).select("doc_id")
    toxic_ids = confirmed(labels)
    any_rows, toxic_rows = ids.count(), ids.join(toxic_ids, "doc_id", "left_semi").count()
    nothing = Model({}, -np.inf), None
    if not toxic_rows:
        return nothing
    found, counts = candidates(docs.select("doc_id", "text").join(toxic_ids, "doc_id", "left_semi"))
    if not len(found):
        return nothing
    rows = present(docs, found)
    chosen = typical(rows.where(~F.col("held_out")), counts, toxic_rows, any_rows)
    if not chosen.any():
        return nothing
    rows = reduced(rows, chosen)
    with frames.working_tables(docs.sparkSession):  # the sets end with the fit
        sums = summed(distinct_sets(rows.where(~F.col("held_out")), toxic_ids), int(chosen.sum()))
        weights, constant = fit(sums, np.append(counts[chosen], toxic_rows), any_rows, prior(labels))
    return Model({int(f): float(w) for f, w in zip(found[chosen], weights)}, constant), rows


def train(docs: DataFrame, labels: DataFrame) -> Model:
    with frames.working_tables(docs.sparkSession):
        return _trained(docs, labels)[0]


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score in column ``name``, which replaces one of that name."""
    kept = [c for c in docs.columns if c != name]

    def run(batches):
        scorer = model.scorer() if np.isfinite(model.constant) else lambda text: 0.0
        for batch in batches:
            scores = pa.array([scorer(t) for t in frames.texts_as_bytes(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, name])

    return frames.map_arrow(docs.select(*kept), run, f"{frames.ddl(docs, *kept)}, `{name}` double")


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``least`` or more."""
    scored = score(docs, train(docs, labels), "__score")
    return scored.where(F.col("__score") < least).select(*docs.columns)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document; texts are not read again after the fit."""
    model, rows = _trained(docs, labels)
    if rows is None:
        scored = docs.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"))
    else:
        at = np.array([*(w for _, w in sorted(model.weights.items())), model.constant])

        def run(batches):
            for batch in batches:
                ones = pa.array(np.ones(len(batch)))
                value = Sets(batch.column("columns"), ones, ones, len(at) - 1).values(at)
                columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

        scored = frames.map_arrow(rows, run, f"{frames.ddl(rows, 'doc_id')}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
