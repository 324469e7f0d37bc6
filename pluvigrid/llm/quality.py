"""Quality rules with thresholds that follow the data.

Method: one mergeable quantile sketch per language, source and measure. A sketch counts
documents in bins (whole per mille, or hundredths of a character), so sketches of any parts
of a corpus merge by adding counts, exactly and in any order. Bins have no top: shares end
at 1000 (symbols and words) by themselves, and mean word lengths above 100 characters get
a bin each where they occur. Thresholds are quartiles of the sketch and their
distance, in place of fixed cut-offs; documents are then filtered by a join on language
and source.

A null language or source is a group of its own. A null or empty text has no words and
fails the base rule. Repeated rows and ids give a row each and count each; ties fall into
one bin; an empty table gives no row; other columns are dropped.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvigrid.llm import frames, words

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
CONTINUED = bytes(range(0x80, 0xC0))  # bytes that start no character in UTF-8
WINDOW = 8
# Documents further than this many quartile distances, plus the margin, from a quartile fail.
REACH = 3
MARGINS = {"word_length": 100, "symbols": 20, "dup_lines": 400, "repeats": 250}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts_of(text: bytes) -> tuple[int, ...]:
    """The base counts of a text, in the order of ``COUNTS``."""
    split = words.split(text)
    count = len(split)
    chars = len(text.translate(None, SPACE + CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if count > WINDOW:
        _, which, times = np.unique(words.windows(words.numbers(split), WINDOW), return_inverse=True, return_counts=True)
        edge = np.zeros(count + 1, np.int64)
        twice = np.flatnonzero(times[which] > 1)
        edge[twice] += 1
        edge[twice + WINDOW] -= 1
        repeated = int((edge.cumsum() > 0).sum())
    return count, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measures(docs: DataFrame) -> DataFrame:
    """Base counts and ``base_failed`` per document, with its language and source."""
    source = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), frames.text_column())
    schema = f"{frames.ddl(source, 'doc_id', 'lang', 'source')}, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batch):
        rows = [counts_of(t) for t in frames.texts_as_bytes(batch)]
        kept = ["doc_id", "lang", "source"]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*kept, *COUNTS]
        )

    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return frames.map_batches(source, run, schema).withColumn("base_failed", failed)


def _bins() -> dict:
    """Each measure as a whole number from 0."""

    def share(part, whole, scale):
        return F.expr(f"{part} * {scale} div greatest({whole}, 1)")

    return {
        "word_length": share("word_chars", "n_words", 100),
        "symbols": share("n_symbols", "word_chars", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bin, docs`` over the documents that pass the base rule."""
    bins = F.explode(
        F.array(*(F.struct(F.lit(m).alias("measure"), b.alias("bin")) for m, b in _bins().items()))
    ).alias("m")
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", bins)
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), F.col("m.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("docs"))
    )


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The sketches of both corpora together."""
    return first.unionByName(second).groupBy("lang", "source", "measure", "bin").agg(F.sum("docs").alias("docs"))


def thresholds(sketched: DataFrame) -> DataFrame:
    """Per language and source, least and most of each measure."""
    group = Window.partitionBy("lang", "source", "measure")
    cumulative = sketched.withColumn(
        "upto", F.sum("docs").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("all", F.sum("docs").over(group))
    quartiles = cumulative.groupBy("lang", "source", "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin"))).alias("q3"),
    )
    reach = REACH * (F.col("q3") - F.col("q1"))
    limits = []
    for name, margin in MARGINS.items():
        here = F.col("measure") == name
        limits.append(F.max(F.when(here, F.col("q3") + reach + margin)).alias(f"most_{name}"))
        limits.append(F.max(F.when(here, F.col("q1") - reach - margin)).alias(f"least_{name}"))
    return quartiles.groupBy("lang", "source").agg(*limits)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: past the base rule and within the limits of its group."""
    limits = limits.withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    within = ~F.col("base_failed")
    for name, value in _bins().items():
        within &= F.coalesce(value.between(F.col(f"least_{name}"), F.col(f"most_{name}")), F.lit(True))
    return measured.join(limits, same, "left").withColumn("kept", within).select(*measured.columns, "kept")


def rules(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` per document."""
    measured = frames.stored(measures(docs), "measures")
    judged = judge(measured, thresholds(sketches(measured)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
