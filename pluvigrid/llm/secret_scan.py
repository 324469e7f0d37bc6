"""Secrets in document histories.

Method: an incremental blob ledger. Every version of every document is content-addressed
by the SHA-256 of its text; only pairs of blob and rule version that the ledger lacks are
scanned, each blob once however many documents hold it; findings are joined back to all
documents ("paths") with that blob. The ledger is a table of
``blob binary, rule string, version int, spans array<struct<start,end>>`` (an empty array:
scanned, nothing found) that a later run extends with ``update_ledger``.

Spans are code points, end exclusive. A null text is empty and has none. Repeated rows and
ids give a row each, an empty table no row; other columns are dropped by ``findings`` and
kept by ``redact``. Copies are collapsed before the shuffle and joined back by a plain
join, which adaptive execution splits where one blob is hot.
"""

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames

LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """A pattern with the least length of one of its groups; matches below it are dropped."""

    kind: str
    version: int
    pattern: re.Pattern
    group: int
    least: int
    hint: re.Pattern  # without a match of it there is none of ``pattern``

    def spans(self, text: str) -> list[tuple[int, int]]:
        if not self.hint.search(text):
            return []
        return [m.span() for m in self.pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# Kinds in the order in which they are listed, their patterns and least lengths.
RULES = (
    Rule(
        "assign", 1,
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        2, 6, re.compile("[:=]"),
    ),
    Rule("access", 1, re.compile("AKIA[A-Z0-9]+"), 0, 20, re.compile("AKIA")),
    Rule("hex", 1, re.compile("[0-9a-f]+"), 0, 24, re.compile("[0-9a-f]{24}")),
    # Added to the base kinds.
    Rule(
        "pem", 1,
        re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*"), 0, 0, re.compile("PRIVATE KEY"),
    ),
)
BASE = ("assign", "access", "hex")


def blob():
    """Content address of a text."""
    return F.unhex(F.sha2(F.coalesce(frames.text_column(), F.lit("")), 256))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for ``blob, text, missing``: the rules named in ``missing`` on each text."""
    by_kind = {rule.kind: rule for rule in rules}

    def run(batch):
        rows = [
            (key, rule.kind, rule.version, [{"start": s, "end": e} for s, e in rule.spans(text)])
            for key, text, missing in zip(
                batch.column("blob").to_pylist(), frames.texts_as_str(batch), batch.column("missing").to_pylist()
            )
            for rule in (by_kind[kind] for kind in missing)
        ]
        kinds = (pa.binary(), pa.string(), pa.int32(), ARROW_SPANS)
        columns = zip(*rows) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["blob", "rule", "version", "spans"]
        )

    return frames.map_batches(blobs, run, LEDGER)


def unseen(docs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """One row per blob with rules that the ledger lacks: ``blob, text, missing``."""
    every = F.array(*(F.lit(rule.kind) for rule in rules))
    blobs = docs.select(blob().alias("blob"), F.coalesce(frames.text_column(), F.lit("")).alias("text"))
    if ledger is None:
        return blobs.dropDuplicates(["blob"]).withColumn("missing", every)
    current = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    done = (
        ledger.where(F.array_contains(current, F.struct("rule", "version")))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("done"))
    )
    lacking = F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))
    return (
        blobs.join(done, "blob", "left")
        .select("blob", "text", lacking.alias("missing"))
        .where(F.size("missing") > 0)
        .dropDuplicates(["blob"])
    )


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The ledger with the missing pairs scanned and added; written to the shared folder."""
    added = frames.stored(scan(unseen(docs, ledger, rules), rules), "ledger")
    return added if ledger is None else ledger.unionByName(added)


def spans_of_blobs(ledger: DataFrame, rules=RULES) -> DataFrame:
    """``blob, spans``: per blob with findings, its spans of the current rules by start, then kind."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    found = ledger.where((F.size("spans") > 0) & (F.col("version") == version[F.col("rule")])).dropDuplicates(
        ["blob", "rule"]
    )
    marked = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), order[F.col("rule")].alias("order"), s["end"].alias("end"), F.col("rule").alias("kind")
        ),
    )
    # At most one row per rule and blob is collected.
    return found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(marked))).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``; null where nothing is found."""
    paths = docs.select("doc_id", blob().alias("blob"))
    return paths.join(spans_of_blobs(ledger, rules), "blob", "left").drop("blob")


def report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    rows = findings(docs, update_ledger(docs, ledger))
    spans = F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType))

    def shown(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return rows.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(spans).alias("spans"),
    )


def mask(text: str, spans) -> str:
    """``text`` with each run of overlapping spans replaced."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with secrets masked; other rows and columns as they are."""
    found = spans_of_blobs(update_ledger(docs, ledger)).select(
        F.col("blob").alias("__blob"), F.col("spans").alias("__spans")
    )
    rows = docs.withColumn("__blob", blob()).join(found, "__blob", "left").select(*docs.columns, "__spans")

    names = docs.columns

    def run(batch):
        texts = [
            text if spans is None else mask(text, spans)
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist())
        ]
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return frames.map_batches(rows, run, frames.ddl(docs))
