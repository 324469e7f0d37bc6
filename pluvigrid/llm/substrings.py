"""Removal of word runs that occur earlier in the corpus.

A window is ``WINDOW`` consecutive words of one document; every word of a window whose words
also start earlier (smaller id, or same document and earlier start) is removed. Windows are
judged on the input.

Method: suffix automata of reference shards. The reference is the corpus itself, so
automata of all of it would grow with the data and cannot be broadcast; instead each shard
holds what can match: a window belongs to the least of the hashes of its ``GRAM``-word runs,
equal windows so to the same, and the segments (runs of windows of one owner) of all
documents are routed to their owner's shard. There, in order of id and position, a segment is
streamed through the automaton of the segments before it; where the matching statistic
reaches the window, the window is a copy, and maximal runs of such windows are removed. The
automaton's alphabet are fingerprints of ``SYMBOL`` consecutive words, so that a window is
``WINDOW - SYMBOL + 1`` symbols.

Skew: equal segments of a batch of documents are resolved before the shuffle, so a passage
costs a shard one row per batch however often it occurs. An owner with more than a fixed
share of all rows (there are few such, found by a pass of their own) is split: each of its
windows is routed by itself.

A null or empty text has no words; documents shorter than a window lose nothing. A null id
counts as larger than any. Rows with one id and text are one document for order, each with
a row in the result; rows with one id and different texts are ordered by position. Extra
columns are dropped by ``removals`` and kept by ``deduplicate``.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames, words

WINDOW = 20
GRAM = 10
SYMBOL = 19
HOT_SHARE = 1 / 4096  # owners with a larger share of the rows are split; at most 1 / share are
BATCH = 4_000  # documents whose equal segments are resolved before the shuffle
SEGMENT = "key long, doc long, row long, start int, windows int, symbols binary, repeats boolean"
SPAN = "doc long, row long, start int, windows int"


class Automaton:
    """Suffix automaton of several strings, with the first end of each state's substrings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, edges, link, length, first) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def extend(self, last: int, symbol: int, end) -> int:
        """State of the string of ``last`` followed by ``symbol``, which first ends at ``end``."""
        following, link, length = self.next, self.link, self.length
        known = following[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, symbol, known)
        made = self._state({}, 0, length[last] + 1, end)
        at = last
        while at != -1 and symbol not in following[at]:
            following[at][symbol] = made
            at = link[at]
        if at != -1:
            known = following[at][symbol]
            link[made] = known if length[known] == length[at] + 1 else self._split(at, symbol, known)
        return made

    def _split(self, at: int, symbol: int, known: int) -> int:
        clone = self._state(dict(self.next[known]), self.link[known], self.length[at] + 1, self.first[known])
        self.link[known] = clone
        while at != -1 and self.next[at].get(symbol) == known:
            self.next[at][symbol] = clone
            at = self.link[at]
        return clone

    def stream(self, symbols: list[int], doc: int, start: int, least: int) -> list[bool]:
        """Adds a string; for each of its runs of ``least`` symbols, whether it ended earlier before."""
        following, link, length = self.next, self.link, self.length
        state = matched = last = 0
        out = []
        for i, symbol in enumerate(symbols):
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                matched += 1
            end = (doc, start + i)
            if i >= least - 1:
                copy = False
                if matched >= least:
                    at = state
                    while length[link[at]] >= least:
                        at = link[at]
                    copy = self.first[at] < end
                out.append(copy)
            last = self.extend(last, symbol, end)
            # A split may have moved the matched string to the clone, which is shorter.
            while length[link[state]] >= matched > 0:
                state = link[state]
        return out


class Shard:
    """The segments of one owner, in order."""

    def __init__(self, least: int):
        self.least = least
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.automaton: Automaton | None = None

    def add(self, doc: int, start: int, symbols: bytes, repeats: bool) -> list[tuple[int, int]]:
        """Maximal runs of copied windows of the segment: first window and number."""
        first = self.seen.setdefault(symbols, (doc, start))
        if first != (doc, start):
            return [(start, len(symbols) // 4 - self.least + 1)]
        if self.automaton is None:
            if len(self.seen) == 1 and not repeats:
                return []
            self.automaton = Automaton()
            for content, (d, s) in self.seen.items():
                if content != symbols:
                    self.automaton.stream(_symbols(content), d, s, self.least)
        copies = self.automaton.stream(_symbols(symbols), doc, start, self.least)
        return _runs(copies, start)


def _symbols(content: bytes) -> list[int]:
    return np.frombuffer(content, "<u4").tolist()


def _runs(flags: list[bool], start: int) -> list[tuple[int, int]]:
    runs, since = [], None
    for i, flag in enumerate([*flags, False]):
        if flag and since is None:
            since = i
        elif not flag and since is not None:
            runs.append((start + since, i - since))
            since = None
    return runs


def _order():
    """The place of a document in the order: its id, or after all ids."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _row():
    """Tells rows of one id and different texts apart; short where there is an id."""
    hashed = F.xxhash64(F.coalesce(frames.text_column(), F.lit("")))
    return F.when(F.col("doc_id").isNull(), hashed).otherwise(hashed.bitwiseAND(0xFFFFFFFF))


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc, row, text``: the order of documents, and what tells rows of one id apart."""
    text = F.coalesce(frames.text_column(), F.lit(""))
    return docs.select(_order().alias("doc"), _row().alias("row"), text.alias("text"))


def _segments(batch: pa.RecordBatch, hot: np.ndarray, window: int, gram: int, symbol: int) -> dict[str, np.ndarray]:
    """Segments of a batch, sorted by owner, content, document and start."""
    packed = words.Batch(frames.texts_as_bytes(batch))
    doc_ids = batch.column("doc").to_numpy(zero_copy_only=False)
    whole = packed.whole_windows(window)
    if not whole.any():
        return {}
    hashes = words.windows(packed.hashes, window)
    owner = words.sliding_min(words.windows(packed.hashes, gram), window - gram + 1)
    at = np.flatnonzero(whole)
    alone = np.isin(owner[at], hot)
    key = owner[at].copy()
    key[alone] = words.scramble(hashes[at[alone]])
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (key[1:] != key[:-1]) | (alone[1:] & (hashes[at[1:]] != hashes[at[:-1]]))
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(at)))
    place = (np.arange(len(at)) - np.repeat(first, count)).astype(np.uint64)
    content = np.add.reduceat(words.scramble(hashes[at] + place * words.MIX), first) + count.astype(np.uint64)
    # Does a window occur twice in its segment? Long segments may; short ones are looked at.
    segment = np.cumsum(fresh) - 1
    repeats = count > window - gram + 1
    for step in range(1, window - gram + 1):
        twice = (segment[step:] == segment[:-step]) & (hashes[at[step:]] == hashes[at[:-step]])
        repeats[segment[step:][twice]] = True
    text = packed.text_of[at[first]]
    out = {
        "key": key[first].view(np.int64), "content": content, "doc": doc_ids[text], "text": text,
        "start": at[first] - packed.offsets[text], "windows": count, "repeats": repeats, "at": at[first],
    }
    order = np.lexsort((out["start"], out["doc"], out["content"], out["key"]))
    out = {name: values[order] for name, values in out.items()}
    out["symbols"] = words.windows(packed.hashes, symbol).astype(np.uint32)
    return out


def hot_owners(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Owners with more than ``HOT_SHARE`` of the segments; never more than ``2 / HOT_SHARE``."""
    none = np.empty(0, np.uint64)

    def run(batch):
        found = _segments(batch, none, window, gram, window)
        if not found:
            return None
        different = np.ones(len(found["key"]), bool)
        different[1:] = (np.diff(found["key"]) != 0) | (np.diff(found["content"]) != 0)
        keys, counts = np.unique(found["key"][different], return_counts=True)
        many = counts > max(1, counts.sum() * HOT_SHARE / 2)
        names = ["key", "rows"]
        keys, counts = np.append(keys[many], 0), np.append(counts[many], counts.sum())  # key 0: all rows
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=names)

    counted = frames.map_batches(_numbered(docs), run, "key long, rows long", BATCH).groupBy("key").agg(F.sum("rows").alias("rows"))
    heavy = counted.orderBy(F.desc("rows"), "key").limit(int(2 / HOT_SHARE) + 1).collect()
    total = next((r["rows"] for r in heavy if r["key"] == 0), 0)
    keys = [r["key"] for r in heavy if r["key"] != 0 and r["rows"] > total * HOT_SHARE / 2]
    return np.array(keys, np.int64).view(np.uint64)


def segments(docs: DataFrame, hot: np.ndarray, window: int = WINDOW, gram: int = GRAM, symbol: int = SYMBOL) -> DataFrame:
    """Rows of ``SEGMENT``; without symbols: a copy of a segment of the same batch."""
    extra = window - symbol + 1

    def run(batch):
        found = _segments(batch, hot, window, gram, symbol)
        if not found:
            return None
        n = len(found["key"])
        same = np.zeros(n, bool)
        same[1:] = (np.diff(found["key"]) == 0) & (np.diff(found["content"]) == 0)
        leader = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        tie = (found["doc"] == found["doc"][leader]) & (found["start"] == found["start"][leader])
        copy = same & ~tie
        rows = batch.column("row").to_numpy(zero_copy_only=False)[found["text"]]
        # Repeated rows are one document; another text of that id is not, and needs its symbols.
        again = same & tie
        again[1:] &= rows[1:] == rows[:-1]
        kept = ~again
        lengths = np.where(copy, 0, found["windows"] + extra - 1)[kept]
        ends = np.cumsum(lengths)
        inside = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        symbols = found["symbols"][np.repeat(found["at"][kept], lengths) + inside]
        offsets = np.append(0, ends * 4).astype(np.int32)
        valid = np.packbits(~copy[kept], bitorder="little").tobytes()
        binary = pa.Array.from_buffers(
            pa.binary(), int(kept.sum()), [pa.py_buffer(valid), pa.py_buffer(offsets.tobytes()), pa.py_buffer(symbols.tobytes())]
        )
        key = np.where(copy, rows ^ found["start"], found["key"])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key[kept]), pa.array(found["doc"][kept]), pa.array(rows[kept]),
                pa.array(found["start"][kept].astype(np.int32)), pa.array(found["windows"][kept].astype(np.int32)),
                binary, pa.array(found["repeats"][kept]),
            ],
            names=["key", "doc", "row", "start", "windows", "symbols", "repeats"],
        )

    return frames.map_batches(_numbered(docs), run, SEGMENT, BATCH)


def copied_spans(routed: DataFrame, least: int = WINDOW - SYMBOL + 1) -> DataFrame:
    """``doc, row, start, windows``: runs of windows that start earlier elsewhere.

    Streams each partition in order of owner, document and start; holds one owner's automaton.
    """
    ordered = routed.repartition("key").sortWithinPartitions("key", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]):
        current, shard = None, None
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            open_ = batch.column("symbols").is_valid().to_numpy(zero_copy_only=False)
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row", "start", "windows", "repeats")}
            out = [tuple(column[c][~open_] for c in ("doc", "row", "start", "windows"))]
            rows = np.flatnonzero(open_)
            if len(rows):
                keys = key[rows]
                shared = np.ones(len(rows), bool)  # first and last may go on in other batches
                shared[1:-1] = (keys[1:-1] == keys[:-2]) | (keys[1:-1] == keys[2:]) | column["repeats"][rows[1:-1]]
                spans = []
                taken = rows[shared]
                contents = batch.column("symbols").take(pa.array(taken)).to_pylist()
                for i, content in zip(taken.tolist(), contents):
                    if key[i] != current:
                        current, shard = key[i], Shard(least)
                    found = shard.add(int(column["doc"][i]), int(column["start"][i]), content, bool(column["repeats"][i]))
                    spans += [(column["doc"][i], column["row"][i], start, count) for start, count in found]
                if spans:
                    out.append(tuple(map(np.array, zip(*spans))))
            doc, row, start, count = (np.concatenate(c) for c in zip(*out))
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc.astype(np.int64)), pa.array(row.astype(np.int64)),
                        pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    names=["doc", "row", "start", "windows"],
                )

    return frames.map_arrow(ordered, run, SPAN)


def spans(docs: DataFrame) -> DataFrame:
    """``doc, row, spans`` per document that loses words: first word and number of windows of each run."""
    found = copied_spans(segments(docs, hot_owners(docs)))
    return found.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def _with_spans(docs: DataFrame) -> DataFrame:
    found = spans(docs).select(
        F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("spans").alias("__spans")
    )
    numbered = docs.withColumns({"__doc": _order(), "__row": _row()})
    return numbered.join(found, ["__doc", "__row"], "left").drop("__doc", "__row")


def keep(text: bytes, runs, window: int = WINDOW) -> tuple[int, list[bytes]]:
    """Number of words of ``text``, and the words that are in no copied window."""
    split = words.split(text)
    if runs is None:
        return len(split), split
    edge = np.zeros(len(split) + 1, np.int64)
    for run in runs:
        edge[run["start"]] += 1
        edge[run["start"] + run["windows"] + window - 1] -= 1
    gone = edge[:-1].cumsum() > 0
    return len(split), [w for w, g in zip(split, gone) if not g]


def removals(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document."""
    source = docs.select("doc_id", frames.text_column())

    def run(batch):
        rows = []
        for text, runs in zip(frames.texts_as_bytes(batch), batch.column("__spans").to_pylist()):
            count, kept = keep(text, runs)
            rows.append((count, count - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        count, removed, digest = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    schema = f"{frames.ddl(source, 'doc_id')}, n_words long, n_removed long, kept_sha256 string"
    return frames.map_batches(_with_spans(source), run, schema)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with copied runs removed; the words kept are joined by one blank.

    Texts that lose nothing and other columns stay as they are.
    """

    names = docs.columns

    def run(batch):
        texts = [
            text if runs is None else b" ".join(keep(text.encode(), runs)[1]).decode()
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist())
        ]
        columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return frames.map_batches(_with_spans(docs), run, frames.ddl(docs))
