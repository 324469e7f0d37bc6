"""Alignment of two tokenizers' tokens of the same texts, and how often ids meet.

Method: divide and conquer at shared cuts. Both tokens of a text are intervals on its bytes.
An interval of tokens is cut at a common end near its middle, found by bisecting each side's
ends for the other's next end, first to the right of the middle, then to the left; both
parts are treated likewise. An interval without a common end inside is a leaf group. All
intervals of a slice of texts take each step together.

Two tokens are linked where their bytes overlap: each end of either side closes one link. How
often a pair of ids is linked in the whole corpus is counted from chunks: a task writes one
row per chunk of ``CHUNK`` links (beyond them, one slice or one long text at most) with its different pairs and, per text, how often it
has them; texts are tokenised once. Pairs are summed over chunks, the highest count per id of
the second side (at most as many rows as its vocabulary, so it is broadcast) marks the best ones,
and each chunk gets back the counts of its own pairs, in a group bounded by the chunk.

A text that is null or empty, or whose token bytes on either side do not spell a blank and the
text, has no tokens: zeros, and an empty text for its groups. A very long text is one chunk.
Repeated rows and ids are rows of their own; ties for the highest count are all best. An empty
table gives no row; other columns are dropped.
"""

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvigrid.llm import frames, tokens

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 8_000_000  # links
SLICE_BYTES = 4_000_000
ID_BITS = 32  # of a pair that hold the second side's id
SECOND_ID = (1 << ID_BITS) - 1


class Side:
    """One tokenizer: ids of texts with a blank before each, and the bytes of each id."""

    def __init__(self, encode, spelled: list[bytes]):
        self.encode, self.spelled = encode, spelled
        self.lengths = np.array([len(t) for t in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens side by side."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.letters[np.arange(len(shift)) + shift]

    @lru_cache(maxsize=None)
    def digits(self, between: str, last: str) -> np.ndarray:
        """Each id as decimal text with ``between`` after it, then each with ``last`` after it."""
        shown = [f"{i}{mark}".encode() for mark in (between, last) for i in range(len(self.spelled))]
        return np.array(shown, object)


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level vocabulary; strings of special tokens inside texts are plain text."""
    import tiktoken

    tree = tokens.merge_tree(path)
    plain = {token: i for i, token in enumerate(tree.tokens) if token and i not in tree.special.values()}
    # Same ids as merging by rank, where ids stand in the order of the merges; tested.
    encoding = tiktoken.Encoding("vocabulary", pat_str=tokens.MergeTree.SPLIT.pattern, mergeable_ranks=plain, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [encoding.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]

    return Side(encode, tree.tokens)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A sentencepiece model, which puts a blank before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def spelled(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in model.encode(texts, num_threads=1)]

    return Side(encode, [spelled(i) for i in range(model.get_piece_size())])


def sides(first: str | None, second: str | None) -> tuple[Side, Side]:
    return byte_level(first or tokens.vocabulary_path(FIRST)), pieces(second or tokens.vocabulary_path(SECOND))


def near_middle(next_a, next_b, shared, a_lo, a_hi, b_lo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A common end inside each interval of tokens, as the numbers of tokens before it (0: none).

    ``next_b`` bisects the second side for each end of the first: the first token to end there or
    later; ``next_a`` the other way round, and ``shared`` says where that one ends at the same byte.
    The search leaps from side to side, from the middle token to the right, then to the left.
    The third result says whether nothing is shared between the cut and the interval's end.
    """
    middle = (a_lo + a_hi) // 2 - 1
    cut_a, cut_b = np.zeros_like(a_lo), np.zeros_like(a_lo)
    # To the right; an interval's own last end is common and stops the search.
    todo, i = np.arange(len(a_lo)), middle
    while len(todo):
        j = next_b[i]
        i = next_a[j]
        met = shared[j]
        cut_a[todo[met]], cut_b[todo[met]] = i[met] + 1, j[met] + 1
        todo, i = todo[~met], i[~met]
    rest_is_leaf = cut_a == a_hi
    cut_a[rest_is_leaf] = 0
    # To the left of those that found no other.
    todo = np.flatnonzero(rest_is_leaf)
    j = next_b[middle[todo]] - 1
    while len(todo):
        there = j >= b_lo[todo]
        todo, j = todo[there], j[there]
        i, met = next_a[j], shared[j]
        cut_a[todo[met]], cut_b[todo[met]] = i[met] + 1, j[met] + 1
        todo, i = todo[~met], i[~met] - 1
        there = i >= a_lo[todo]
        todo, i = todo[there], i[there]
        j = next_b[i]
        # The last end of the second side up to there, which may be common.
        j = j - ~(shared[j] & (next_a[j] == i))
    return cut_a, cut_b, rest_is_leaf


def leaf_groups(next_a, next_b, shared, counts_a, counts_b) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens before the end of each group, for texts of so many tokens side by side."""
    some = counts_a > 0
    a_hi, b_hi = np.cumsum(counts_a)[some], np.cumsum(counts_b)[some]
    a_lo, b_lo = a_hi - counts_a[some], b_hi - counts_b[some]
    none, leaves = np.empty(0, np.int64), []
    while len(a_lo):
        single = (a_hi - a_lo == 1) | (b_hi - b_lo == 1)
        leaves.append((a_hi[single], b_hi[single]))
        a_lo, a_hi, b_lo, b_hi = (x[~single] for x in (a_lo, a_hi, b_lo, b_hi))
        cut_a, cut_b, rest_is_leaf = near_middle(next_a, next_b, shared, a_lo, a_hi, b_lo)
        leaves.append((a_hi[rest_is_leaf], b_hi[rest_is_leaf]))
        # Both parts of each interval, in the order of the text.
        open_parts = np.stack([cut_a > 0, ~rest_is_leaf], axis=1)
        a_lo, a_hi, b_lo, b_hi = (
            np.stack(pair, axis=1)[open_parts] for pair in ((a_lo, cut_a), (cut_a, a_hi), (b_lo, cut_b), (cut_b, b_hi))
        )
    last_a, last_b = zip((none, none), *leaves)
    return np.sort(np.concatenate(last_a)), np.sort(np.concatenate(last_b))


def _misspelled(texts: list[bytes], tokenised: list[tuple[Side, list[np.ndarray]]]) -> list[int]:
    """Places of the texts that are empty or whose ids on some side do not spell them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    wrong = sizes == 0
    for side, ids in tokenised:
        joined = np.concatenate(ids)
        ends = np.concatenate([[0], np.cumsum(side.lengths[joined])])[np.cumsum([0, *map(len, ids)])]
        wrong |= np.diff(ends) != sizes
        spelled = side.spell(joined)
        # Side by side first: nearly always all texts are spelled as they are.
        if wrong.any() or spelled.tobytes() != b"".join(texts):
            for k in np.flatnonzero(~wrong):
                wrong[k] = spelled[ends[k] : ends[k + 1]].tobytes() != texts[k]
    return np.flatnonzero(wrong).tolist()


class Aligned:
    """Tokens of a slice of texts on one axis of bytes, their groups and links."""

    def __init__(self, texts: list[str], one: Side, other: Side):
        self.one, self.other = one, other
        spelled = [(" " + t).encode() if t else b"" for t in texts]
        found = [one.encode(texts), other.encode(texts)]
        for k in _misspelled(spelled, [(side, ids) for side, ids in zip((one, other), found)]):
            found[0][k] = found[1][k] = np.empty(0, np.uint32)
        self.n_a, self.n_b = (np.array([len(i) for i in ids], np.int64) for ids in found)
        self.ids_a, self.ids_b = (np.concatenate(ids).astype(np.int64) for ids in found)
        self.ends_a, self.ends_b = np.cumsum(one.lengths[self.ids_a]), np.cumsum(other.lengths[self.ids_b])
        # Each end bisects the other side's ends; all at once.
        self.next_a, self.next_b = np.searchsorted(self.ends_a, self.ends_b), np.searchsorted(self.ends_b, self.ends_a)
        self.shared = self.ends_a[self.next_a] == self.ends_b
        self.last_a, self.last_b = leaf_groups(self.next_a, self.next_b, self.shared, self.n_a, self.n_b)
        self.texts_a = np.concatenate([[0], np.cumsum(self.n_a)])
        # Groups end with texts, so the number of groups up to a text's end is that of its last token.
        self.groups_at = np.concatenate([[0], np.searchsorted(self.last_a, np.cumsum(self.n_a), side="right")])
        self.n_groups = np.diff(self.groups_at)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """``(text, pair)`` of all links: one for each end of either side, common ends once."""
        text_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        at_a = self.ids_a << ID_BITS | self.ids_b[self.next_b]
        j = np.flatnonzero(~self.shared)
        i = self.next_a[j]
        at_b = self.ids_a[i] << ID_BITS | self.ids_b[j]
        return np.concatenate([text_a, text_a[i]]), np.concatenate([at_a, at_b])

    def shown(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = (np.diff(last, prepend=0) for last in (self.last_a, self.last_b))
        # In a group the first side's tokens come before the second's.
        place_a = np.arange(len(self.ids_a)) + np.repeat(self.last_b - group_b, group_a)
        place_b = np.arange(len(self.ids_b)) + np.repeat(self.last_a, group_b)
        ends_a, ends_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        ends_a[self.last_a - 1], ends_b[self.last_b - 1] = 1, 1
        out = np.empty(len(place_a) + len(place_b), object)
        out[place_a] = self.one.digits(",", "|")[self.ids_a + ends_a * len(self.one.spelled)]
        out[place_b] = self.other.digits(",", ";")[self.ids_b + ends_b * len(self.other.spelled)]
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        return [b"".join(out[a:b].tolist())[:-1] for a, b in zip(at[:-1], at[1:])]


def _slices(batches, size: int = SLICE_BYTES):
    """Rows of the batches, a bounded number of bytes (or one text) at a time."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:
            rows = max(int(np.searchsorted(np.cumsum(lengths[start:]), size, side="right")), 1)
            yield batch.slice(start, rows)
            start += rows


def groups(docs: DataFrame, first: str | None = None, second: str | None = None) -> DataFrame:
    """``doc_id, groups``: per text its groups, each with its last byte and the ids of both sides."""
    source = docs.select("doc_id", frames.text_column())
    group = pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches):
        one, other = sides(first, second)
        for part in _slices(batches):
            al = Aligned(frames.texts_as_str(part), one, other)
            out = []
            for k in range(part.num_rows):
                found, base = [], int(al.ends_a[al.texts_a[k] - 1]) if al.texts_a[k] else 0
                for g in range(al.groups_at[k], al.groups_at[k + 1]):
                    a0, b0 = (al.last_a[g - 1], al.last_b[g - 1]) if g else (0, 0)
                    found.append(
                        {"end": int(al.ends_a[al.last_a[g] - 1]) - base, "a": al.ids_a[a0 : al.last_a[g]], "b": al.ids_b[b0 : al.last_b[g]]}
                    )
                out.append(found)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(group))], names=["doc_id", "groups"])

    schema = f"{frames.ddl(source, 'doc_id')}, groups array<struct<end:bigint,a:array<int>,b:array<int>>>"
    return frames.map_arrow(source, run, schema)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<i8").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


class Chunk:
    """Texts whose pairs are counted together."""

    def __init__(self):
        self.docs, self.slices, self.links = [], [], 0

    def add(self, doc_ids: list, aligned: Aligned) -> None:
        text, pair = aligned.links()
        code, pairs = pd.factorize(pair)
        self.slices.append((pairs, (text + len(self.docs)).astype(np.int32), code.astype(np.int32)))
        n_links = aligned.n_a + aligned.n_b - aligned.n_groups
        digests = [hashlib.sha256(shown).hexdigest() if shown else "" for shown in aligned.shown()]
        columns = (aligned.n_a, aligned.n_b, aligned.n_groups, n_links)
        self.docs += zip(doc_ids, *(c.tolist() for c in columns), digests)
        self.links += len(pair)

    def row(self) -> tuple:
        """Texts, pairs, how often each occurs, and the sorted ``text * pairs + pair`` that occur, as steps, with their times."""
        pairs = np.unique(np.concatenate([s[0] for s in self.slices]))
        totals = np.zeros(len(pairs), np.int64)
        keys, times = [], []
        for own, text, code in self.slices:
            place = np.searchsorted(pairs, own)
            totals[place] += np.bincount(code, minlength=len(own))
            key, n = np.unique(text * np.int64(len(pairs)) + place[code], return_counts=True)
            keys.append(key)
            times.append(n)
        steps = np.diff(np.concatenate(keys), prepend=0)
        return self.docs, _packed(pairs), _packed(totals), _packed(steps), _packed(np.concatenate(times))


DOC = ("n_a", "n_b", "n_groups", "n_links")


def chunks(docs: DataFrame, first: str | None = None, second: str | None = None, size: int = CHUNK) -> DataFrame:
    """``chunk, docs, pairs, totals, steps, times``: one row per chunk, see ``Chunk.row``."""
    source = docs.select("doc_id", frames.text_column())
    kind = source.schema["doc_id"].dataType.simpleString()
    counts = ",".join(f"{c}:bigint" for c in DOC)
    schema = f"chunk long, docs array<struct<doc_id:{kind},{counts},groups_sha256:string>>, pairs binary, totals binary, steps binary, times binary"

    def run(batches):
        one, other = sides(first, second)
        number, chunk, arrow = TaskContext.get().partitionId() << 33, Chunk(), None

        def closed():
            docs, *packed = chunk.row()
            struct = pa.struct([("doc_id", arrow), *((c, pa.int64()) for c in DOC), ("groups_sha256", pa.string())])
            listed = [dict(zip(("doc_id", *DOC, "groups_sha256"), d)) for d in docs]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([listed], pa.list_(struct)), *(pa.array([p], pa.binary()) for p in packed)],
                names=["chunk", "docs", "pairs", "totals", "steps", "times"],
            )

        for part in _slices(batches):
            arrow = part.schema.field("doc_id").type
            chunk.add(part.column("doc_id").to_pylist(), Aligned(frames.texts_as_str(part), one, other))
            if chunk.links >= size:
                yield closed()
                number, chunk = number + 1, Chunk()
        if chunk.docs:
            yield closed()

    return frames.map_arrow(source, run, schema)


def entries(stored: DataFrame) -> DataFrame:
    """``chunk, place, pair, n``: the different pairs of each chunk."""

    def run(batch):
        number, pairs, totals = (batch.column(c)[0].as_py() for c in ("chunk", "pairs", "totals"))
        pairs, totals = _unpacked(pairs), _unpacked(totals)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(pairs), number)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs), pa.array(totals)],
            names=["chunk", "place", "pair", "n"],
        )

    return frames.map_batches(stored.select("chunk", "pairs", "totals"), run, "chunk long, place int, pair long, n long", rows=1)


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, times, best`` from ``entries``: links of the whole corpus, and whether no pair of that second id has more."""
    counts = frames.stored(found.groupBy("pair").agg(F.sum("n").alias("times")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit(SECOND_ID)).alias("second")
    # One row per id of the second vocabulary at most.
    highest = counts.groupBy(second).agg(F.max("times").alias("highest"))
    marked = counts.withColumn("second", second).join(F.broadcast(highest), "second")
    return marked.select("pair", "times", (F.col("times") == F.col("highest")).alias("best"))


def report(docs: DataFrame, first: str | None = None, second: str | None = None, size: int = CHUNK) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    stored = frames.stored(chunks(docs, first, second, size), "chunks")
    found = entries(stored)
    answers = found.join(pair_counts(found), "pair").select("chunk", "place", "times", "best")
    names = ("doc_id", *DOC, "n_best", "count_sum", "groups_sha256")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names[1:])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.combine_chunks()
        listed = row.column("docs").chunk(0).flatten()
        steps, times = (_unpacked(row.column(c)[0].as_py()) for c in ("steps", "times"))
        place = right.column("place").to_numpy()
        corpus, best = np.zeros((2, len(place)), np.int64)
        corpus[place], best[place] = right.column("times").to_numpy(), right.column("best").to_numpy()
        key = np.cumsum(steps)
        text, code = np.divmod(key, max(len(place), 1))
        at = np.searchsorted(text, np.arange(len(listed) + 1))
        sums = []
        for value in (best, corpus):
            total = np.concatenate([[0], np.cumsum(value[code] * times)])
            sums.append(pa.array(total[at[1:]] - total[at[:-1]], pa.int64()))
        fields = dict(zip((f.name for f in listed.type), listed.flatten()))
        fields |= {"n_best": sums[0], "count_sum": sums[1]}
        return pa.table([fields[c] for c in names], names=list(names))

    frames.importable(docs.sparkSession)
    whole = stored.select("chunk", "docs", "steps", "times")
    return whole.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(counted, schema)
