"""Byte-pair merging by two methods, and the splitting of texts before it.

``MergeTree`` keeps adjacent pair ranks in a segment tree and yields ids. ``MergeCount``
keeps them in a heap over a linked list and yields only a number. Vocabulary files are
read from the path given; nothing of them is kept in this repository.
"""

import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import regex

NONE = 1 << 61
POSITIONS = 24  # bits of a tree or heap key that hold the position
LONG, WIDE = 1 << POSITIONS, 48  # words of more symbols than LONG get WIDE bits for the position
IDS = 1 << 16
ID_MASK = IDS - 1
# Entries of one generation of a memo, letters of a word that is kept, and letters per entry
# in a generation: together they bound a worker's memory.
WORDS_KEPT, CHUNKS_KEPT = 300_000, 150_000
LETTERS_KEPT, MEAN_LETTERS = 256, 16


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """Results by word. Two generations: words in use survive when the memo is full."""

    def __init__(self, compute, size: int = WORDS_KEPT):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class TextMemo(Memo):
    """A memo whose words are texts: bounded by their letters too; long ones are computed each time."""

    letters = 0

    def __missing__(self, word):
        if len(word) > LETTERS_KEPT:
            return self.compute(word)
        if self.letters + len(word) > self.size * MEAN_LETTERS:
            self.older = dict(self)
            self.clear()
        value = super().__missing__(word)
        self.letters = len(word) + (self.letters if len(self) > 1 else 0)
        return value


def fitting(vocabulary: dict[str, int]) -> dict[str, int]:
    """The vocabulary, if merge keys have room for its ids."""
    if max(vocabulary.values(), default=0) >= IDS:
        raise ValueError(f"ids of a vocabulary must be below {IDS}")
    return vocabulary


class MergeTree:
    """Byte-level BPE: merge the leftmost pair of lowest rank until no pair has one."""

    # The split before byte-level merges.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    # A blank before white space or the end does not start a piece of its own.
    LOOSE_BLANK = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = fitting(spec["model"]["vocab"]), spec["model"]["merges"]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.byte_ids = [vocab[c] for c in characters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        tokens |= {i: content.encode() for content, i in self.special.items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(t) for t in self.tokens])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.merges = {
            vocab[left] << 16 | vocab[right]: (rank << 16 | vocab[left + right]) << POSITIONS
            for rank, (left, right) in enumerate(merges)
        }
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = TextMemo(self._word)
        self.chunks = TextMemo(self._chunk, CHUNKS_KEPT)

    def merge(self, ids: list[int]) -> list[int]:
        """``ids`` after all merges. The tree's root is the pair to merge next.

        A leaf holds rank, merged id and position of the pair of the symbol that starts
        there, in one number, so the least is the leftmost pair of the lowest rank.
        """
        pairs = len(ids) - 1
        if pairs < 1:
            return ids
        ranked, bits, none = self.merges.get, POSITIONS, NONE
        if pairs >= LONG:
            key_of, bits, none = self.merges.get, WIDE, NONE << WIDE - POSITIONS
            ranked = lambda pair, default: key << WIDE - POSITIONS if (key := key_of(pair)) else default
        mask = (1 << bits) - 1
        tree = [none] * pairs
        tree += [ranked(a << 16 | b, none) + i for i, (a, b) in enumerate(pairwise(ids))]
        for node in range(pairs - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        before, after = list(range(-1, pairs)), list(range(1, pairs + 2))
        while (best := tree[1]) < none:
            i = best & mask
            j = after[i]
            ids[i] = merged = best >> bits & ID_MASK
            ids[j] = -1
            k = after[i] = after[j]
            changed = []
            if k <= pairs:
                before[k] = i
                changed.append((i + pairs, ranked(merged << 16 | ids[k], none) + i))
                changed.append((j + pairs, none))
            else:
                changed.append((i + pairs, none))
            h = before[i]
            if h >= 0:
                changed.append((h + pairs, ranked(ids[h] << 16 | merged, none) + h))
            for node, key in changed:
                tree[node] = key
                while node > 1:
                    other = tree[node ^ 1]
                    if other < key:
                        key = other
                    node >>= 1
                    if tree[node] == key:
                        break
                    tree[node] = key
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        ids = [self.byte_ids[b] for b in word.encode()]
        return array("I", self.merge(ids)).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.SPLIT.findall(chunk)))

    def _plain(self, text: str) -> bytes:
        if self.LOOSE_BLANK.search(text):
            return b"".join(map(self.words.__getitem__, self.SPLIT.findall(text)))
        # Every blank starts a piece, so pieces between blanks can be looked up whole.
        first, *rest = text.split(" ")
        known = self.chunks.__getitem__
        return known(first) + b"".join([known(" " + chunk) for chunk in rest])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(content in text for content in self.special):
            return self._plain(text)
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else self._plain(part)
            for part in self.at_special.split(text)
        )

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4")
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        if not len(ends):
            return ""
        shift = np.repeat(self.starts[tokens] - (ends - lengths), lengths)
        return self.letters[np.arange(ends[-1]) + shift].tobytes().decode("utf-8", "replace")


class MergeCount:
    """BPE with word ends: how many tokens, from the number of merges alone."""

    # The split of lower-cased text and the mark of a word's end.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    END = "</w>"
    # Character by character: a capital sigma does not look at its place in the word.
    # The others are pairs that newer Unicode tables than Python's have.
    LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7DC: 0x19B}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = fitting(spec["model"]["vocab"])
        characters = byte_characters()
        self.inner = [vocab[c] for c in characters]
        self.last = [vocab[c + self.END] for c in characters]
        self.merges = {
            vocab[left] << 16 | vocab[right]: (rank << 16 | vocab[left + right]) << POSITIONS
            for rank, (left, right) in enumerate(spec["model"]["merges"])
        }
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = TextMemo(self._word)
        self.chunks = TextMemo(self._chunk, CHUNKS_KEPT)

    def merges_of(self, symbols: list[int]) -> int:
        """Number of merges: pop the lowest-ranked pair, relink, push its new neighbours."""
        ranked, end, bits = self.merges.get, len(symbols), POSITIONS
        if end > LONG:
            key_of, bits = self.merges.get, WIDE
            ranked = lambda pair: key << WIDE - POSITIONS if (key := key_of(pair)) else None
        mask = (1 << bits) - 1
        heap = [key + i for i, (a, b) in enumerate(pairwise(symbols)) if (key := ranked(a << 16 | b))]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        before, after, done = list(range(-1, end - 1)), list(range(1, end + 1)), 0
        while heap:
            best = pop(heap)
            i = best & mask
            j = after[i]
            # Skipped if the pair was there when it was pushed, but no longer is.
            if symbols[i] < 0 or j >= end or ranked(symbols[i] << 16 | symbols[j]) != best - i:
                continue
            symbols[i] = merged = best >> bits & ID_MASK
            symbols[j] = -1
            done += 1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if key := ranked(merged << 16 | symbols[k]):
                    push(heap, key + i)
            h = before[i]
            if h >= 0 and (key := ranked(symbols[h] << 16 | merged)):
                push(heap, key + h)
        return done

    def _word(self, word: str) -> int:
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return len(symbols) - self.merges_of(symbols)

    def _chunk(self, chunk: str) -> int:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).translate(self.LOWER)
        return sum(map(self.words.__getitem__, self.SPLIT.findall(chunk.lower())))

    def count(self, text: str) -> int:
        parts = self.at_special.split(text) if any(s in text for s in self.special) else (text,)
        # White space is dropped, and no word or composed character reaches across it.
        return sum(
            1 if part in self.special else sum(map(self.chunks.__getitem__, part.split(" "))) for part in parts if part
        )


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def merge_tree(path: str) -> MergeTree:
    """One per worker process."""
    return MergeTree(path)


@lru_cache(maxsize=2)
def merge_count(path: str) -> MergeCount:
    return MergeCount(path)


@lru_cache(maxsize=2)
def library_ids(path: str):
    """The vocabulary at ``path`` in the tiktoken library: ids by rank, as numpy array.

    Same ids as ``MergeTree`` where ids stand in the order of the merges.
    """
    import tiktoken

    tree = merge_tree(path)
    ranks = {token: i for i, token in enumerate(tree.tokens) if token and i not in tree.special.values()}
    encoding = tiktoken.Encoding(
        "vocabulary", pat_str=MergeTree.SPLIT.pattern, mergeable_ranks=ranks, special_tokens=tree.special
    )

    def ids(text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, allowed_special="all")

    return ids
