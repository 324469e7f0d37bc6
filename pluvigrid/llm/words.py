"""Words of a text as numbers. A word is a run of bytes other than blank and \\t \\n \\v \\f \\r."""

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def split(text: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: what ``bytes.split`` takes for white space is just that."""
    return text.split()


def numbers(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words; empty if there are fewer."""
    count = len(hashes) - size + 1
    if count < 1:
        return np.empty(0, np.uint64)
    total = hashes[:count].copy()
    for i in range(1, size):
        total *= MIX
        total += hashes[i : i + count]
    return scramble(total)


class Batch:
    """The words of many texts in one array, so that the work on windows is vectorised."""

    def __init__(self, texts: list[bytes]):
        split_texts = [split(t) for t in texts]
        self.lengths = np.array([len(w) for w in split_texts], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        every = (xxhash.xxh64_intdigest(w) for words in split_texts for w in words)
        self.hashes = np.fromiter(every, np.uint64, total)
        self.text_of = np.repeat(np.arange(len(texts)), self.lengths)

    def whole_windows(self, size: int) -> np.ndarray:
        """For each run of ``size`` words, whether it lies in one text."""
        count = max(len(self.hashes) - size + 1, 0)
        return self.text_of[:count] == self.text_of[len(self.text_of) - count :]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each run of ``size`` values."""
    width, low = 1, values
    while 2 * width <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = size - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
