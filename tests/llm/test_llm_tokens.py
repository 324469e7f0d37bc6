"""Byte-pair merging against the tokenizers library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from pluvigrid.llm import bpe, packing, token_counts, tokens
from llm_support import documents, multiset, sha, texts

PIECES = ["a", "B", "1", " ", "  ", "\n", "\t", "'s", "'", "é", "é", "Σ", "İ", "ß", "中", " ", "<|endoftext|>"]
PIECES += ["<|startoftext|>", "<|", ".", "!!", "the", "̈", "\x1c", "\x85", "😀", "²", "\xa0", "Ɤ", "hello"]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(tokens.vocabulary_path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(tokens.vocabulary_path(token_counts.VOCABULARY))


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def random_texts(count):
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(count)]


def test_merge_tree_gives_the_library_ids(byte_library):
    tree = tokens.merge_tree(tokens.vocabulary_path(bpe.VOCABULARY))
    fast = tokens.library_ids(tokens.vocabulary_path(bpe.VOCABULARY))
    for text in [*random_texts(4000), "x" * 5000, " " * 5000, "\n" * 300 + "a", "ab" * 4000]:
        ids = library_ids(byte_library, text)
        assert np.frombuffer(tree.encode(text), "<u4").tolist() == ids
        assert fast(text).tolist() == ids
        assert tree.decode(tree.encode(text)) == byte_library.decode(ids, skip_special_tokens=False) == text


def test_merge_count_gives_the_library_count(word_library):
    counter = tokens.merge_count(tokens.vocabulary_path(token_counts.VOCABULARY))
    for text in [*random_texts(4000), "x" * 5000, "ab" * 4000, "ΑΣ ΑΣΑ"]:
        assert counter.count(text) == len(library_ids(word_library, text))


def test_memo_stays_bounded_and_right():
    made = []
    memo = tokens.Memo(lambda x: made.append(x) or x * 2, 10)
    for x in [*range(100), *range(95, 100), 3]:
        assert memo[x] == 2 * x
    assert len(memo) <= 10 and len(memo.older) <= 10 and len(made) == 101


def test_text_memo_is_bounded_by_letters():
    made = []
    memo = tokens.TextMemo(lambda x: made.append(x) or len(x), 10)
    words = [str(i) * 40 for i in range(10, 60)] + ["y" * (tokens.LETTERS_KEPT + 1)] * 3
    for x in words * 2:
        assert memo[x] == len(x)
        kept = [*memo, *memo.older]
        assert sum(map(len, kept)) <= 2 * 10 * tokens.MEAN_LETTERS and words[-1] not in kept
    assert made.count(words[-1]) == 6


def test_words_longer_than_narrow_positions(byte_library, word_library, monkeypatch):
    """With few symbols counted as long, all but the shortest words take the wide keys; results stay equal."""
    monkeypatch.setattr(tokens, "LONG", 3)
    tree = tokens.MergeTree(tokens.vocabulary_path(bpe.VOCABULARY))
    counter = tokens.MergeCount(tokens.vocabulary_path(token_counts.VOCABULARY))
    for text in [*random_texts(1000), "x" * 5000, "ab" * 4000, "internationalisation of words", "=" * 900]:
        assert np.frombuffer(tree.encode(text), "<u4").tolist() == library_ids(byte_library, text)
        assert counter.count(text) == len(library_ids(word_library, text))


def test_ids_that_keys_cannot_hold_are_refused():
    assert tokens.fitting({"a": 0, "b": 65_535}) == {"a": 0, "b": 65_535}
    with pytest.raises(ValueError, match="below 65536"):
        tokens.fitting({"a": 65_536})


def test_round_trip_of_odd_documents(spark, byte_library):
    got = [tuple(r) for r in bpe.round_trip(documents(spark)).collect()]
    want = []
    for doc_id, text in texts():
        ids = library_ids(byte_library, text)
        digest = __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((doc_id, len(ids), digest, sha(text or "")))
    assert multiset(got) == multiset(want)


def test_encode_and_decode_keep_other_columns(spark):
    docs = documents(spark)
    encoded = bpe.encode(docs)
    assert sorted(encoded.columns) == sorted(c for c in docs.columns if c != "text")
    assert dict(encoded.dtypes)["ids"] == "binary"
    back = bpe.decode(encoded).select("doc_id", "text").collect()
    assert multiset((r[0], r[1]) for r in back) == multiset((i, t or "") for i, t in texts())


def test_counts_of_odd_documents(spark, word_library):
    got = [tuple(r) for r in token_counts.token_counts(documents(spark)).collect()]
    counted = [(i, t or "", len(library_ids(word_library, t))) for i, t in texts()]
    assert multiset(got) == multiset((i, len(t.encode()), n, n > 2048) for i, t, n in counted)


def test_packing_of_odd_documents(spark, byte_library):
    rows = texts()
    got = packing.pack(documents(spark)).collect()
    wanted = multiset(tuple([*library_ids(byte_library, t), packing.END_ID]) for _, t in rows)
    # Pieces of a document follow each other and give its ids; each starts at 0.
    by_sequence = {}
    for r in got:
        assert r.length == len(r.ids) // 4 > 0
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    unique = {i for i in {i for i, _ in rows} if [j for j, _ in rows].count(i) == 1}
    found = {}
    for r in sorted(got, key=lambda r: r.start):
        if r.doc_id in unique:
            found.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
            assert len(found[r.doc_id]) == r.start + r.length
    assert all(repr(tuple(ids)) in wanted for ids in found.values()) and set(found) == unique
    assert sum(r.length for r in got) == sum(len(library_ids(byte_library, t)) + 1 for _, t in rows)


def test_differencing_is_near_equal_and_windows_rise():
    lengths = [8, 7, 6, 5, 4]
    groups = packing.difference(lengths, 2)
    assert sorted(i for g in groups for i in g) == list(range(5))
    assert sorted(sum(lengths[i] for i in g) for g in groups) == [14, 16]  # the known result of differencing
    risen = packing.near_equal_windows([6, 6, 6], 10)
    assert len(risen) == 3 and all(len(g) == 1 for g in risen)


def test_packing_pads_little(spark):
    rows = [(i, " ".join(["word"] * (i * 37 % 900 + 1))) for i in range(800)]
    got = packing.pack(documents(spark, rows).coalesce(1)).collect()
    windows = len({r.sequence_id for r in got})
    assert sum(r.length for r in got) > 0.98 * windows * packing.CAPACITY


@pytest.mark.parametrize("operator", [bpe.round_trip, token_counts.token_counts, packing.pieces])
def test_empty_table(spark, operator):
    assert operator(documents(spark).limit(0)).count() == 0
