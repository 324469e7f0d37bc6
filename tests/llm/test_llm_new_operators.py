"""Merkle manifest, tokenizer alignment and SimHash groups against plain re-computations."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from pluvigrid.llm import alignment, merkle, queries, simhash
from llm_support import documents, multiset, sha, texts, words

SF = "/root/testdata/sf0.001"


# Merkle manifest.


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(row, lowered=False):
    text = row.text
    if lowered and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sha("".join(plain_field(v) for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def plain_tree(leaves):
    """The root, and each leaf's siblings level by level."""
    nodes, at, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def plain_report(rows):
    by_source = defaultdict(list)
    for row in rows:
        by_source[row.source].append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        group = sorted(by_source[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes.fromhex(plain_leaf(r))))
        trees.append((group, *plain_tree([plain_leaf(r) for r in group])))
    root, over = plain_tree([subroot for _, subroot, _ in trees])
    out = []
    for (group, subroot, paths), above in zip(trees, over):
        for row, path in zip(group, paths):
            path = path + above
            changed = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0
            folded = plain_leaf(row, changed)
            for before, after in path:
                folded = sha(before + folded + after)
            out.append((row.doc_id, plain_leaf(row), subroot, root, sha("".join(b + a for b, a in path)), folded, folded == root))
    return out


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_plain_trees(spark, levels):
    """Lower blocks give more rounds of block roots."""
    docs = documents(spark, texts() + [(1000 + i, f"Text {i}") for i in range(700)])
    assert multiset(tuple(r) for r in merkle.report(docs, levels=levels).collect()) == multiset(plain_report(docs.collect()))


def test_manifest_of_few_rows(spark):
    for rows in ([(1, "A")], [(5, None)], [(None, "x")], [(i, "A") for i in (0, 0, 0)]):
        docs = documents(spark, rows)
        got = [tuple(r) for r in merkle.report(docs).collect()]
        assert multiset(got) == multiset(plain_report(docs.collect()))
    assert merkle.report(documents(spark, [(1, "a")]).where("false")).count() == 0


def test_proofs_fold_to_the_root(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(40)])
    found = merkle.proofs(docs).collect()
    assert len(found) == 40 and len({r.root for r in found}) == 1
    for row in found:
        path = [(p.before, p.after) for p in row.path]
        assert merkle.fold(row.leaf, path) == row.root != merkle.fold(sha(row.leaf), path)


def test_addresses_are_a_van_emde_boas_order():
    rows = 4
    places = [merkle.addresses(rows, depth, np.arange(16**depth)) for depth in range(rows)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(rows)))
    # The upper half comes first; then each subtree of the lower half lies in one piece.
    assert places[0].tolist() == [0] and places[1].tolist() == list(range(1, 17))
    for i in range(256):
        part = {int(places[2][i]), *places[3][16 * i : 16 * i + 16].tolist()}
        assert part == set(range(17 + 17 * i, 34 + 17 * i))


# Alignment.


@pytest.fixture(scope="module")
def tokenizers():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_characters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return table


def plain_alignment(rows, tokenizers):
    first, second = tokenizers
    table, per_row, corpus = byte_characters(), [], Counter()
    for doc_id, text in rows:
        spelled = (" " + (text or "")).encode()
        a = [(i, bytes(table[c] for c in first.id_to_token(i))) for i in first.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = []
        for i in second.encode(text or ""):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(t for _, t in a) != spelled or b"".join(t for _, t in b) != spelled:
            a = b = []

        def spans(tokens):
            at, out = 0, []
            for i, t in tokens:
                out.append((i, at, at + len(t)))
                at += len(t)
            return out

        a, b = spans(a), spans(b)
        cuts = {e for _, _, e in a} & {e for _, _, e in b}

        def cut(tokens):
            out = [[]] if tokens else []
            for i, _, end in tokens:
                out[-1].append(i)
                if end in cuts:
                    out.append([])
            return out[:-1]

        groups = [*zip(cut(a), cut(b))]
        links, j = [], 0
        for i, start, end in a:
            while j < len(b) and b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                links.append((i, b[k][0]))
                k += 1
        corpus.update(links)
        per_row.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, second_id), n in corpus.items():
        best[second_id] = max(best[second_id], n)
    out = []
    for doc_id, n_a, n_b, groups, links in per_row:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        n_best = sum(corpus[link] == best[link[1]] for link in links)
        out.append((doc_id, n_a, n_b, len(groups), len(links), n_best, sum(corpus[link] for link in links), sha(shown) if shown else ""))
    return out, per_row


ODD = [(400, "▁ a piece's blank"), (401, "<|endoftext|> <s> </s> <0x41>"), (402, " " * 300 + "end"), (403, "ab" * 5000), (404, "\x00\t\r\n")]


@pytest.mark.parametrize("size", [1, 2_000, alignment.CHUNK])
def test_alignment_equals_plain_spans(spark, tokenizers, size):
    rows = texts() + ODD
    got = [tuple(r) for r in alignment.report(documents(spark, rows), size=size).collect()]
    assert multiset(got) == multiset(plain_alignment(rows, tokenizers)[0])


def test_alignment_of_a_whole_table(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    got = [tuple(r) for r in queries.op12_alignment(spark, SF).collect()]
    assert multiset(got) == multiset(plain_alignment(rows, tokenizers)[0])


def test_groups_hold_ids_and_ends(spark, tokenizers):
    rows = [(1, "naïve café 中文 x"), (2, None), (3, "one two three"), (4, "one two three")]
    got = {r.doc_id: r.groups for r in alignment.groups(documents(spark, rows)).collect()}
    for doc_id, _, _, groups, _ in plain_alignment(rows, tokenizers)[1]:
        assert [(list(g.a), list(g.b)) for g in got[doc_id]] == [tuple(g) for g in groups]
    assert got[1][-1].end == len(" naïve café 中文 x".encode())


def test_leaf_groups_equal_shared_ends():
    """Random cuts of one axis, dense and sparse, with texts that share nothing inside."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        ends, counts, shared, base = ([], []), ([], []), [], 0
        for _ in range(rng.integers(1, 6)):
            length = int(rng.integers(1, 60))
            cuts = [sorted({*rng.choice(length, rng.integers(0, length)).tolist()} - {0}) + [length] for _ in range(2)]
            for side in (0, 1):
                ends[side].extend(base + c for c in cuts[side])
                counts[side].append(len(cuts[side]))
            shared += [base + c for c in sorted(set(cuts[0]) & set(cuts[1]))]
            base += length
        a, b = (np.array(e) for e in ends)
        next_a, next_b = np.searchsorted(a, b), np.searchsorted(b, a)
        last_a, last_b = alignment.leaf_groups(next_a, next_b, a[next_a] == b, *(np.array(c) for c in counts))
        assert a[last_a - 1].tolist() == shared == b[last_b - 1].tolist()


def test_alignment_of_nothing(spark):
    assert alignment.report(documents(spark, [(1, "a")]).where("false")).count() == 0
    assert [tuple(r) for r in alignment.report(documents(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


# SimHash.


def plain_fingerprint(text, size=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    size = min(size, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(len(w) - size + 1)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(rows, prints):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = [None] * len(rows)
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = (rows[i][0], f"{prints[i]:016x}", min(ids) if ids else None)
    return out


def test_simhash_groups_equal_all_pairs(spark):
    rows = texts() + [(500 + i, "alpha beta gamma delta " * 20 + f"tail{i}") for i in range(30)] + [(1, "another text"), (None, "a b c d")]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_groups(rows, prints)
    got = [tuple(r) for r in simhash.groups(documents(spark, rows)).collect()]
    assert multiset(got) == multiset(want)
    # Links between different fingerprints occur.
    shown = {r[0]: f"{p:016x}" for r, p in zip(rows, prints)}
    assert any(c is not None and p != shown[c] for _, p, c in want)


def test_simhash_of_a_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    assert prints[:30] == [plain_fingerprint(t) for _, t in rows[:30]]
    got = [tuple(r) for r in queries.op13_simhash(spark, SF).collect()]
    assert multiset(got) == multiset(plain_groups(rows, prints))


def test_golay_code_covers_every_word_once():
    bits, patterns = simhash.code(2)
    assert (patterns[0] >= 0).all() and patterns[0].shape == (1 << simhash.CHECKS, 1)
    weights = np.array([int(p).bit_count() for p in patterns[0][:, 0]])
    assert weights.max() == simhash.RADIUS
    assert [int((p >= 0).sum()) for p in patterns] == [2048, 8855, 33649]


def test_links_of_a_dense_cluster(spark):
    """All words within two bits of one, with it all pairs: homes and replicas miss no link."""
    rng = np.random.default_rng(1)
    center = int(rng.integers(0, 1 << 62))
    near = {center ^ (1 << i) for i in range(64)} | {center ^ (1 << i) ^ (1 << (i + 5) % 64) for i in range(64)}
    far = {int(x) for x in rng.integers(0, 1 << 62, 200)}
    points = sorted(near | far | {center, 0, 3, (1 << 64) - 1})
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = [tuple(r) for r in simhash.links(frame).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_of_few_rows(spark):
    assert simhash.groups(documents(spark, [(1, "a")]).where("false")).count() == 0
    got = [tuple(r) for r in simhash.groups(documents(spark, [(None, None), (None, " "), (7, "")])).collect()]
    assert got == [(None, "0" * 16, 7)] * 2 + [(7, "0" * 16, 7)] or multiset(got) == multiset([(None, "0" * 16, 7)] * 2 + [(7, "0" * 16, 7)])
    long = "word " * 70_000 + "end"
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)
