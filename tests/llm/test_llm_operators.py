"""Operators on documents with nulls, empty and long texts, repeated rows and clashing columns."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvigrid.llm import components, minhash, quality, secret_scan, sharding, substrings, topk, toxicity
from llm_support import documents, multiset, near_groups, removed_words, sha, texts, words


# Near copies.


@pytest.mark.parametrize("size", [4, 5])
def test_groups_equal_all_pairs(spark, size):
    rows = texts()
    got = [tuple(r) for r in minhash.groups(documents(spark), size=size).collect()]
    want = [(i, *found) for (i, _), found in zip(rows, near_groups(rows, size))]
    assert multiset(got) == multiset(want)


def test_deduplicate_keeps_one_document_of_each_group(spark):
    docs = documents(spark)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = multiset((r.doc_id, r.text) for r in kept.collect())
    rows = texts()
    staying = [row for row, found in zip(rows, near_groups(rows, 5)) if found[2]]
    # Equal rows of an id are one.
    assert got == multiset([r for r in staying if r[0] is None or not words(r[1])] + list({r for r in staying if r[0] and words(r[1])}))


SEVERAL = {
    "a": " ".join(f"a{i}" for i in range(40)),
    "b": " ".join(f"b{i}" for i in range(40)),
    "c": " ".join(f"c{i}" for i in range(40)),
    "d": " ".join(f"d{i}" for i in range(40)),
}


def several_texts():
    """Ids with several texts: linked to a smaller id, named by none of them alone, one with an empty text."""
    a, b, c, d = SEVERAL.values()
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (20, d), (21, c), (22, d + " end"), (23, ""), (23, b), (23, None)]
    rows += [(None, d), (None, "n " + a[:60]), (None, "n " + a[:60]), (None, "n  " + a[:60])]
    return rows + [(30, "u v w x y z"), (30, "u v w x y z"), (30, "t s r q p o")]


@pytest.mark.parametrize("size", [4, 5])
def test_rows_of_one_id_are_one_document(spark, size):
    rows = several_texts()
    got = [tuple(r) for r in minhash.groups(documents(spark, rows), size=size).collect()]
    assert multiset(got) == multiset((i, *found) for (i, _), found in zip(rows, near_groups(rows, size)))


def test_deduplicate_with_several_texts_and_without_ids(spark):
    rows = several_texts()
    got = [(r.doc_id, r.text) for r in minhash.deduplicate(documents(spark, rows)).collect()]
    without = [t for i, t in got if i is None]
    # Of three rows without id, two texts of one set, one row stays.
    assert len(without) == 1 and words(without[0])[0] == "n"
    a, _, c, d = SEVERAL.values()
    want = [(3, a), (20, c), (20, d), (23, ""), (23, None), (30, "u v w x y z"), (30, "t s r q p o")]
    assert multiset(x for x in got if x[0] is not None) == multiset(want)


def test_deduplicate_chooses_the_same_of_equal_rows(spark):
    """Rows of one id and text that differ elsewhere: the same one stays, however they lie."""
    frame = spark.createDataFrame([(1, "one two three", f"x{i}", None) for i in range(9)], "doc_id long, text string, other string, row map<string,int>")
    kept = {minhash.deduplicate(frame.repartition(n)).first().other for n in (1, 2, 5)}
    assert len(kept) == 1


def test_block_links_find_what_hubs_miss():
    import pandas as pd

    rows = [(i, " ".join(f"w{j}" for j in range(i * 3, i * 3 + 60))) for i in range(12)]
    frame = pd.DataFrame({"node": [i for i, _ in rows], "component": [i for i, _ in rows], "text": [t for _, t in rows]})
    links = {tuple(sorted(p)) for p in minhash.block_links(frame, frame, 4, 80)}
    sets = [set(zip(*(words(t)[k:] for k in range(4)))) for _, t in rows]
    want = {
        (a, b) for b in range(12) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    }
    assert links == want


def test_pigeonhole_guarantee():
    """Signatures with up to 2 * chunks - 1 unequal symbols share a key."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        one = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint16)
        other = one.copy()
        at = rng.choice(minhash.SYMBOLS, 2 * minhash.CHUNKS - 1, replace=False)
        other[at] ^= 1
        a, b = minhash.chunk_keys(np.stack([one, other]))
        assert (a == b).any()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


# Copied passages.


def test_removals_equal_a_dictionary_of_windows(spark):
    rows = texts()
    got = [tuple(r) for r in substrings.removals(documents(spark)).collect()]
    want = []
    for (doc_id, _), (split, gone) in zip(rows, removed_words(rows)):
        kept = [w for w, g in zip(split, gone) if not g]
        want.append((doc_id, len(split), sum(gone), sha(" ".join(kept))))
    assert multiset(got) == multiset(want)


def test_split_owners_give_the_same(spark, monkeypatch):
    """With every owner taken for hot, windows are routed one by one."""
    rows = texts()
    plain = multiset(substrings.removals(documents(spark)).collect())
    keys = substrings.segments(documents(spark), np.empty(0, np.uint64)).select("key").distinct().toPandas()["key"]
    monkeypatch.setattr(substrings, "hot_owners", lambda docs: keys.to_numpy().view(np.uint64)[::2])
    assert multiset(substrings.removals(documents(spark, rows)).collect()) == plain


def test_automaton_reports_earlier_ends():
    rng = np.random.default_rng(2)
    for least in (1, 2, 3):
        automaton, seen = substrings.Automaton(), {}
        for doc in range(60):
            symbols = rng.integers(0, 3, rng.integers(1, 14)).tolist()
            got = automaton.stream(symbols, doc, 0, least)
            want = []
            for i in range(least - 1, len(symbols)):
                run = tuple(symbols[i - least + 1 : i + 1])
                want.append(seen.get(run, (doc, i)) < (doc, i))
                seen.setdefault(run, (doc, i))
            assert got == want


def test_deduplicated_texts(spark):
    docs = documents(spark)
    cut = substrings.deduplicate(docs)
    assert cut.columns == docs.columns
    rows = texts()
    want = [
        (i, " ".join(w for w, g in zip(split, gone) if not g) if any(gone) else text)
        for (i, text), (split, gone) in zip(rows, removed_words(rows))
    ]
    assert multiset((r.doc_id, r.text) for r in cut.collect()) == multiset(want)


# Sharding.


@pytest.mark.parametrize("dimensions,bits", [(2, 3), (3, 3), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    index = sharding.hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_slots_gapless(spark):
    rows = texts()
    got = sharding.assignment(documents(spark)).collect()
    assert multiset((r.doc_id, r.size, r.text_crc32) for r in got) == multiset(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {}
    for r in got:
        assert (r.law, r.grown_shard) == ("rows", None)
        slots.setdefault(r.shard, []).append((r.slot, r.curve))
    sizes = [len(slots[s]) for s in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    order = [c for s in range(sharding.SHARDS) for _, c in sorted(slots[s])]
    assert all(sorted(x for x, _ in slots[s]) == list(range(len(slots[s]))) for s in slots) and order == sorted(order)
    assert sharding.assignment(documents(spark, rows[:3])).count() == 3


def quantile_cells(values, steps):
    """Cells by plain sorting: the cut points below each value; a null lies below all."""
    known = sorted(v for v in values if v is not None)
    cuts = [known[-(-i * len(known) // steps) - 1] for i in range(1, steps)] if known else []
    return [sum(v is not None and v > cut for cut in cuts) for v in values]


def test_cells_take_whole_values(spark):
    """Values with a long common prefix, a hot one, nulls, empty and long ones; a dimension without values."""
    prefix = "common_crawl_" * 30
    names = [f"{prefix}{i}" for i in range(16)] * 5
    rows = [(i, n, None, i % 7) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "id long, source string, lang string, n long").repartition(4)
    for extra in ([], [(1000 + i, v, None, None) for i, v in enumerate([prefix + "hot"] * 40 + ["", None, "é", "\U0001f600", "z" * 9000])]):
        df = frame.unionByName(spark.createDataFrame(extra, frame.schema)) if extra else frame
        dimensions = ("source", "lang", "n")
        got = {r[0]: tuple(r)[1:] for r in df.select("id", *sharding.cells(df, dimensions)).collect()}
        every = rows + extra
        encoded = [None if r[1] is None else r[1].encode() for r in every]
        want = [quantile_cells(column, 32) for column in (encoded, [r[2] for r in every], [r[3] for r in every])]
        assert got == {r[0]: cell for r, cell in zip(every, zip(*want))}
        if not extra:
            assert len({cell[0] for cell in got.values()}) == 16
        order = {r.id: r.curve for r in sharding.curve(df, dimensions).select("id", "curve").collect()}
        ids = sorted(got)
        assert [order[i] for i in ids] == sharding.hilbert_index(np.array([got[i] for i in ids])).tolist()


# Secrets.


def test_ledger_scans_only_what_it_lacks(spark):
    docs = documents(spark)
    first = secret_scan.update_ledger(docs)
    blobs = len({t or "" for _, t in texts()})
    assert first.count() == blobs * len(secret_scan.RULES)
    assert secret_scan.unseen(docs, first).count() == 0
    newer = tuple(
        secret_scan.Rule(r.kind, r.version + (r.kind == "hex"), r.pattern, r.group, r.least, r.hint) for r in secret_scan.RULES
    )
    lacking = secret_scan.unseen(documents(spark, [*texts(), (200, "unseen text")]), first, newer).collect()
    assert sorted(len(r.missing) for r in lacking) == [1] * blobs + [len(newer)]
    assert all(r.missing == ["hex"] for r in lacking if r.text != "unseen text")
    again = secret_scan.update_ledger(docs, first, newer)
    assert again.where("rule = 'hex' and version = 2").count() == blobs
    assert multiset(secret_scan.findings(docs, again, newer).collect()) == multiset(
        secret_scan.findings(docs, first).collect()
    )


def test_masked_texts(spark):
    docs = documents(spark)
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns
    by_id = {r.doc_id: r.text for r in masked.collect()}
    assert by_id[57] == '[secret]" and token:abc [secret]" [secret] [secret]'
    assert by_id[58] == "é [secret] secret:x token=token:abcdefg AKIA123"
    clean = {i: t for i, t in texts() if i not in (57, 58, 60, None)}
    assert all(by_id[i] == t for i, t in clean.items())


# Quality.


def test_sketches_merge_exactly(spark):
    measured = quality.measures(documents(spark))
    halves = [measured.where(F.col("doc_id") % 2 == k) for k in (0, 1)] + [measured.where("doc_id is null")]
    merged = quality.sketches(halves[0])
    for half in halves[1:]:
        merged = quality.merge(merged, quality.sketches(half))
    assert multiset(merged.collect()) == multiset(quality.sketches(measured).collect())


def test_quality_of_odd_documents(spark):
    got = quality.rules(documents(spark)).collect()
    assert len(got) == len(texts())
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].base_failed and by_id[6].n_words == 0 and not by_id[7].kept
    assert by_id[51].n_repeat_words == 500 and by_id[51].base_failed
    assert by_id[59].n_dup_lines == 22 and by_id[60].n_words in (40, 110)
    for i, t in texts():
        if i is not None and [j for j, _ in texts()].count(i) == 1:
            w = words(t)
            assert (by_id[i].n_words, by_id[i].word_chars) == (len(w), sum(map(len, w)))
            assert by_id[i].n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")


def test_quality_of_long_words(spark):
    # Mean words of 20 to 59 characters, and one document of 5,000; and a group of words of 150 to 189.
    def prose(i, length):
        return " ".join(f"{i}x{k}".ljust(length, "y") for k in range(25))

    rows = [(i, prose(i, 20 + i), "a") for i in range(40)] + [(100, prose(100, 5000), "a")]
    rows += [(200 + i, prose(i, 150 + i), "b") for i in range(40)] + [(300, prose(300, 5000), "b")]
    frame = spark.createDataFrame([(i, t, "l", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.rules(frame).collect() if not r.kept} == {100, 300}


# Search.


def brute_force(rows, best=10):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
            vectors[i] = min(vectors.get(i, whole), whole)
    out = []
    for q in vectors:
        if q % 100 == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])
            )
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:best], 1)]
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(700)]
    rows += [(i, [1.0] * 9) for i in range(1000, 1060)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 9), (2003, [float("inf")] * 9), (None, [1.0] * 9)]
    rows += [(3000, [0.5, 0.25]), (3001, [0.125, 1.0]), (4000, []), (0, rows[0][1]), (5, [9.0] * 9), (5000, [3e3] * 9)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, block int")
    want = multiset(brute_force(rows))
    assert multiset(tuple(r) for r in topk.neighbours(frame).collect()) == want
    for name, value in (("QUERY_BLOCK", 2), ("RUN", 100), ("CHUNK", 16)):
        monkeypatch.setattr(topk, name, value)
    assert multiset(tuple(r) for r in topk.neighbours(frame).collect()) == want
    assert topk.neighbours(frame.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-2000, 2000, (50, 17)).astype(float), rng.integers(-2000, 2000, (60, 17)).astype(float)
    exact = topk.products(a, b)
    last = None
    for segments in (1, 4, 16, 40):
        bound = topk.statistics(a, segments) @ topk.statistics(b, segments).T
        assert (bound * (1 + 1e-9) + 1 >= exact).all()
        last = bound
    assert np.allclose(last, exact)  # one component per segment: no slack


def test_best_of_large_negative_products():
    best = topk.Best(np.array([1]), np.array([[-1e5, 1.0]]), 1)
    best.see(np.array([2]), np.array([[1e5, 0.0]]))
    best.see(np.array([3]), np.array([[1e5, 5.0]]))  # higher by 5 of 1e10
    assert best.rows().values.tolist() == [[1, 3, 5 - 10**10]]


# Toxicity.


def labelled(spark, count=1500):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(count):
        toxic = int(rng.random() < 0.2)
        w = [f"word{x}" for x in rng.integers(0, 300, rng.integers(5, 80))]
        for _ in range(toxic * 3):
            w.insert(rng.integers(len(w)), rng.choice(["vile,", "Nasty", "awfulness", "awfully"]))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled(spark)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(documents(spark, rows), frame).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and all(r.held_out for r, _ in held)
    assert np.mean([r.predicted == t for r, t in held]) > 0.95
    # Labels of held-out documents do not matter.
    flipped = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]
    again = toxicity.scores(documents(spark, rows), spark.createDataFrame(flipped, frame.schema)).collect()
    assert all(np.isclose(r.score, got[r.doc_id].score) for r in again)


def test_toxicity_of_odd_documents(spark):
    rows, labels = labelled(spark, 200)
    rows += [(1000, None), (1001, ""), (1002, "vile " * 50_000), (None, "nasty vile awfulness"), (3, rows[3][1])]
    labels += [(1000, None, None), (None, 1, 1), (7, 0, 1), (7, 0, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scores(documents(spark, rows), frame).collect()
    assert len(got) == len(rows) and {r.score for r in got if r.doc_id in (1000, 1001)}.__len__() == 1
    assert not [r for r in got if r.doc_id is None][0].held_out
    accepted = toxicity.accepted(documents(spark, rows), frame)
    assert accepted.columns == documents(spark, rows).columns
    assert accepted.count() == sum(r.score < 0.5 for r in got)
    nothing = toxicity.scores(documents(spark, rows), frame.limit(0)).collect()
    assert {(r.score, r.predicted) for r in nothing} == {(0.0, 0)}


def test_toxicity_of_a_rare_source(spark):
    # Of 12,500 toxic documents in 125,000, ten have words of their own.
    frame = spark.range(125_000).selectExpr(
        "id AS doc_id",
        "CASE WHEN id < 10 THEN 'schlimm' WHEN id % 10 = 0 THEN concat('vile word', id % 40) "
        "ELSE concat('word', id % 40, ' word', id % 31) END AS text",
    )
    labels = frame.selectExpr("doc_id", "1 AS quality", "int(doc_id < 10 OR doc_id % 10 = 0) AS toxic")
    got = toxicity.scores(frame, labels).selectExpr("doc_id < 10 OR doc_id % 10 = 0 AS toxic", "predicted").distinct()
    assert {(r.toxic, r.predicted) for r in got.collect()} == {(True, 1), (False, 0)}


def plain_fit(rows, labels, steps):
    """Weight by feature, from a matrix of all documents and all their features."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = {i: t for i, _, t in labels if not held(i)}
    free = [(known.get(i) == 1, toxicity.features(t.encode())) for i, t in rows if not held(i)]
    toxic, names = np.array([t for t, _ in free]), sorted(set().union(*(f for _, f in free)))
    x = np.array([[f in found for f in names] for _, found in free], float)
    expected = toxic.sum() * (x.sum(0) + 1) / (len(free) + 2)
    typical = (x[toxic].sum(0) - expected) / np.sqrt(expected + 1) > toxicity.SURPRISE
    x = np.hstack([x[:, typical], np.ones((len(free), 1))])
    share = np.clip(np.mean(list(known.values())), *toxicity.PRIOR_RANGE)
    decay = toxicity.DECAY / (1 + len(free) / toxicity.DECAY_ROWS)
    at, mean, square = np.zeros(x.shape[1]), 0, 0
    at[-1] = np.log(share / (1 - share))
    for step in range(1, steps + 1):
        value = x @ at
        # On the operator's grid: the constant's first slope is zero, and Adam would blow up what rounding leaves.
        loss, odds = (np.round(v / toxicity.GRID) * toxicity.GRID for v in (np.log1p(np.exp(value)), 1 / (1 + np.exp(-value))))
        whole, part = (odds @ x) / len(free), share * (odds[toxic] @ x[toxic]) / toxic.sum()
        if loss.mean() - share * loss[toxic].mean() >= 0:
            slope = whole - part + share * ((odds[toxic] - 1) @ x[toxic]) / toxic.sum()
        else:
            slope = part - whole
        slope[:-1] += decay * at[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        at = at - toxicity.RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return dict(zip(np.array(names)[typical], at[:-1])), at[-1]


def test_weights_equal_those_from_all_features_of_all_documents(spark, monkeypatch):
    rows, labels = labelled(spark, 400)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "STEPS", 12)
    weights, constant = plain_fit(rows, labels, 12)
    model = toxicity.train(documents(spark, rows), frame)
    assert model.weights.keys() == weights.keys() and len(weights) > 3
    assert np.allclose([model.weights[f] for f in weights], list(weights.values()), atol=1e-4)
    assert np.isclose(model.constant, constant, atol=1e-4)
    # The same to the last bit in whatever parts the rows and sets are added up.
    for name, value in (("BLOCK", 7), ("COUNTED", 5), ("LONGEST", 3), ("SENT", 0), ("PLACES", 100)):
        monkeypatch.setattr(toxicity, name, value)
    assert toxicity.train(documents(spark, rows).repartition(3), frame) == model


def test_scores_after_the_fit_equal_those_of_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 12)
    rows, labels = labelled(spark, 300)
    rows += [(1000, None), (1001, ""), (None, "vile nasty"), (4, "another vile text of the id")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = multiset((r.doc_id, round(r.score, 12)) for r in toxicity.scores(documents(spark, rows), frame).collect())
    score = toxicity.train(documents(spark, rows), frame).scorer()
    assert got == multiset((i, round(score((t or "").encode()), 12)) for i, t in rows)


# Empty tables.


@pytest.mark.parametrize(
    "operator", [minhash.groups, minhash.deduplicate, substrings.removals, substrings.deduplicate, sharding.assignment,
                 secret_scan.report, secret_scan.redact, quality.rules]
)
def test_empty_table(spark, operator):
    assert operator(documents(spark).limit(0)).count() == 0


def test_empty_tables_of_toxicity(spark):
    frame = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scores(documents(spark).limit(0), frame).count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 3])
def test_several_texts_of_one_id_in_any_partitions(spark, partitions):
    """Both texts of an id begin with a passage that an earlier document holds; where rows lie changes nothing."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"start of it {passage}"), (7, f"{passage} one end"), (7, f"{passage} another end"), (7, f"{passage} one end")]
    rows += [(None, f"{passage} unnamed"), (None, f"{passage} also unnamed")]
    docs = documents(spark, rows).coalesce(1)
    docs = docs.repartition(partitions, "text") if partitions > 1 else docs
    want = [(i, len(w), sum(gone)) for (i, _), (w, gone) in zip(rows, removed_words(rows))]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.removals(docs).collect()]
    assert multiset(got) == multiset(want)
