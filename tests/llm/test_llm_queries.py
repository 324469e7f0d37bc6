"""Registered corpus queries against DuckDB SQL, and the pipeline against brute force."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pluvigrid.llm import packing, queries, secret_scan, toxicity
from llm_support import documents, multiset, near_groups, removed_words, texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    result = duck.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    got = multiset(tuple(r) for r in df.select(*columns).collect())
    assert got == multiset(tuple(row[i] for i in order) for row in result.fetchall())


def test_stages_keep_columns_and_follow_each_other(spark, tmp_path):
    """Each stage is judged on what the one before it wrote."""
    rows = [r for r in texts() if r[0] != 60]
    rows += [(300, "you vile nasty thing " * 3), (301, "some vile text here")]
    docs = documents(spark, rows)
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in rows if i is not None]
    labels += [(1000 + i, 1, i % 3 == 0) for i in range(90)]
    extra = [(1000 + i, f"word{i} text{i % 7} " + ("vile nasty" if i % 3 == 0 else "fine good")) for i in range(90)]
    docs = docs.unionByName(documents(spark, extra))
    frame = spark.createDataFrame([(i, q, int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int")
    frame.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        steps.append((name, docs, spark.read.parquet(path)))
        docs = steps[-1][2]
    pairs = {name: ([(r.doc_id, r.text) for r in before.collect()], after) for name, before, after in steps}
    for name, (_, after) in pairs.items():
        assert name == "packing" or after.columns == documents(spark, rows[:1]).columns

    def result(name):
        return multiset((r.doc_id, r.text) for r in pairs[name][1].collect())

    before = pairs["toxicity"][0]
    bad = {r.doc_id for r in toxicity.scores(steps[0][1], frame).where("predicted = 1").collect()}
    assert result("toxicity") == multiset(r for r in before if r[0] not in bad)
    assert {1000, 1003}.isdisjoint(i for i, _ in pairs["near_dedup"][0]) and (100 in {i for i, _ in pairs["near_dedup"][0]})

    before = pairs["near_dedup"][0]
    assert result("near_dedup") == multiset(r for r, found in zip(before, near_groups(before, 5)) if found[2])

    before = pairs["substring_dedup"][0]
    assert result("substring_dedup") == multiset(
        (i, " ".join(w for w, g in zip(split, gone) if not g) if any(gone) else text)
        for (i, text), (split, gone) in zip(before, removed_words(before))
    )
    before = pairs["secret_scan"][0]
    masked = [
        (i, t if t is None else secret_scan.mask(t, [{"start": a, "end": b} for r in secret_scan.RULES for a, b in r.spans(t)]))
        for i, t in before
    ]
    assert result("secret_scan") == multiset(masked) and multiset(masked) != multiset(before)
    pieces = pairs["packing"][1].collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in pairs["packing"][0]}
    assert max(r.offset + r.length for r in pieces) <= packing.CAPACITY


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < 200
