"""What operators and the pipeline leave in the shared folder."""

import pytest

import corpus_pipeline
from llm_support import documents, multiset
from pluvigrid import session
from pluvigrid.llm import minhash, toxicity
from pluvigrid.sources.files import subfolders


@pytest.fixture
def left(spark):
    """``left()``: kinds of tables that were written since the test began and are still there."""

    def tables():
        folder = session._application_folder(spark)
        session.stored(spark.range(1), "any")  # the folder exists
        return {name for name in subfolders(spark, folder) if not name.startswith("any-")}

    before = tables()
    return lambda: sorted(name.rsplit("-", 1)[0] for name in tables() - before)


def toxic_rows():
    rows = [(i, f"word{i} text{i % 7} " + ("vile nasty" if i % 3 == 0 else "fine good")) for i in range(90)]
    return rows + [(90, None), (91, ""), (None, "vile nasty words"), (3, rows[3][1])]


def toxic_labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")


def test_working_tables_end_with_their_block(spark, left):
    outer = session.stored(spark.range(3), "outer")
    with session.working_tables(spark):
        one = session.stored(spark.range(4), "one")
        with session.working_tables(spark):
            session.stored(one, "two")
            assert left() == ["one", "outer", "two"]
        kept = session.stored(one, "kept", session.shared_path(spark, "kept"))
        assert left() == ["kept", "one", "outer"]
    with pytest.raises(ZeroDivisionError), session.working_tables(spark):
        session.stored(spark.range(4), "three")
        1 / 0
    assert left() == ["kept", "outer"] and (outer.count(), kept.count()) == (3, 4)


def test_toxicity_leaves_no_table_of_all_documents(spark, left):
    docs, labels = documents(spark, toxic_rows()), toxic_labels(spark)
    kept = toxicity.accepted(docs, labels)
    assert left() == []
    got = multiset((r.doc_id, r.text) for r in kept.collect())
    scored = toxicity.scores(docs, labels)
    assert left() == ["toxic-places"]
    bad = {r.doc_id for r in scored.where("predicted = 1").collect()}
    assert got == multiset(r for r in toxic_rows() if r[0] not in bad) and {0, 3, None} <= bad


def test_near_copies_leave_their_labels_alone(spark, left):
    rows = [(i, " ".join(f"w{i % 4}x{j}" for j in range(30)) + f" end{i % 2}") for i in range(12)] + [(20, None), (None, "a b")]
    kept = minhash.deduplicate(documents(spark, rows))
    assert left() == ["labelled"]
    assert multiset((r.doc_id, r.text) for r in kept.collect()) == multiset([*rows[:4], *rows[12:]])


def test_run_leaves_its_result_alone(spark, left, tmp_path):
    documents(spark, toxic_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    toxic_labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert left() == ["packing"]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} >= {1, 2, 90, 91}
