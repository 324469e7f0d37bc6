"""Tables and models change in one step, also when a job dies; writing jobs count their rows."""

import os
import signal
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pluvigrid.checks import catalog
from pluvigrid.operators import forest
from pluvigrid.plans import process
from pluvigrid.sources import models, processed, readings, versions

SF = "/root/testdata/sf0.001"
NAMES = ("daily", "monthly", "seasonal", "probability")


def raw(spark, amount):
    rows = [(f"{year}-{month:02d}-01", "S", "A", amount) for year in (2019, 2020, 2021) for month in (1, 6, 7)]
    return spark.createDataFrame(rows, "Date STRING, State STRING, District STRING, Avg_rainfall DOUBLE")


def content(spark, folder):
    return {name: sorted(map(str, processed.read_table(spark, folder, name).collect())) for name in NAMES}


@pytest.mark.parametrize("survived", [0, 2, 3])
def test_a_failed_job_leaves_the_old_tables(spark, tmp_path, monkeypatch, survived):
    folder = str(tmp_path / "out")
    process.process_frame(raw(spark, 4.0), folder)
    before = content(spark, folder)
    write, done = process.write_table, []

    def failing(*args, **more):
        if len(done) == survived:
            raise KeyboardInterrupt
        done.append(args)
        return write(*args, **more)

    monkeypatch.setattr(process, "write_table", failing)
    with pytest.raises(KeyboardInterrupt):
        process.process_frame(raw(spark, 9.0), folder)
    assert content(spark, folder) == before
    monkeypatch.undo()
    process.process_frame(raw(spark, 9.0), folder)
    assert content(spark, folder) != before
    # What the dead job wrote goes when asked for; the last two versions stay.
    assert len(versions.prune(spark, folder, abandoned=True)) == (survived > 0)
    assert len(list(Path(folder, "versions").iterdir())) == 2 and content(spark, folder) != before


def test_a_killed_process_leaves_the_old_tables(spark, tmp_path):
    folder = str(tmp_path / "out")
    process.process_frame(raw(spark, 4.0), folder)
    before = content(spark, folder)
    script = f"""
        import os, signal, sys
        sys.path[:0] = {[str(Path(__file__).parent), str(Path(__file__).parents[1])]!r}
        from pluvigrid.plans import process
        from pluvigrid.session import local_session
        from test_versions import raw
        spark = local_session("2")
        write, done = process.write_table, []
        def killed(*args, **more):
            if len(done) == 2:
                os.kill(os.getpid(), signal.SIGKILL)
            done.append(args)
            return write(*args, **more)
        process.write_table = killed
        process.process_frame(raw(spark, 9.0), {folder!r})
    """
    ended = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], env=os.environ, capture_output=True, timeout=240)
    assert ended.returncode == -signal.SIGKILL
    assert len(list(Path(folder, "versions").iterdir())) == 2
    assert content(spark, folder) == before


def test_commits_are_numbered_and_never_taken_twice(spark, tmp_path):
    folder = str(tmp_path)
    assert versions.current(spark, folder) is None and versions.location(spark, folder) == folder
    names = [versions.staged(folder) for _ in range(3)]
    for name in names:
        Path(name).mkdir(parents=True)
    assert versions.publish(spark, folder, names[0]) == 1
    # A job that claimed a number and died blocks nobody.
    Path(folder, "commits", "000000000002.claim").touch()
    assert versions.publish(spark, folder, names[1]) == 3
    assert versions.current(spark, folder) == names[1]
    assert versions.prune(spark, folder, keep=1) == [names[0].rsplit("/", 1)[1]]
    assert Path(names[1]).exists() and Path(names[2]).exists()


def test_a_failed_save_leaves_the_old_model(spark, tmp_path, monkeypatch):
    rows = catalog.matrix(spark, SF).cache()
    codes = [rows.select("district_name", "district_encoded").distinct(), rows.select("state_name", "state_encoded").distinct()]
    folds = spark.createDataFrame([(0.5,)], "accuracy DOUBLE")
    folder, metadata = str(tmp_path / "model"), forest.model_metadata(forest.cv_summary(folds))
    models.save_model(forest.train_forest(rows, trees=2), metadata, *codes, folder)
    first = models.load_model(spark, folder)
    bad = metadata.withColumn("cv_mean_accuracy", F.raise_error(F.lit("disk full")).cast("double"))
    with pytest.raises(Exception, match="disk full"):
        models.save_model(forest.train_forest(rows, trees=3), bad, *codes, folder)
    again = models.load_model(spark, folder)
    assert again.model.stages[-1].getNumTrees == first.model.stages[-1].getNumTrees == 2
    models.save_model(forest.train_forest(rows, trees=3), metadata, *codes, folder)
    assert models.load_model(spark, folder).model.stages[-1].getNumTrees == 3


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_counts_come_from_the_writing_job(spark, tmp_path, monkeypatch, fmt):
    """No counting job and one gap fill; ML still works in the caller's session."""
    fills = []
    fill = process.fill_daily
    monkeypatch.setattr(process, "fill_daily", lambda *a, **k: fills.append(1) or fill(*a, **k))
    rows = raw(spark, 4.0).withColumn("Avg_rainfall", F.when(F.col("Date") != "2020-06-01", F.col("Avg_rainfall")))
    rows = rows.unionByName(raw(spark, 1.0).withColumn("District", F.lit(None).cast("string")))
    summary = process.process_frame(rows, str(tmp_path), fmt)
    assert len(fills) == 1
    assert summary.rows == {n: processed.count_table(spark, str(tmp_path), n, fmt) for n in NAMES}
    # Rows without a district are not filled.
    assert (summary.missing_before, summary.missing_after) == (1, 9) and summary.rows["daily"] == 18
    features = catalog.matrix(spark, SF)
    assert forest.train_forest(features, trees=2).transform(features).count() == features.count()


def test_headers_are_found_by_executors(spark, tmp_path, monkeypatch):
    """Many files of three headers; the driver sees one row per header and opens none."""
    heads = ["a,b", "b,a", '"a",c']
    for i in range(60):
        (tmp_path / f"f {i:02d}%+.csv").write_text(("\n \n" if i % 5 == 0 else "") + f"{heads[i % 3]}\n{i},x\n")
    (tmp_path / "empty.csv").write_text("\n\n")
    paths = readings.require_inputs(spark, str(tmp_path))
    found = readings.header_lines(spark, paths)
    assert {head: len(names) for head, names in found.items()} == dict.fromkeys(heads, 20)
    with pytest.raises(ValueError, match="without a header"):
        readings.read_daily_csv(spark, str(tmp_path))
    (tmp_path / "empty.csv").write_text("a\n")
    df = readings.read_daily_csv(spark, str(tmp_path))
    assert sorted(df.columns[:3]) == ["a", "b", "c"] and df.count() == 60
    got = {r["source_file"]: (r["a"], r["b"], r["c"]) for r in df.collect()}
    assert got["f 01%+.csv"] == ("x", "1", None) and got["f 02%+.csv"] == ("2", None, "x")


def test_a_large_file_has_one_header(spark, tmp_path):
    """Only the first split of a file names it."""
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 50_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert readings.header_lines(spark, readings.require_inputs(spark, str(tmp_path))) == {"a,b": ["a.csv"]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_are_judged_by_forests_that_have_not_seen_them(spark):
    rows = catalog.matrix(spark, SF)
    many = rows
    for i in range(3):
        many = many.unionByName(rows.withColumn("state_name", F.concat("state_name", F.lit(f" {i}"))))
    many = many.unionByName(rows).cache()
    drawn = many.withColumns({f"t{r}": forest.times_drawn(r, 10) for r in range(10)})
    assert drawn.where(" and ".join(f"t{r} > 0" for r in range(10))).isEmpty()
    share = drawn.agg(F.avg("t0"), F.avg((F.col("t1") == 0).cast("int"))).first()
    assert 0.6 < share[0] < 1.2 and 0.3 < share[1] < 0.6
    # Labels that no input explains are not learnt by those that have not seen them.
    noise = many.withColumn("target_above_normal", (F.xxhash64(*forest.KEYS) % 2 == 0).cast("int"))
    judged = forest.out_of_bag(noise, replicas=5, trees=10).cache()
    assert judged.columns == [*many.columns, "n_judges", "chance", "prediction", "accuracy"]
    found = judged.collect()
    assert len(found) == forest.trainable_rows(many).count() and all(1 <= r["n_judges"] <= 5 for r in found)
    assert all((r["chance"] > 0.5) == (r["prediction"] == 1) for r in found)
    summary = forest.cv_summary(judged).first()
    assert summary["n_folds"] == len(found) and summary["cv_mean_accuracy"] < 0.75


def test_requests_come_back_with_all_their_columns(spark, tmp_path):
    from pluvigrid.plans.train import run_trainer, score_with_saved_model

    folder, _ = catalog._processed(spark, SF)
    run_trainer(spark, folder, str(tmp_path / "m"), fold_column="hash", folds=2)
    asked = spark.createDataFrame(
        [(1, "Nation_3", "Asia", 40.0, "f", 7.0, ["x"]), (2, "Atlantis", "Asia", 40.0, "g", 8.0, None)],
        "request_id INT, district_name STRING, state_name STRING, june_rainfall_mm DOUBLE, features STRING, probability DOUBLE, `a b` ARRAY<STRING>",
    )
    rows = {r["request_id"]: r for r in score_with_saved_model(asked, folder, str(tmp_path / "m")).collect()}
    assert (rows[1]["features"], rows[1]["a b"], rows[2]["features"]) == ("f", ["x"], "g")
    assert 0 <= rows[1]["probability"] <= 100 and rows[2]["probability"] is None and rows[2]["error"]
