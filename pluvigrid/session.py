"""Session set-up and the shared folder for intermediate tables."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from pluvigrid.sources.files import remove


def _temporary_folder() -> str:
    """For a session on one machine only; removed with the process."""
    folder = tempfile.mkdtemp(prefix="pluvigrid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def local_session(cores: str = "*", **settings: str) -> SparkSession:
    """A single-machine session for tests and the benchmark, with a checkpoint folder of its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pluvigrid")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # Small data on one machine: merge less, so that all cores have work.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    if "spark.checkpoint.dir" not in settings:
        builder = builder.config("spark.checkpoint.dir", _temporary_folder())
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        # One machine without the setting, as in a notebook: there is nothing to share.
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = _temporary_folder()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def _application_folder(spark: SparkSession) -> str:
    return f"{_checkpoint_dir(spark)}/pluvigrid-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


_working: ContextVar[list[str] | None] = ContextVar("working", default=None)


def working_path(spark: SparkSession, name: str) -> str:
    """A ``shared_path`` that ends with the innermost ``working_tables`` around this call, if there is one."""
    path = shared_path(spark, name)
    if (paths := _working.get()) is not None:
        paths.append(path)
    return path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, executors can be lost."""
    path = path or working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut long lineage, so that later stages survive executor loss cheaply."""
    return stored(df, "lineage")


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that ``stored`` wrote inside it; frames that read them end there.

    A table at a path that was made outside stays.
    """
    paths: list[str] = []
    token = _working.set(paths)
    try:
        yield
    finally:
        _working.reset(token)
        for path in paths:
            remove(spark, path)


def own_session(spark: SparkSession) -> SparkSession:
    """Another session with the same settings on the same cluster; what it observes stays out of the caller's."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; frames that read them end here."""
    remove(spark, _application_folder(spark))
