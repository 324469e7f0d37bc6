"""File listing through Hadoop's file system API, on any storage Spark can read."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this process wrote itself."""
    fs, target = _path(spark, path)
    fs.delete(target, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    fs, target = _path(spark, path)
    return fs.getContentSummary(target).getLength()


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths of the files directly in ``folder`` with that suffix, sorted by name."""
    fs, target = _path(spark, folder)
    if not fs.exists(target):
        return []
    found = [status.getPath() for status in fs.listStatus(target) if status.isFile()]
    return sorted(str(p.toString()) for p in found if p.getName().endswith(suffix))


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders directly in ``folder``."""
    fs, target = _path(spark, folder)
    return [str(s.getPath().getName()) for s in fs.listStatus(target) if s.isDirectory()]


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if there is one already. Of several processes one succeeds."""
    fs, target = _path(spark, path)
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if fs.exists(target):
            return False
        raise error
    return True


def put_line(spark: SparkSession, path: str, line: str) -> None:
    """A one-line file that appears whole: written under another name and renamed."""
    fs, target = _path(spark, path)
    _, written = _path(spark, f"{path}.tmp")
    stream = fs.create(written, True)
    stream.write(bytearray(line + "\n", "utf-8"))
    stream.close()
    if not fs.rename(written, target):
        raise OSError(f"could not put {path!r} in place")


def read_line(spark: SparkSession, path: str) -> str:
    """The first line of a small file that this package wrote."""
    fs, target = _path(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(target), "UTF-8"))
    try:
        return reader.readLine() or ""
    finally:
        reader.close()
