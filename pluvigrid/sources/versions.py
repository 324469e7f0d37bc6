"""Folders whose content changes in one step.

A job writes everything to a new folder below ``versions`` and then publishes it: it claims the
next number in ``commits`` and puts a file of that number there, which names the folder. The
file appears whole or not at all, by a rename. Readers take the highest number. A job that
dies before that leaves the content of the last commit as it was.
"""

import uuid

from pyspark.sql import SparkSession

from pluvigrid.sources.files import claim, exists, list_files, put_line, read_line, remove, subfolders

COMMIT, CLAIM = ".commit", ".claim"


def _log(folder: str) -> str:
    return f"{folder.rstrip('/')}/commits"


def _versions(folder: str) -> str:
    return f"{folder.rstrip('/')}/versions"


def _commits(spark: SparkSession, folder: str) -> list[str]:
    return list_files(spark, _log(folder), COMMIT)


def staged(folder: str) -> str:
    """A fresh folder for the next version."""
    return f"{_versions(folder)}/{uuid.uuid4().hex}"


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder that readers use now, or None before the first commit."""
    commits = _commits(spark, folder)
    return f"{_versions(folder)}/{read_line(spark, commits[-1])}" if commits else None


def location(spark: SparkSession, folder: str) -> str:
    """Where the tables of ``folder`` are: its current version, or itself if it never had one."""
    return current(spark, folder) or folder


def publish(spark: SparkSession, folder: str, version: str) -> int:
    """Let readers use ``version``, a folder from :func:`staged`; returns the commit's number."""
    taken = list_files(spark, _log(folder), CLAIM)
    number = int(taken[-1].rsplit("/", 1)[1].removesuffix(CLAIM)) + 1 if taken else 1
    while not claim(spark, f"{_log(folder)}/{number:012d}{CLAIM}"):
        number += 1
    put_line(spark, f"{_log(folder)}/{number:012d}{COMMIT}", version.rsplit("/", 1)[1])
    return number


def prune(spark: SparkSession, folder: str, keep: int = 2, abandoned: bool = False) -> list[str]:
    """Remove all but the last ``keep`` published versions; returns the names of those removed.

    ``abandoned`` also removes versions that were never published: what dead jobs left, but also
    what a running one is writing. A reader of a removed version fails.
    """
    if not exists(spark, _versions(folder)):
        return []
    published = [read_line(spark, commit) for commit in _commits(spark, folder)]
    kept = set(published[-keep:])
    there = subfolders(spark, _versions(folder))
    gone = [name for name in there if name not in kept and (abandoned or name in published)]
    for name in gone:
        remove(spark, f"{_versions(folder)}/{name}")
    return gone
