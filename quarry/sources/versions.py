"""Versioned tables (S8, S9): a write is a new folder, a commit a manifest.

``root/data/<name>`` holds one write each, ``root/manifest/<n>`` the names that
make up version n, as JSON.  A manifest is written under another name and
renamed, so it is there as a whole or not at all; of two writers one takes a
number, where a rename doesn't replace a file (as in HDFS).  Readers take the folders of the last manifest: a job that
dies before its commit leaves the table as it was, and nothing that a reader has
listed is ever overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version that this one was about to write."""


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, ascending."""
    fs, at = _file_system(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """``{"version", "folders", "rows"}`` of a committed version, the last one by default; version 0 is the empty table."""
    known = versions(spark, root)
    if version is None:
        version = known[-1] if known else 0
    if not version:
        return {"version": 0, "folders": [], "rows": 0}
    if version not in known:
        raise ValueError(f"{root} has no version {version}")
    text = spark.read.text(f"{root}/manifest/{version}", wholetext=True).first()[0]
    return json.loads(text)


def stage(df: DataFrame, root: str) -> str:
    """Write ``df`` below the table's folder; it is no part of the table until it is committed.  Returns the folder's name."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{name}")
    return name


def commit(spark: SparkSession, root: str, folders: list[str], rows: int, version: int) -> int:
    """Make ``folders`` the table's content as ``version``; raises ``ConcurrentCommit`` if that version is there."""
    fs, to = _file_system(spark, f"{root}/manifest/{version}")
    _, draft = _file_system(spark, f"{root}/manifest/_{version}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "folders": folders, "rows": rows}).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(draft, to):
        fs.delete(draft, False)
        raise ConcurrentCommit(f"{root} has a version {version}")
    return version


def write_version(df: DataFrame, root: str, mode: str = "append") -> int:
    """Append to the table or replace its content; returns the new version."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    spark = df.sparkSession
    before = manifest(spark, root)
    name = stage(df, root)
    new = spark.read.parquet(f"{root}/data/{name}").count()  # of footers
    folders, rows = ([*before["folders"], name], before["rows"] + new) if mode == "append" else ([name], new)
    return commit(spark, root, folders, rows, before["version"] + 1)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The table as of a version, the last by default; None if nothing has been committed."""
    folders = manifest(spark, root, version)["folders"]
    if not folders:
        return None
    return spark.read.option("mergeSchema", True).parquet(*[f"{root}/data/{name}" for name in folders])


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete folders that none of the last ``keep`` versions holds, older manifests first; returns the folders' names.

    Run it when no write is under way: a folder that waits for its commit is deleted too.
    """
    known = versions(spark, root)
    held = {f for v in known[-keep:] for f in manifest(spark, root, v)["folders"]}
    fs, data = _file_system(spark, f"{root}/data")
    for v in known[:-keep]:
        fs.delete(_file_system(spark, f"{root}/manifest/{v}")[1], False)
    gone = [s.getPath().getName() for s in fs.listStatus(data) if s.getPath().getName() not in held]
    for name in gone:
        fs.delete(_file_system(spark, f"{root}/data/{name}")[1], True)
    return sorted(gone)
