"""Versioned tables: commits, interrupted writes, concurrent writers, clean-up."""

import os

import pytest

from quarry.session import scratch_path
from quarry.sources import versions as V


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions_append_and_replace(spark):
    root = scratch_path(spark, "versions")
    assert V.read_version(spark, root) is None and V.manifest(spark, root)["version"] == 0
    assert V.write_version(spark.range(3), root) == 1
    assert V.write_version(spark.range(3, 5), root) == 2
    assert V.write_version(spark.range(9, 10), root, "overwrite") == 3
    assert [ids(V.read_version(spark, root, v)) for v in (1, 2, 3, None)] == [[0, 1, 2], [0, 1, 2, 3, 4], [9], [9]]
    assert [V.manifest(spark, root, v)["rows"] for v in (1, 2, 3)] == [3, 5, 1]
    with pytest.raises(ValueError):
        V.read_version(spark, root, 7)
    with pytest.raises(ValueError):
        V.write_version(spark.range(1), root, "merge")


def test_a_job_killed_before_its_commit_changes_nothing(spark):
    root = scratch_path(spark, "versions")
    V.write_version(spark.range(3), root)
    V.stage(spark.range(100, 200), root)  # the job dies here
    os.makedirs(f"{root}/data/half-written")
    with open(f"{root}/data/half-written/part-0.parquet", "wb") as f:
        f.write(b"PAR1 not a whole file")
    with open(f"{root}/manifest/_2-draft", "w") as f:  # or here, before the rename
        f.write('{"version": 2, "fol')
    assert ids(V.read_version(spark, root)) == [0, 1, 2]
    assert V.write_version(spark.range(3, 4), root) == 2
    assert ids(V.read_version(spark, root)) == [0, 1, 2, 3]


def test_one_of_two_writers_takes_a_version(spark):
    root = scratch_path(spark, "versions")
    V.write_version(spark.range(1), root)
    a, b = V.stage(spark.range(1, 2), root), V.stage(spark.range(2, 3), root)
    first = V.manifest(spark, root)["folders"]
    assert V.commit(spark, root, [*first, a], 2, 2) == 2
    with pytest.raises(V.ConcurrentCommit):
        V.commit(spark, root, [*first, b], 2, 2)
    assert V.manifest(spark, root)["folders"] == [*first, a] and ids(V.read_version(spark, root)) == [0, 1]


def test_vacuum_keeps_what_the_last_versions_hold(spark):
    root = scratch_path(spark, "versions")
    for k in range(3):
        V.write_version(spark.range(k, k + 1), root, "overwrite")
    V.write_version(spark.range(7, 8), root)
    V.stage(spark.range(50), root)
    assert len(V.vacuum(spark, root, keep=2)) == 3
    assert V.versions(spark, root) == [3, 4] and ids(V.read_version(spark, root)) == [2, 7] and ids(V.read_version(spark, root, 3)) == [2]


def test_new_columns_of_later_writes(spark):
    root = scratch_path(spark, "versions")
    V.write_version(spark.range(1), root)
    V.write_version(spark.range(1, 2).selectExpr("id", "'x' AS tag"), root)
    assert sorted(map(tuple, V.read_version(spark, root).collect())) == [(0, None), (1, "x")]
