"""Real files: lists, lines, assets by folder, and the snapshot that is written once."""

import pytest
from pyspark.sql import functions as F

from blobloom.sources import blobs


@pytest.fixture
def lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 5, "é"), (1, 2, "b")], "k int, n int, t string")
    path = str(tmp_path / "lines")
    blobs.write_lines(df, "k", ["n"], F.concat("t", F.lit("!")), path)
    return path


def test_lines_are_files(spark, lines):
    files = blobs.read_blobs(spark, lines, "*.txt", min_length=5).collect()
    assert [(r["path"].split("k=")[1][0], r["length"], bytes(r["content"])) for r in files] == [("1", 9, b"a!\nb!\nc!\n")]
    assert sorted(bytes(r["content"]) for r in blobs.read_blobs(spark, lines, "*.txt").collect()) == [b"a!\nb!\nc!\n", "é!\n".encode()]


def test_listing_reads_no_content(spark, lines):
    listed = blobs.list_files(spark, lines, "*.txt")
    assert sorted(r["length"] for r in listed.collect()) == [4, 9]
    assert all(r["name"] == r["path"].split("/")[-1] for r in listed.collect())
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]
    assert blobs.list_files(spark, lines, "*.bin").collect() == []


def test_assets_by_folder(spark, tmp_path):
    rows = [("a", "x", bytearray(b"1")), ("b", "y", bytearray(b"")), ("b", "z", None)]
    assets = spark.createDataFrame(rows, "folder string, name string, bytes binary")
    path = str(tmp_path / "assets")
    blobs.write_assets(assets, "folder", path)
    back = blobs.read_assets(spark, assets.schema, "folder", path)
    assert sorted((r["folder"], r["name"], r["bytes"]) for r in back.collect()) == sorted((f, n, b) for f, n, b in rows)
    one = blobs.read_assets(spark, assets.schema, "folder", path, ["a"])
    assert [r["name"] for r in one.collect()] == ["x"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: [")[1].split("]")[0]


def manifest(spark, rows):
    return spark.createDataFrame(rows, "name string, crc bigint")


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshot_is_written_once(spark, tmp_path):
    path = str(tmp_path / "snap")
    first = manifest(spark, [("a", 1), ("b", 2), ("c", 3)])
    assert told(blobs.snapshot_once(first, "name", "crc", path)) == [("a", 1, 1, "written"), ("b", 2, 2, "written"), ("c", 3, 3, "written")]
    later = manifest(spark, [("a", 1), ("b", 9), ("d", 4)])
    for _ in range(2):  # comparing does not change it
        assert sorted(r["status"] for r in blobs.snapshot_once(later, "name", "crc", path).collect()) == ["mismatch", "missing", "ok"]
    assert [r["status"] for r in blobs.snapshot_once(first, "name", "crc", path).collect()] == ["ok"] * 3


def test_another_caller_was_first(spark, tmp_path, monkeypatch):
    """Both see no snapshot; the other one creates it while this one still writes its manifest."""
    path = str(tmp_path / "snap")
    mine, other = manifest(spark, [("a", 1), ("b", 2)]), manifest(spark, [("a", 1), ("b", 7)])
    real, done = type(mine).write, []

    def write(self):
        if not done:
            done.append(True)
            assert [r["status"] for r in blobs.snapshot_once(other, "name", "crc", path).collect()] == ["written"] * 2
        return real.fget(self)

    monkeypatch.setattr(type(mine), "write", property(write))
    assert told(blobs.snapshot_once(mine, "name", "crc", path)) == [("a", 1, 1, "ok"), ("b", 7, 2, "mismatch")]


def test_snapshot_of_nothing(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert blobs.snapshot_once(manifest(spark, []), "name", "crc", path).collect() == []
    assert blobs.snapshot_once(manifest(spark, [("a", 1)]), "name", "crc", path).collect() == []
