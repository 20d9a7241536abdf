"""Every query against its SQL at the smallest scale, and the entry point."""

import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import check  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.connection(DATA)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    told = check.compare(spark, db, DATA, name)
    assert told.split()[0] in ("ok", "rows"), told


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns[:3] == ["doc_id", "name", "length"]
    assert rows.count() > 0


@pytest.mark.parametrize(
    "name",
    ["src03_slice_by_manifest", "src10_snapshot_crc", "src10_snapshot_manifest", "flt01_checksum_gate", "flt01_checksum_flag", "flt06_detect_encoding", "fn01_read_integers"],
)
def test_empty_and_null_texts(spark, tmp_path, name):
    """No blob is cut by its length: empty and null texts are rows on both sides."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["first text of all, long enough to have fifty and more bytes in it", "", None, "x", "ab", "first text of all, long enough to have fifty and more bytes in it"]
    table = pa.table({"doc_id": pa.array(range(6), pa.int64()), "text": texts, "lang": ["en"] * 6, "source": ["s"] * 6, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    told = check.compare(spark, check.connection(str(tmp_path)), str(tmp_path), name)
    assert told.split()[0] == "ok", told
