"""Texts that `scan_npy` turns into payloads: empty ones, null, pairs of surrogates, and one that is many megabytes."""

import duckdb
import pyarrow as pa

from tessera.functions import text as texts
from tessera.plans.registry import ORACLES, QUERIES

GIVEN = ["", None, "a", "é", "日本", "😀", "a😀", "😀😀b", "", "￿", None, "x" * 3_000_000]


def test_scan_npy_of_odd_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(GIVEN)), "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, n_ids, first_char FROM ({ORACLES['scan_npy']})").fetchall()}
    assert {r["doc_id"]: (r["n_ids"], r["first_char"]) for r in QUERIES["scan_npy"](spark, str(tmp_path)).collect()} == want


def test_units_of_texts_in_slices():
    for a in range(len(GIVEN)):
        got = texts._units_of(pa.array(GIVEN).slice(a)).to_pylist()
        assert [None if u is None else b"".join(x.to_bytes(2, "little") for x in u).decode("utf-16-le") for u in got] == GIVEN[a:]
