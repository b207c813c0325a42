"""Reports whose last digit depends on the order of a sum."""

import duckdb

from tessera.plans.registry import ORACLES, QUERIES


def test_means_add_up_in_the_order_of_events(spark, tmp_path):
    """Values of one run in two files: their partial sums would give another mean than the order of the events does."""
    rows = [(0, 7, 1e16), (1, 7, 1.0), (2, 7, -1e16), (3, 7, 5.0), (4, 8, 2.0), (5, 8, None), (6, 9, None), (7, 0, 50.0)]
    at = str(tmp_path / "events.parquet")
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[0] % 2 == k], "event_id long, user_id long, value double").coalesce(1).write.mode("append").parquet(at)
    got = {r["name"]: (r["val_loss"], r["params"]) for r in QUERIES["ablation_report"](spark, str(tmp_path)).collect()}
    assert got == {"run-7": (0.0125, 4000), "run-8": (0.02, 2000), "run-9": (None, 1000), "baseline": (0.5, 1000)}


def test_ties_round_as_sql_does(spark, tmp_path):
    """Means halfway between two rounded values, of all sizes of groups."""
    rows = [(i, u, ((i * 7919 + u) % 30_000) / 100) for i, u in enumerate(u for _ in range(64) for u in range(1, 400))]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    want = {r[0]: r[1:] for r in con.sql(f"SELECT name, place, val_loss, val_ppl, delta FROM ({ORACLES['ablation_report']})").fetchall()}
    assert {r["name"]: (r["place"], r["val_loss"], r["val_ppl"], r["delta"]) for r in QUERIES["ablation_report"](spark, str(tmp_path)).collect()} == want
