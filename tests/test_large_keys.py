"""Queries whose stand-in texts are made of keys, on keys that the smallest tables don't reach."""

import duckdb
from ledgerloom.plans import QUERIES, SQL


def test_history_exhaustion(spark, tmp_path):
    keys = [0, 4, 5, 6, 10, 32538, 32539, 32540, 32554, 32555, 32556, *range(32567, 32574), 40000, 99999, 100000, 899999]
    orders = [(7 * i + c, k) for c in range(7) for i, k in enumerate(keys)] + [(9_000_000 + c, 800_000) for c in range(7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.execute(f"create view orders as select * from read_parquet(['{tmp_path}/orders.parquet/*.parquet'])")
    got = {r["id"]: r["reason"] for r in QUERIES["i3_history_exhaustion"](spark, str(tmp_path)).collect()}
    assert len(got) == len(orders) and got == dict(db.execute(SQL["i3_history_exhaustion"]).fetchall())
