"""The log odds of scores at and beyond both ends come back as their SQL says."""

import duckdb

from orrery.plans import catalogue


def test_scores_beyond_the_clamp(spark, tmp_path):
    duck = duckdb.connect()
    prices = ["0", "-5", "0.2", "1001.91", "249999.9", "249999.15", "250000", "250000.1", "499993.18", "499999.9", "500000", "612345.67", "NULL", "'nan'"]
    duck.execute("CREATE TABLE orders AS SELECT i AS o_orderkey, i AS o_custkey, TIMESTAMP '1999-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority, 'F' AS o_orderstatus, p AS o_totalprice FROM (VALUES " + ", ".join(f"({i}::BIGINT, {p}::DOUBLE)" for i, p in enumerate(prices)) + ") v(i, p)")
    duck.execute("CREATE TABLE lineitem AS SELECT 1::BIGINT AS l_orderkey, 'R' AS l_returnflag")
    duck.execute("CREATE TABLE customer AS SELECT 1::BIGINT AS c_custkey, 3 AS c_nationkey")
    for name in ("orders", "lineitem", "customer"):
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    want = duck.sql(f"SELECT * FROM ({catalogue.ORACLES['logit_round_trip']}) ORDER BY 1").fetchall()
    got = catalogue.QUERIES["logit_round_trip"](spark, str(tmp_path)).orderBy("inspection_id").collect()
    assert len(want) == len(prices) and [tuple(map(repr, r)) for r in got] == [tuple(map(repr, r)) for r in want]
