"""Zeros that SQL writes with a sign have it here too."""

from __future__ import annotations

import duckdb
import numpy as np

from relaycast import plans


def test_block_means_that_round_to_zero_keep_their_sign(spark, tmp_path):
    values = {0: -1e-7, 1: 1e-7, 2: 0.0, 3: -0.0, 4: -0.25, 5: -5e-7, 6: -4.9e-7}
    spark.createDataFrame([(k, [v] * 64, 0) for k, v in values.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(f"SELECT vec_id, p FROM ({plans.ORACLE_SQL['block_downsample']}) ORDER BY vec_id").fetchall()
    got = {r.vec_id: r.p for r in plans.QUERIES["block_downsample"](spark, str(tmp_path)).collect()}
    for k, p in want:
        assert got[k] == p and (np.signbit(got[k]) == np.signbit(p)).all(), k
