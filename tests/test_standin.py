"""The stand-in tables do not hang on the order in which files hold their rows."""

import numpy as np
from pyspark.sql import functions as F

from repliphase.plans.standin import Tables


def test_means_are_summed_in_order(spark, tmp_path):
    """Means of 64 values with two decimals are often half-way between two of six decimals."""
    rng = np.random.default_rng(2)
    values = (rng.integers(1, 10_000, (300, 64)) / 100).tolist()
    rows = spark.createDataFrame([(64 * c + k, c, float(v)) for c, own in enumerate(values) for k, v in enumerate(own)], "event_id long, user_id long, value double")
    rows = rows.withColumns({"event_type": F.lit("click"), "ts": F.expr("timestamp_ntz'2024-01-05 00:00:00'")})
    rows.repartition(7, "value").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.cell: (r.n, r.v) for r in Tables(spark, str(tmp_path)).per_cell().collect()}
    for cell, own in enumerate(values):
        total = 0.0
        for v in own:
            total += v
        want = spark.range(1).select(F.round(F.lit(total / 64), 6)).first()[0] if cell < 40 else None
        assert found[cell][0] == 64 and (want is None or found[cell][1] == want)
    assert len(found) == 300
