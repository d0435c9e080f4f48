"""Order statistics by counting against sorted lists."""

import random

from pyspark.sql import functions as F

from tidemill.operators import percentiles


def test_ranks_against_sorted_values(spark):
    rng = random.Random(8)
    rows = [("one", rng.randint(-(2**45), 2**45)) for _ in range(3000)] + [("same", 7)] * 500 + [(None, k) for k in range(9)] + [("none", None)] * 3 + [("alone", -(2**60))] + [("ties", rng.randint(0, 3)) for _ in range(101)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    n = F.col("n")
    got = {r.k: r for r in percentiles.exact_ranks(df, ["k"], "v", {**percentiles.middle(n), "p95": percentiles.nearest(0.95, n), "tenth": F.lit(10)}).collect()}
    for k in {r[0] for r in rows}:
        values = sorted(v for key, v in rows if key == k and v is not None)
        if not values:
            assert k not in got
            continue
        r, m = got[k], len(values)
        assert (r.n, r.low, r.high) == (m, values[(m - 1) // 2], values[m // 2]) and r.p95 == values[max(0, -(-95 * m // 100) - 1)]
        assert r.tenth == (values[10] if m > 10 else None)
    whole = percentiles.exact_ranks(df, [], "v", percentiles.middle(n)).first()
    values = sorted(v for _, v in rows if v is not None)
    assert (whole.n, whole.low, whole.high) == (len(values), values[(len(values) - 1) // 2], values[len(values) // 2])
    assert percentiles.exact_ranks(df.limit(0), [], "v", percentiles.middle(n)).count() in (0, 1)
