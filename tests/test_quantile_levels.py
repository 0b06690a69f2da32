"""No level is lost between a bin's sum and the sum before the next."""

import numpy as np
from tessera.operators import distribution as D


def test_every_row_has_every_level(spark):
    rng, levels = np.random.RandomState(0), [0.05, 0.25, 0.5, 0.75, 0.95]
    rows = [(i, b, float((k + 0.01) / (c.sum() + 0.1))) for i in range(6000) for c in [rng.randint(0, 12, 10)] for b, k in enumerate(c.tolist())]
    bins = spark.createDataFrame([(b, float(b), b + 1.0) for b in range(10)], "bin int, lo double, hi double")
    got = D.quantiles(spark.createDataFrame(rows, "row_id long, bin int, p double"), bins, levels)
    assert got.count() == 6000 * len(levels) and got.distinct().count() == 6000 * len(levels)
