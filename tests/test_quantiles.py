"""Exact percentiles by refined histograms against sorted values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import quantiles

SHARES = {"low": 0.0, "a": 0.05, "b": 0.5, "c": 0.99, "high": 1.0}


@pytest.mark.parametrize("sent", [0, 100_000])
def test_percentiles_equal_those_of_sorted_values(spark, monkeypatch, sent):
    monkeypatch.setattr(quantiles, "MOST_SENT", sent)
    r = random.Random(sent)
    groups = {
        "many": [r.gauss(0, 1) for _ in range(5000)], "one": [3.5], "two": [1.0, 2.0], "same": [7.25] * 400, "ties": [float(r.randint(0, 3)) for _ in range(999)],
        "wide": [r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300) for _ in range(800)], "ends": [1.7e308, -1.7e308, 0.0, 5e-324, -0.0], None: [1.0, 4.0, 2.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("many", None), ("many", math.nan), ("none", None)]
    got = {x["g"]: x for x in quantiles.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", SHARES).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, p in SHARES.items():
            s, at = sorted(values), p * (len(values) - 1)
            lo, hi = math.floor(at), math.ceil(at)
            want = s[lo] if lo == hi else (hi - at) * s[lo] + (at - lo) * s[hi]
            assert got[g][name] == pytest.approx(want, rel=1e-12, abs=0.0)


def test_one_group_of_millions_of_values(spark):
    """3 million distinct values of one group: no task holds more of them than a batch, whatever the heap."""
    rows = spark.range(3_000_000).select((F.pmod(F.col("id") * 7919, F.lit(3_000_000)) / 7.0).alias("v"))
    got = quantiles.percentiles(rows, [], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert got["n"] == 3_000_000
    assert np.allclose([got["p50"], got["p95"]], [np.percentile(np.arange(3_000_000) / 7.0, q) for q in (50, 95)], rtol=1e-12)
