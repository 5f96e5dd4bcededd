"""Places in a global order, and what is built on them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pointweave.operators import positions, selection, solvers


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_places_are_those_of_a_sort(spark, n):
    values = list(range(n))
    random.Random(3).shuffle(values)
    rows = spark.createDataFrame([(None if v == 17 else v * v,) for v in values], "v long").repartition(7)
    got = positions.in_order(rows, ["v"], "place", 5).orderBy("place").collect()
    want = sorted((None if v == 17 else v * v for v in values), key=lambda v: (v is not None, v))
    assert [(r["v"], r["place"]) for r in got] == list(zip(want, range(n), strict=True))
    falling = positions.in_order(rows, [F.desc("v")], "place").where("place < 3").orderBy("place").collect()
    assert [r["v"] for r in falling] == want[::-1][:3]


@pytest.mark.parametrize("most", [1, 7, 1000, 4999, 6000])
def test_even_places(spark, most):
    n = 5000
    rows = spark.range(n).withColumnRenamed("id", "v").repartition(6)
    got = sorted(r["v"] for r in positions.evenly_placed(rows, ["v"], most).collect())
    assert got == (list(range(n)) if most >= n else [i * n // most for i in range(most)])


def test_no_window_lacks_a_partition(spark):
    g = spark.range(40).select(F.col("id").alias("log"))
    for plan in (selection.hash_ranked_split(g, "log", "v", {"a": 10, "b": 5}), positions.in_order(g, ["log"])):
        assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    parts = {r["part"]: r["count"] for r in selection.hash_ranked_split(g, "log", "v", {"a": 10, "b": 5}).groupBy("part").count().collect()}
    assert parts == {"a": 10, "b": 5}


def test_bootstrap_interval_against_its_closed_form(spark):
    r = random.Random(9)
    scenes = [(k, r.randint(0, 100), 100) for k in range(400)]
    rows = spark.createDataFrame(scenes, "scene long, hit long, n long")
    rates = solvers.resampled_rates(rows, ["scene"], "hit", "n", 5_000)
    low, middle, high = rates.select(F.percentile("rate", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))).first()[0]
    mean = sum(h for _, h, _ in scenes) / 40_000
    sd = math.sqrt(sum((h / 100 - mean) ** 2 for _, h, _ in scenes) / 400 / 400)
    assert abs(middle - mean) < 0.1 * sd
    assert abs(low - (mean - 1.96 * sd)) < 0.15 * sd and abs(high - (mean + 1.96 * sd)) < 0.15 * sd
    assert rates.count() == 5_000
    again = solvers.resampled_rates(rows.repartition(5), ["scene"], "hit", "n", 5_000)
    assert again.exceptAll(rates).count() == 0
