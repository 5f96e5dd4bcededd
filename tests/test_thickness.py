"""Column thickness where a height lies on a limit of its band, against DuckDB's percentiles."""

import math

import duckdb
import pandas as pd

from pointweave.operators.solvers import ground_thickness


def on_a_limit():
    """(n, low, high) of columns whose two percentile formulas round to other sides of a limit that a height lies on."""
    out = []
    for n in range(7, 400):
        at = (n - 1) * 0.05
        f, c = math.floor(at), math.ceil(at)
        for low in range(-2400, 2500, 100):
            for gap in (400, 500, 600, 750, 1000, 1200, 1500, 2000, 3000):
                high = low + gap
                a, b = (c - at) * low + (at - f) * high, math.fma(low, 1 - (at - f), high * (at - f))
                if f < c and high <= 2500 and ((low >= a - 300) != (low >= b - 300) or (high <= a + 1500) != (high <= b + 1500)):
                    out.append((n, low, high))
    return out


def test_a_height_on_the_limit_is_judged_as_by_sql(spark):
    rows = []
    for k, (n, low, high) in enumerate(on_a_limit()):
        below = math.floor((n - 1) * 0.05) + 1
        rows += [(k * 4000, 0, low)] * below + [(k * 4000, 0, high)] * (n - below - 1) + [(k * 4000, 0, high + 100)]
    points = pd.DataFrame(rows, columns=["x_mm", "y_mm", "z_mm"])
    assert len(points)
    want = duckdb.sql("""WITH c AS (SELECT x_mm // 4000 AS gx, 0 AS gy, z_mm FROM points), l AS (SELECT gx, quantile_cont(z_mm, 0.05) AS low FROM c GROUP BY ALL),
      b AS (SELECT gx, z_mm FROM c JOIN l USING (gx) WHERE z_mm BETWEEN low - 300 AND low + 1500), m AS (SELECT gx, median(z_mm) AS mid FROM b GROUP BY ALL)
      SELECT gx, count(*) AS n, 1.4826 * median(abs(z_mm - mid)) AS thickness FROM b JOIN m USING (gx) GROUP BY ALL""").fetchall()
    got = ground_thickness(spark.createDataFrame(points), 4000, 5, 300, 1500).select("gx", "n", "thickness").collect()
    assert sorted(map(tuple, got)) == sorted(want)
