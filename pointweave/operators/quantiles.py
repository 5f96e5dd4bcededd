"""Exact percentiles of groups of any size: histograms whose bin around each wanted rank is refined until it holds one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.tables import release, stored

#: Bins of a round, and ranks up to which they are sent to every task; of more, the join shuffles.
BINS, MOST_SENT = 1_024, 100_000


def _magnitude(v: Column) -> Column:
    """A value's sign times the log of its size, which is over -745, on a scale where zero is between both signs."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.when(v != 0, F.abs(v))) + 750))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n and for each of ``shares`` (name: share) its exact percentile, linear between neighbouring ranks.

    A percentile lies between two ranks. Each round counts the values between the bounds of a rank by bins of equal
    width (of the logarithm, where the bounds are of different size), map-side, takes the bin that the rank falls into, and bounds it by the least and greatest value there; ranks
    whose bounds agree are done. So no task holds a group's values, only BINS counts a rank, and a round reads what the
    last bounds leave over. Values are compared as doubles. Nulls and NaN are left out; a group of only such has no row. Null
    keys are a group.
    """
    v = F.col(value).cast("double")
    base = stored(rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v")), "values")
    ends = base.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    at = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(p)), F.ceil(at(p))) for p in shares.values()))))
    ranks = stored(ends.withColumn("rank", F.explode(wanted)).withColumn("below", F.lit(0).cast("long")), "ranks")
    done = []
    while True:
        done.append(ranks.where("lo = hi"))
        left = ranks.where("lo < hi")
        if not left.head(1):
            break
        sent = F.broadcast(left) if left.count() <= MOST_SENT else left
        same = [base[c].eqNullSafe(sent[c]) for c in by]
        met = (base.join(sent, same) if by else base.crossJoin(sent)).where("_v BETWEEN lo AND hi").select(*(sent[c] for c in by), "n", "rank", "below", "lo", "hi", "_v")
        # Halves, so that the width of the widest bounds is still a number; that of the narrowest may be none.
        width = F.col("hi") / 2 - F.col("lo") / 2
        narrow = F.when(width > 0, (F.col("_v") / 2 - F.col("lo") / 2) / F.when(width > 0, width)).otherwise(F.when(F.col("_v") > F.col("lo"), 1.0).otherwise(0.0))
        span = _magnitude(F.col("hi")) - _magnitude(F.col("lo"))
        place = F.when(span > 1, (_magnitude(F.col("_v")) - _magnitude(F.col("lo"))) / F.when(span > 1, span)).otherwise(narrow)
        own = [*by, "n", "rank", "below"]
        bins = met.groupBy(*own, F.least(F.floor(place * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("c").over(W.partitionBy(*by, "rank").orderBy("bin")) + F.col("below")
        hit = bins.withColumn("upto", upto).where("upto > rank AND upto - c <= rank")
        ranks = stored(hit.select(*by, "n", "lo", "hi", "rank", (F.col("upto") - F.col("c")).alias("below")), "ranks")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    at_rank = F.map_from_entries(F.collect_list(F.struct("rank", "lo")))
    found = stored(found.groupBy(*by, "n").agg(at_rank.alias("_at")), "percentiles")
    release(base)
    get = lambda rank: F.element_at("_at", rank)
    between = {name: F.when(F.floor(at(p)) == F.ceil(at(p)), get(F.floor(at(p)))).otherwise((F.ceil(at(p)) - at(p)) * get(F.floor(at(p))) + (at(p) - F.floor(at(p))) * get(F.ceil(at(p)))) for name, p in shares.items()}
    return found.select(*by, "n", *(c.alias(name) for name, c in between.items()))
