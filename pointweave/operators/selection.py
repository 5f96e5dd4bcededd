"""Selections and set operations: top-k, even and weighted samples, hash-ranked groups, disjoint splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.positions import in_order


def top(rows: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group in an order."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def top_per_count(rows: DataFrame, by: list[str], order: list[Column | str], counts: DataFrame) -> DataFrame:
    """The first counts.k rows of each group, k differing by group."""
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return placed.join(counts, by).where(F.col("_place") <= F.col("k")).drop("_place", "k")


def evenly(rows: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows per group, at the places i * n / most rounded down; groups of no more rows stay whole."""
    w = W.partitionBy(*by)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # Place p is chosen if some j < most has floor(j n / most) = p, that is if the first j not below it does.
    j = F.ceil(F.col("_i") * most / F.col("_n")).cast("long")
    chosen = (j < most) & (F.floor(j * F.col("_n") / most) == F.col("_i"))
    return placed.where((F.col("_n") <= most) | chosen).drop("_i", "_n")


def priority(*parts: Column | str, salt: str) -> Column:
    """A reproducible priority of a row: a hash of a salt and its identifying columns."""
    return F.md5(F.concat_ws("|", F.lit(salt), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))


def hash_ranked_split(groups: DataFrame, name: str, salt: str, sizes: dict[str, int]) -> DataFrame:
    """name, part: groups in the order of sha256(salt + name), dealt to disjoint parts of the given sizes; others get none."""
    ranked = in_order(groups.select(name).distinct(), [F.sha2(F.concat(F.lit(salt), F.col(name).cast("string")), 256)], "_place")
    part, upto = F.lit(None).cast("string"), 0
    bounds = []
    for label, size in sizes.items():
        bounds.append((label, upto, upto + size))
        upto += size
    for label, lo, hi in reversed(bounds):
        part = F.when((F.col("_place") >= lo) & (F.col("_place") < hi), F.lit(label)).otherwise(part)
    return ranked.withColumn("part", part).where("part IS NOT NULL").drop("_place")


def weighted_resample(rows: DataFrame, by: list[str], order: str, weight: str, draws: DataFrame) -> DataFrame:
    """Draws with replacement: draw (by, draw, u in 0..1) takes the row whose span of running weight holds u * total.

    Spans are joined by range within the group; each group's rows are cut into as many equal buckets of weight as the
    group's integer total allows, so the join has an equality on the bucket.
    """
    w = W.partitionBy(*by)
    spans = rows.withColumn("_hi", F.sum(weight).over(w.orderBy(order))).withColumn("_lo", F.col("_hi") - F.col(weight)).withColumn("_total", F.sum(weight).over(w))
    spans = spans.where(F.col(weight) > 0).withColumn("_step", F.ceil(F.col("_total") / 64).cast("long"))
    totals = spans.select(*by, "_total", "_step").distinct()
    at = draws.join(totals, by).withColumn("_at", F.least(F.floor(F.col("u") * F.col("_total")), F.col("_total") - 1).cast("long"))
    at = at.withColumn("_bucket", F.floor(F.col("_at") / F.col("_step")).cast("long")).drop("_total", "_step")
    bucket = F.explode(F.sequence(F.floor(F.col("_lo") / F.col("_step")).cast("long"), F.floor((F.col("_hi") - 1) / F.col("_step")).cast("long")))
    spans = spans.withColumn("_bucket", bucket).drop("_total", "_step")
    return at.join(spans, [*by, "_bucket"]).where("_lo <= _at AND _at < _hi").drop("_lo", "_hi", "_at", "_bucket")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: in_a, in_b, shared, either, share of two key sets. One aggregate of a tagged union instead of two joins."""
    tagged = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    one = tagged.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = one.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("in_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("in_b"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("shared"), F.count("*").alias("either"))
    return out.withColumn("share", F.col("shared") / F.greatest("either", F.lit(1)))


def merged_counts(parts: list[DataFrame], by: list[str], value: str) -> DataFrame:
    """Accumulators of the same shape added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by).agg(F.sum(value).alias(value))


def prefix_holds(old: DataFrame, new: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """by, holds: whether the old sequence is a prefix of the new one."""
    both = old.select(*by, place, F.col(value).alias("_old")).join(new.select(*by, place, F.col(value).alias("_new")), [*by, place], "left")
    return both.groupBy(*by).agg(F.bool_and(F.col("_old").eqNullSafe(F.col("_new"))).alias("holds"))
