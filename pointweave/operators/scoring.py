"""Scores under an abstention protocol: a prediction is a class, -2 (unmapped) or -1 (abstained); ground truth -1 is excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.quantiles import percentiles

UNMAPPED, ABSTAIN, EXCLUDED = -2, -1, -1


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, gt, pred, n over evaluated rows: the one aggregate that all scores below come from."""
    return rows.where(F.col("gt") != EXCLUDED).groupBy(*(by or []), "gt", "pred").agg(F.count("*").alias("n"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def class_scores(counts: DataFrame, classes: int, by: list[str] | None = None, strict: bool = True) -> DataFrame:
    """by, cls, tp, fn, fp, iou, accuracy of every class that occurs in the ground truth or the predictions.

    An unmapped prediction is a miss of its class and no one's false alarm; an abstention is a miss only if strict.
    """
    by = by or []
    n = F.col("n")
    hit = F.col("gt") == F.col("pred")
    missed = ~hit & (F.lit(strict) | (F.col("pred") != ABSTAIN))
    as_gt = counts.select(*by, F.col("gt").alias("cls"), F.when(hit, n).otherwise(0).alias("tp"), F.when(missed, n).otherwise(0).alias("fn"), F.lit(0).cast("long").alias("fp"))
    as_pred = counts.where(~hit & (F.col("pred") >= 0)).select(*by, F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"), n.alias("fp"))
    out = as_gt.unionByName(as_pred).where(F.col("cls") < classes).groupBy(*by, "cls").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp")))
    tp, fn, fp = (F.col(c) for c in ("tp", "fn", "fp"))
    return out.withColumns({"iou": _share(tp, tp + fn + fp), "accuracy": _share(tp, tp + fn)})


def summary(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, evaluated, answered, abstained, unmapped, correct, coverage, acc_answered, acc_strict."""
    n, pred = F.col("n"), F.col("pred")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    out = counts.groupBy(*(by or [])).agg(
        F.sum(n).alias("evaluated"), total(pred == ABSTAIN).alias("abstained"), total(pred == UNMAPPED).alias("unmapped"), total(F.col("gt") == pred).alias("correct")
    )
    answered = F.col("evaluated") - F.col("abstained")
    return out.withColumns({
        "answered": answered,
        "coverage": _share(answered, F.col("evaluated")),
        "acc_answered": _share(F.col("correct"), answered),
        "acc_strict": _share(F.col("correct"), F.col("evaluated")),
    })


def mean_iou(scores: DataFrame, classes: int, by: list[str] | None = None, fixed: bool = False) -> DataFrame:
    """by, miou (mean of present classes, or of all fixed classes), n_present. Shares are summed as integer micro-units."""
    micro = F.floor(F.col("iou") * 1_000_000 + 0.5).cast("long")
    present = F.sum(F.when(F.col("tp") + F.col("fn") > 0, 1).otherwise(0))
    used = F.lit(classes) if fixed else present
    total = F.sum(F.when((F.col("tp") + F.col("fn") > 0) | F.lit(fixed), micro).otherwise(0))
    return scores.groupBy(*(by or [])).agg(_share(total, used * 1_000_000).alias("miou"), present.alias("n_present"))


def majority(rows: DataFrame, key: str, label: str, classes: int) -> DataFrame:
    """key, label: the most frequent evaluated label of each key, the smallest on ties."""
    n = rows.where((F.col(label) >= 0) & (F.col(label) < classes)).groupBy(key, label).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col(label)).alias("low"))).alias("best")
    return n.groupBy(key).agg(best, F.sum("n").alias("total")).select(key, (-F.col("best.low")).cast("int").alias(label), F.col("best.n").alias("votes"), "total")


def paired(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of rows(gt, base, other): rescued, harmed, both right, wrong to another wrong, and the net."""
    gt, base, other = F.col("gt"), F.col("base"), F.col("other")
    return rows.where(gt != EXCLUDED).groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        F.count_if((base != gt) & (other == gt)).alias("rescued"),
        F.count_if((base == gt) & (other != gt)).alias("harmed"),
        F.count_if((base == gt) & (other == gt)).alias("both"),
        F.count_if((base != gt) & (other != gt) & (base != other)).alias("wrong_to_wrong"),
    ).withColumn("net", F.col("rescued") - F.col("harmed"))


def anatomy(rows: DataFrame, classes: int) -> DataFrame:
    """Where a voxel map's point errors come from, from rows(key, gt, pred of the voxel or -1).

    per key: mixed = points of other labels than the voxel's majority, wrong = points of a voxel whose prediction is not
    its majority, floor = points that are wrong for mixing alone, no_voxel. Their identity is checked in ``consistent``.
    """
    rows = rows.where((F.col("gt") >= 0) & (F.col("gt") < classes))
    major = majority(rows, "key", "gt", classes).select("key", F.col("gt").alias("major"))
    out = rows.join(major, "key")
    right, has = F.col("pred") == F.col("gt"), F.col("pred") >= 0
    return out.agg(
        F.count("*").alias("points"),
        F.count_if(~has).alias("no_voxel"),
        F.count_if(has & (F.col("gt") != F.col("major"))).alias("mixed"),
        F.count_if(has & (F.col("pred") != F.col("major"))).alias("voxel_wrong"),
        F.count_if(has & ~right & (F.col("pred") == F.col("major"))).alias("floor"),
        F.count_if(has & right).alias("right"),
        F.count_if(has & ~right).alias("wrong"),
    ).withColumn("consistent", F.col("points") == F.col("no_voxel") + F.col("right") + F.col("wrong"))


def removal_curve(voxels: DataFrame, thresholds: list[int]) -> DataFrame:
    """k, recall, false_kill, damage of withholding voxels(n_free, moving, weight) with n_free >= k, for every k."""
    ks = F.explode(F.array(*(F.lit(k) for k in thresholds))).alias("k")
    gone = F.col("n_free") >= F.col("k")
    w = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight"))), F.lit(0))
    out = voxels.select("*", ks).groupBy("k").agg(w(F.col("moving")).alias("moving"), w(~F.col("moving")).alias("static"), w(F.col("moving") & gone).alias("moving_gone"), w(~F.col("moving") & gone).alias("static_gone"))
    return out.withColumns({
        "recall": F.col("moving_gone") / F.greatest("moving", F.lit(1)),
        "false_kill": F.col("static_gone") / F.greatest("static", F.lit(1)),
        "damage": F.col("static_gone") / F.greatest("moving_gone", F.lit(1)),
    })


def funnel(rows: DataFrame, stages: list[str], by: list[str] | None = None) -> DataFrame:
    """by, stage_k..., lost_k...: rows that pass all stages up to each, and where the others were lost first."""
    passed, out, before = F.lit(True), {}, F.lit(True)
    for s in stages:
        passed = passed & F.coalesce(F.col(s), F.lit(False))
        out[f"upto_{s}"] = F.count_if(passed)
        out[f"lost_{s}"] = F.count_if(before & ~passed)
        before = passed
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total"), *(c.alias(k) for k, c in out.items()))


def spread(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sd (0 for one value), half_range over repeats."""
    v = F.col(value)
    return values.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), ((F.max(v) - F.min(v)) / 2).alias("half_range")
    )


def latency(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, exact p50, p95, p99, min, max; nulls and NaN are left out. Groups may have any size (see quantiles)."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "low": 0.0, "high": 1.0}
    return percentiles(values, by, value, shares)
