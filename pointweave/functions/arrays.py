"""Posteriors and features as arrays of doubles: softmax, argmax, margins, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def softmax(logits: Column) -> Column:
    """Shifted by the largest logit first."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / total(shifted))


def argmax(a: Column) -> Column:
    """Place of the largest value from 0, the first on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def margin(a: Column) -> Column:
    """Largest minus second largest value."""
    ordered = F.sort_array(a, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def blend(a: Column, b: Column, share: Column | float) -> Column:
    """(1 - share) a + share b."""
    w = F.lit(share) if isinstance(share, float) else share
    return F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y)


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x / total(a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def hellinger(a: Column, b: Column) -> Column:
    """Distance of two histograms from their Bhattacharyya coefficient."""
    return F.sqrt(F.greatest(1 - total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y))), F.lit(0.0)))


def kl_divergence(p: Column, q: Column, least: float = 1e-12) -> Column:
    floor = lambda x: F.greatest(x, F.lit(least))
    return total(F.zip_with(p, q, lambda x, y: x * (F.log(floor(x)) - F.log(floor(y)))))


def cross_entropy(p: Column, label: Column) -> Column:
    return -F.log(F.greatest(F.get(p, label), F.lit(1e-12)))


def marginal(p: Column, groups: list[list[int]]) -> Column:
    """Sums of groups of entries; entries in no group are lost, so the result may sum to less than 1."""

    def group_sum(places: list[int]) -> Column:
        out = F.get(p, F.lit(places[0]))
        for k in places[1:]:
            out = out + F.get(p, F.lit(k))
        return out

    return F.array(*(group_sum(g) for g in groups))
