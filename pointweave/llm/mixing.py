"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.shared import WORD, materialise, release, stable_hash

#: Bits of the document hash that one histogram level resolves, and the levels in all: 48 bits.
LEVEL_BITS = (12, 12, 12, 12)
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, numer, denom) from sizes(source, size): each source's target is numer / denom.

    Sources in code point order, null last, weigh ``weights``, repeating. They share the sum of all sizes; no target
    is above max_repeats times its source's size, and the excess goes to the others by weight. In the order of size
    over weight, sources are capped up to the first one whose share fits, which needs one running sum over the
    aggregated source table (a row per source), not a loop.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(w).cast("long") for w in weights))
    one = one.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ratio = F.col("source_size") / F.col("weight")
    before = W.orderBy(ratio, F.col("source").isNull(), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    one = one.withColumns({
        "total": F.sum("source_size").over(whole),
        "left_words": F.sum("source_size").over(whole) - F.coalesce(F.sum("source_size").over(before) * max_repeats, F.lit(0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    capped = F.col("source_size") * max_repeats * F.col("left_weight") < F.col("left_words") * F.col("weight")
    fits = F.struct("left_weight", "left_words")
    one = one.withColumn("level", F.max(F.when(~capped, fits)).over(whole))
    numer = F.when(capped, F.col("source_size") * max_repeats).otherwise(F.col("weight") * F.col("level.left_words"))
    denom = F.when(capped, F.lit(1)).otherwise(F.col("level.left_weight"))
    return one.select("source", "source_size", numer.cast("long").alias("numer"), denom.cast("long").alias("denom"))


def hash_threshold_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs plus size, source_size, target, copies, taken: how often the mix takes each document.

    A source takes every document floor(target / source_size) times, and once more those whose hash is below the
    source's threshold. The threshold comes from histograms: tokens are summed by source and hash bucket, the bucket
    in which the running sum passes the budget is found, and only that bucket is divided further, level by level
    (48 bits in all). At the last level the bucket that passes the budget is taken if that comes nearer to it.
    Documents are never sorted. Ties (repeated doc_id) go in or out together; reruns agree, as the hash is that of
    doc_id. Null texts and empty texts have size 0; a null source is a source of its own; a null doc_id hashes like
    an empty string. Further columns pass through; own columns replace columns of the same name.
    """
    sized = docs.withColumns({"size": n_words(F.col("text")), "mix_hash": stable_hash(F.col("doc_id"), sum(LEVEL_BITS))})
    slim = materialise(sized.select("source", "size", "mix_hash"), "sizes")
    targets = source_targets(slim, weights, max_repeats)
    per_source = F.col("denom") * F.col("source_size")
    targets = targets.withColumns({
        "base": F.when(F.col("source_size") > 0, F.floor(F.col("numer") / per_source)).otherwise(F.lit(0)).cast("long"),
    }).withColumn("base", F.least("base", F.lit(max_repeats)))
    rest = (F.col("numer") - F.col("base") * per_source) / F.col("denom")
    state = materialise(targets.select("source", "source_size", "numer", "denom", "base", rest.alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), "targets")

    left, whole = sum(LEVEL_BITS), F.lit(1 << sum(LEVEL_BITS)).cast("long")
    for bits in LEVEL_BITS:
        at = state.select(F.col("source").alias("s"), "prefix", "below", "budget")
        span, step = F.lit((1 << left) - 1).cast("long"), F.lit(1 << (left - bits)).cast("long")
        inside = F.col("mix_hash").between(F.col("prefix"), F.col("prefix") + span)
        found = slim.join(at, slim.source.eqNullSafe(at.s)).where(inside).select("source", "size", "mix_hash")
        start = (F.col("mix_hash") - F.pmod(F.col("mix_hash"), step)).alias("bin")
        bins = found.groupBy("source", start).agg(F.sum("size").alias("n"))
        running = F.sum("n").over(W.partitionBy("source").orderBy("bin"))
        bins = bins.join(at, bins.source.eqNullSafe(at.s)).withColumn("upto", F.col("below") + running)
        over = F.when(F.col("upto") > F.col("budget"), F.struct("bin", (F.col("upto") - F.col("n")).alias("under"), "upto"))
        edge = bins.groupBy("source").agg(F.min(over).alias("edge")).select(F.col("source").alias("s"), "edge")
        left -= bits
        nearer = (F.col("edge.upto") - F.col("budget")) < (F.col("budget") - F.col("edge.under"))
        last_step = F.when(nearer, F.lit(1)).otherwise(F.lit(0)) if not left else F.lit(0)
        kept = state.join(edge, state.source.eqNullSafe(edge.s), "left").select(
            "source", "source_size", "numer", "denom", "base", "budget",
            F.coalesce(F.col("edge.bin") + last_step, whole).alias("prefix"),
            F.coalesce(F.col("edge.under"), F.col("below")).alias("below"),
        )
        before, state = state, materialise(kept, "targets")
        release(before)

    release(slim)
    last = state.select(F.col("source").alias("s"), "source_size", (F.col("numer") / F.col("denom")).alias("target"), "base", "prefix")
    own = [c for c in ("source_size", "target", "copies", "taken", "s", "base", "prefix") if c in docs.columns]
    out = sized.drop(*own).join(last, sized.source.eqNullSafe(last.s), "left")
    copies = F.coalesce(F.col("base") + (F.col("mix_hash") < F.col("prefix")).cast("long"), F.lit(0)).cast("long")
    copies = F.least(copies, F.lit(max_repeats).cast("long"))
    return out.withColumns({"copies": copies, "taken": copies * F.col("size")}).drop("s", "base", "prefix", "mix_hash")
