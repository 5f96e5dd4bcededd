"""Quality rules: text statistics and robust multivariate outliers by minimum covariance determinant.

Native: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.shared import GAP, materialise, release

#: Standard deviations that are added to a group's own: mean word length (log), symbol share (root), share of
#: repeated lines, share of repeated words. They keep a feature that hardly varies in a group from rejecting it all.
FLOORS = (0.07, 0.04, 0.15, 0.1)
FEATURES = ("x1", "x2", "x3", "x4")
LOWER = [(k, j) for k in range(1, 5) for j in range(1, k + 1)]
#: The numbers of an estimate: means and the Cholesky factor of the covariance.
ESTIMATE = (*(f"m{k}" for k in range(1, 5)), *(f"l{k}{j}" for k, j in LOWER))
POOLED = "pooled"
#: Groups whose estimates are broadcast, 15 numbers each; the rows of more groups are dealt by group and SALTS parts.
MOST_BROADCAST, SALTS = 20_000, 32


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blank_out(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_words(words: Column) -> Column:
    """Words within 3-word windows found at least twice.

    Windows are hashed to 64 bits. Where some repeat, (hash, place) pairs are sorted so that equal windows are
    neighbours; each marked window covers the words up to the next marked one, three at most.
    """
    grams = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def marked(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        hits = _bind(by_hash, lambda s: F.filter(s, lambda x, k: (same(s, x, k + 1)) | ((k > 0) & same(s, x, k - 1))))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    return _bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_bind(marked(g), covered)))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the long statistics n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    n_lines counts lines with a word. Everything stays within the document's row; nothing is shuffled. A null text
    has no words, lines or symbols.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    blank = " \t\n\x0b\x0c\r"
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(_blank_out(line, blank)) > 0)
    with_lists = docs.select("doc_id", "lang", "source", text.alias("text"))
    return with_lists.select(
        "doc_id",
        "lang",
        "source",
        F.length(_blank_out(F.col("text"), blank)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_blank_out(F.col("text"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).cast("long").alias("repeated"))).alias("w"),
        _bind(lines, lambda s: F.struct(F.size(s).cast("long").alias("n"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("repeated"))).alias("l"),
    ).select(
        "doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.repeated").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words")
    )


def _chi2_4(x: float) -> float:
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def chi2_4_quantile(p: float) -> float:
    """The p-quantile of the chi-square distribution with four degrees of freedom, one for each feature."""
    lo, hi = 0.0, 500.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_4(mid) < p else (lo, mid)
    return lo


def _consistency(share: float) -> float:
    """By how much the covariance of the central share of normal data falls short of the whole's."""
    x = chi2_4_quantile(share)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def _distance(df: DataFrame) -> DataFrame:
    """df, which holds features and estimates, plus the squared Mahalanobis distance d2, by forward substitution."""
    for k in range(1, 5):
        z = F.col(f"x{k}") - F.col(f"m{k}")
        for j in range(1, k):
            z = z - F.col(f"l{k}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{k}", z / F.col(f"l{k}{k}"))
    return df.withColumn("d2", sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(2, 5)), F.col("z1") * F.col("z1")))


def _cholesky(df: DataFrame) -> DataFrame:
    """df plus the Cholesky factor l of its matrix v; pivots are at least half a floor."""
    for k, j in LOWER:
        rest = F.col(f"v{k}{j}")
        for i in range(1, j):
            rest = rest - F.col(f"l{k}{i}") * F.col(f"l{j}{i}")
        df = df.withColumn(f"l{k}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[k - 1] ** 2 / 4))) if j == k else rest / F.col(f"l{j}{j}"))
    return df


def _sums(names: tuple[str, ...]) -> dict[str, Column]:
    """The row count and the sums of the named columns and of their products, under the names that _completed reads."""
    own = {"n": F.count("*").cast("double")} | {f"s{k}": F.sum(x) for k, x in enumerate(names, 1)}
    return own | {f"q{k}{j}": F.sum(F.col(names[k - 1]) * F.col(names[j - 1])) for k, j in LOWER}


def _completed(own: DataFrame, by: list[str], prior: float) -> DataFrame:
    """by, and mean s and covariance q of each group from its sums.

    Every group but the pooled one gets ``prior`` rows more, which are like the pooled ones on average.
    """
    parts = [c for c in own.columns if c not in (*by, "n")]
    others = [c for c in by if c != "grp"]
    pooled = own.where(F.col("grp") == POOLED).select(*others, *((F.col(c) / F.col("n")).alias(f"p_{c}") for c in parts))
    both = own.join(F.broadcast(pooled), others) if others else own.crossJoin(F.broadcast(pooled))  # one row for each start
    weight = F.when(F.col("grp") == POOLED, F.lit(0.0)).otherwise(F.lit(prior))
    both = both.select(*by, *(((F.col(c) + weight * F.col(f"p_{c}")) / (F.col("n") + weight)).alias(c) for c in parts))
    return both.withColumns({f"q{k}{j}": F.col(f"q{k}{j}") - F.col(f"s{k}") * F.col(f"s{j}") for k, j in LOWER})


def _estimates(own: DataFrame, scale: float, prior: float) -> DataFrame:
    """Mean m and Cholesky factor l of the floored covariance of each grp and start, by its sums, and its log determinant's half."""
    own = _completed(own, ["grp", "start"], prior)
    own = own.withColumns({f"v{k}{j}": F.greatest(F.col(f"q{k}{j}") * scale, F.lit(0.0)) + F.lit(FLOORS[k - 1] ** 2) if k == j else F.col(f"q{k}{j}") * scale for k, j in LOWER})
    own = _cholesky(own.withColumnsRenamed({f"s{k}": f"m{k}" for k in range(1, 5)}))
    return own.select("grp", "start", *ESTIMATE, sum(F.log(F.col(f"l{k}{k}")) for k in range(1, 5)).alias("size"))


def _core_sums(placed: DataFrame, share: float) -> DataFrame:
    """The sums of the ``share`` of each grp and start's rows with the least d2, in one pass without sorting rows.

    Rows are summed by bins of log d2 (32 per factor e, some thousand bins for a group at most, whatever its rows). The
    bin on the boundary counts with the part that the share still lacks, so the weights add up to the share exactly and
    change continuously with the estimate.
    """
    bins = placed.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 32)).groupBy("grp", "start", "bin").agg(*(c.alias(name) for name, c in _sums(FEATURES).items()))
    own = W.partitionBy("grp", "start")
    lacking = F.ceil(F.sum("n").over(own) * share) - (F.sum("n").over(own.orderBy("bin")) - F.col("n"))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), lacking / F.col("n")))
    return bins.withColumn("weight", weight).groupBy("grp", "start").agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in _sums(FEATURES)))


def _with_groups(rows: DataFrame, known: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """rows joined with known(grp, ...): by broadcast up to MOST_BROADCAST groups, else by grp and a part of its rows."""
    if groups <= MOST_BROADCAST:
        return rows.join(F.broadcast(known), "grp", how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)))
    return salted.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["grp", "salt"], how).drop("salt")


def _starts(rows: DataFrame, groups: int, prior: float) -> DataFrame:
    """Two first estimates of every group: both of medians and median deviations, the second with correlations of bounded scores."""
    middle = _with_prior(rows.groupBy("grp").agg(F.count("*").alias("n"), *(F.percentile_approx(x, 0.5, 1000).alias(f"c{k}") for k, x in enumerate(FEATURES, 1))), "c", prior)
    apart = [F.percentile_approx(F.abs(F.col(x) - F.col(f"c{k}")), 0.5, 1000).alias(f"a{k}") for k, x in enumerate(FEATURES, 1)]
    apart = _with_groups(rows, middle, groups).groupBy("grp").agg(F.count("*").alias("n"), *apart)
    spread = _with_prior(apart, "a", prior).select("grp", *(F.sqrt((1.4826 * F.col(f"a{k}")) ** 2 + FLOORS[k - 1] ** 2).alias(f"a{k}") for k in range(1, 5)))
    known = materialise(middle.join(spread, "grp"), "starts")
    scores = _with_groups(rows, known, groups).select("grp", *(F.tanh((F.col(x) - F.col(f"c{k}")) / F.col(f"a{k}")).alias(x) for k, x in enumerate(FEATURES, 1)))
    linked = known.join(_completed(scores.groupBy("grp").agg(*(c.alias(name) for name, c in _sums(FEATURES).items())), ["grp"], prior), "grp")
    one = {f"v{k}{j}": F.col(f"a{k}") * F.col(f"a{j}") * (F.lit(1.0) if j == k else F.lit(0.0)) for k, j in LOWER}
    own = lambda k, j: F.col(f"q{k}{j}") / F.sqrt(F.greatest(F.col(f"q{k}{k}") * F.col(f"q{j}{j}"), F.lit(1e-12)))
    two = one | {f"v{k}{j}": F.col(f"a{k}") * F.col(f"a{j}") * own(k, j) for k, j in LOWER if j < k}
    both = linked.withColumns(one).withColumn("start", F.lit(1)).unionByName(linked.withColumns(two).withColumn("start", F.lit(2)))
    both = _cholesky(both.withColumnsRenamed({f"c{k}": f"m{k}" for k in range(1, 5)})).withColumn("size", F.lit(None).cast("double"))
    return both.select("grp", "start", *ESTIMATE, "size")


def _with_prior(df: DataFrame, letter: str, prior: float) -> DataFrame:
    """grp and four numbers of each group, drawn towards the pooled ones as by ``prior`` rows more."""
    pooled = df.where(F.col("grp") == POOLED).select(*(F.col(f"{letter}{k}").alias(f"p{k}") for k in range(1, 5)))
    n = F.col("n")
    return df.crossJoin(F.broadcast(pooled)).select("grp", *(((n * F.col(f"{letter}{k}") + prior * F.col(f"p{k}")) / (n + prior)).alias(f"{letter}{k}") for k in range(1, 5)))


def covariance_outliers(stats: DataFrame, share: float = 0.75, most_steps: int = 200, tolerance: float = 1e-6, cutoff: float = 0.9999, prior: float = 30.0) -> DataFrame:
    """stats plus base_failed, distance and kept, by minimum-covariance-determinant estimates per lang and source.

    Rows that pass the base rules are described by log mean word length, root of the symbol share, share of repeated
    lines and share of repeated words. From two starts, each concentration step re-estimates mean and covariance from
    the ``share`` of a group's rows with the least distance (see _core_sums), until no log determinant's half changes by
    more than ``tolerance``; an error tells if that takes over most_steps steps. Groups that have settled are left out
    of further steps, unless the pooled rows move them. The start that ends with the least determinant stands. A last
    step uses all rows within the 0.975 quantile. A group's rows are never sorted or gathered; its estimate is one row
    of sums. Rows beyond the ``cutoff`` quantile of chi-square(4) are not kept.

    Every group's sums are completed by those of ``prior`` average rows of the pooled estimate over all rows: a small
    group leans on the whole, a large one hardly, and no number of rows switches between them. Null lang or source
    count as values of their own. Rows with base_failed have no distance. With no row that passes, nothing is
    estimated or kept. Repeated rows and ties count as often as they come. Own columns replace columns of the same name.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    stats = stats.withColumn("base_failed", failed).withColumns({
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x2": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x3": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x4": F.col("n_repeat_words") / words,
        "grp": F.to_json(F.struct("lang", "source")),
    })
    stats = materialise(stats, "statistics")  # the texts are read once
    own = stats.where("NOT base_failed").select("grp", *FEATURES)
    groups = own.select("grp").distinct().count()
    rows = own.unionByName(own.withColumn("grp", F.lit(POOLED)))
    now = materialise(_starts(rows, groups, prior).withColumn("moved", F.lit(True)), "estimates")
    sums = None
    for step in range(most_steps + 1):
        if step == most_steps:
            raise RuntimeError(f"an estimate of covariance still moves after {most_steps} steps")
        active = now.where("moved").drop("moved", "size")
        fresh = _core_sums(_distance(_with_groups(rows, active, groups)), share)
        if sums is not None:
            fresh = fresh.unionByName(sums.join(active.select("grp", "start"), ["grp", "start"], "left_anti"))
        before, sums = sums, materialise(fresh, "sums")
        later = _estimates(sums, _consistency(share), prior).join(now.select("grp", "start", F.col("size").alias("was")), ["grp", "start"], "left")
        later = materialise(later.withColumn("moved", F.coalesce(F.abs(F.col("size") - F.col("was")) > tolerance, F.lit(True))).drop("was"), "estimates")
        release(now, *([before] if before is not None else []))
        now = later
        if not now.where("moved").head(1):
            break
    release(sums)
    best = now.groupBy("grp").agg(F.min(F.struct("size", "start")).alias("best")).select("grp", "best.start")
    near = _distance(_with_groups(rows, now.join(best, ["grp", "start"]), groups))
    near = near.where(F.col("d2") <= chi2_4_quantile(0.975)).groupBy("grp", "start").agg(*(c.alias(name) for name, c in _sums(FEATURES).items()))
    last = materialise(_estimates(near, _consistency(0.975), prior), "estimates").drop("start", "size")
    out = _distance(_with_groups(stats, last, groups, "left")).withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.lit(chi2_4_quantile(cutoff)), F.lit(False))
    return out.withColumn("kept", kept).drop(*FEATURES, "grp", "d2", *ESTIMATE, "z1", "z2", "z3", "z4")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of every document."""
    found = covariance_outliers(text_statistics(docs))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
