"""MinHash near-duplicate removal: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.graph import connected_components
from pointweave.llm.shared import materialise, release
from pointweave.llm.textkit import U64, mix, shingle_sets

#: Coordinates of a sketch and rows of a band: 32 bands of 4 miss a pair of similarity 0.75 with probability 5e-6.
COORDINATES, ROWS = 128, 4
WIDTH = 5
#: Texts that list a shingle, above which their comparison is dealt over several tasks.
CROWD = 2_000

ROUND_SEED = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def fast_similarity_sketch(items: np.ndarray) -> np.ndarray:
    """COORDINATES values of a set of 64-bit hashes, equal in a coordinate with probability about the Jaccard similarity.

    In round i < t every item is placed into one hashed bin with a hashed value; a bin keeps the least (round, value).
    Round t + j places every item into bin j, so every bin is filled after 2t rounds at the latest, and no round after
    the one that fills the last bin changes anything. Expected work is items + t log t. Rounds are taken several at a
    time for small sets, which gives the same result.
    """
    t = COORDINATES
    full = np.full(t, np.iinfo(np.uint64).max, U64)
    n, start = len(items), 0
    if not n:
        return full
    while start < t:
        rounds = min(t - start, max(1, -(-5 * t // n)))
        hashed = mix(items[None, :] ^ ROUND_SEED[start : start + rounds, None])
        value = (hashed >> U64(8)) | (np.arange(start, start + rounds, dtype=U64)[:, None] << U64(56))
        # The bin comes from the low bits, of which the value keeps none.
        np.minimum.at(full, (hashed & U64(t - 1)).astype(np.int64).ravel(), value.ravel())
        start += rounds
        if full.max() < np.iinfo(np.uint64).max:
            return full
    for j in np.flatnonzero(full == np.iinfo(np.uint64).max):
        full[j] = (U64(t + j) << U64(56)) | (mix(items ^ ROUND_SEED[t + j]).min() >> U64(8))
    return full


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band_seed = mix(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F)) | U64(1)
    for batch in batches:
        n, h1, h2, bands = [], [], [], []
        for _, items in shingle_sets(batch.column(1), WIDTH):
            n.append(len(items))
            h1.append(int((items * U64(0x9E3779B97F4A7C15)).sum(dtype=U64).view(np.int64)))
            h2.append(int(mix(items).sum(dtype=U64).view(np.int64)))
            if len(items):
                sketch = fast_similarity_sketch(items)
                keys = mix((mix(sketch) * band_seed).reshape(-1, ROWS).sum(1, dtype=U64) + band_seed[::ROWS])
                bands.append(keys.view(np.int64))
            else:
                bands.append(np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "h1", "h2", "bands"],
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        # A run of rows with one text on the right, which most often is a hub's, makes its set once.
        hub = batch.column("text_b")
        fresh = np.r_[True, ~pc.equal(hub[1:], hub[:-1]).to_numpy(False)]
        right = (items for _, items in shingle_sets(hub.filter(pa.array(fresh)), WIDTH))
        keep, current = np.zeros(batch.num_rows, bool), None
        for row, left in shingle_sets(batch.column("text_a"), WIDTH):
            if fresh[row]:
                current = next(right)
            both = len(np.intersect1d(left, current, assume_unique=True))
            keep[row] = 100 * both >= 75 * (len(left) + len(current) - both) and both > 0
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs(a, b) those whose full shingle sets have 100 * intersection >= 75 * union. Only their texts are moved."""
    texts = docs.select("doc_id", "text")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").where("text_a IS NOT NULL AND text_b IS NOT NULL")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = list(shingle_sets(part.column("text"), WIDTH))
            rows, sizes = np.array([r for r, _ in sets]), np.array([len(x) for _, x in sets])
            whole = pa.array(np.repeat(rows, sizes))
            shingles = pa.array(np.concatenate([x for _, x in sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("rep").take(whole), part.column("form").take(whole), pa.array(np.repeat(sizes, sizes)), shingles], names=["rep", "form", "size", "shingle"])


def _prefix_links(placed: DataFrame, tried: DataFrame, docs: DataFrame, step_table: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Links (a, b) between different components of placed(rep, component), except those among tried, by a prefix filter.

    Sets of sizes s and t with Jaccard similarity 0.75 share at least n = 3/7 (s + t) shingles, so with shingles in any
    common order, here by how many of these texts have them, they share one of the first s - n + 1 of the one and
    t - n + 1 of the other. The rarest shingles of a loose copy are its own edits, so it meets few others or none. Of
    the shingles that a pair shares in those prefixes, the last one, at places p and q, and their number k bound the
    whole intersection: k + min(s - p, t - q). Pairs whose bound reaches n are verified, every one of them.

    A doc_id with several different texts is a row of its own for each (form). A shingle that more than CROWD texts list
    is dealt over several tasks by blocks of its left side.
    """
    open_reps = placed.select(F.col("rep").alias("doc_id"), "component").distinct()
    texts = docs.join(open_reps.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("form"), "text")
    texts = texts.where("text IS NOT NULL").dropDuplicates(["rep", "form"])
    shingles = step_table(texts.mapInArrow(_shingles, "rep long, form long, size long, shingle long"), "shingles")
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    # Shingles of one text alone come first in its order and meet no other text: only their number matters.
    own_text = W.partitionBy("rep", "form")
    shared = shingles.join(counts, "shingle").withColumn("own", F.col("size") - F.count("*").over(own_text))
    place = F.col("own") + F.row_number().over(own_text.orderBy("n", "shingle"))
    shared = shared.withColumn("place", place).where("4 * (place - 1) <= size").join(open_reps.withColumnRenamed("doc_id", "rep"), "rep")
    postings = step_table(shared.select("rep", "form", "component", "size", "shingle", "place", F.ceil(F.col("n") / CROWD).cast("int").alias("blocks")), "postings")
    x = postings.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    y = postings.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = (d.select("shingle", "block", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "form", "component", "size", "place"))) for d, k in ((x, "a"), (y, "b")))
    need = F.ceil(3 * (F.col("size_a") + F.col("size_b")) / 7)
    early = (F.col("place_a") <= F.col("size_a") - need + 1) & (F.col("place_b") <= F.col("size_b") - need + 1)
    met = x.join(y, ["shingle", "block"]).where(F.expr("rep_a < rep_b AND component_a <> component_b") & early)
    left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    met = met.groupBy("rep_a", "form_a", "rep_b", "form_b").agg((F.count("*") + F.min(left)).alias("most"), F.first(need).alias("need")).where("most >= need")
    pairs = met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return step_table(verify(step_table(pairs, "pairs"), docs), "links")


def near_duplicates(docs: DataFrame, hub_rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of docs(doc_id, text), linked at Jaccard similarity 0.75 of 5-word shingles.

    1. Each whole text becomes a sketch of its distinct shingles and 32 band keys. Texts with equal sets form a class,
       whatever their number; only its smallest doc_id goes on.
    2. Every member of a band bucket is paired with the bucket's hub, the member whose buckets are largest, as a text
       from which others were copied has the most common bands. Pairs are verified on full sets; links give
       components. Buckets are reduced map-side and read by a join, so a hot bucket is neither gathered nor squared.
    3. Buckets that still hold several components try another hub. Texts that are then left in such buckets are
       compared exactly, by shared rare shingles (prefix filter), across components; every pair that can reach 0.75 is
       verified. So no link that banding finds is lost, pairs within a component are never listed, and loose copies,
       each with edits of its own, are not paired with each other.

    Null and empty texts have no shingles and link with nothing. Repeated rows of a doc_id form one class if their
    texts are equal; a doc_id with different texts is linked through any of them. A null doc_id keeps its row: its
    component is the smallest doc_id of its class's component, null if there is none, and it is kept only if alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch: list[DataFrame] = []

    def step_table(df: DataFrame, name: str) -> DataFrame:
        scratch.append(materialise(df, name))
        return scratch[-1]

    sig = step_table(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"), "sketches")
    some = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = step_table(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = sig.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep")
    members = materialise(members, "members")
    reps = some.join(classes.select("h1", "h2", "n_shingles", F.col("rep").alias("doc_id")), ["h1", "h2", "n_shingles", "doc_id"])
    reps = step_table(reps.select(F.col("doc_id").alias("rep"), "bands"), "reps")
    release(sig, classes)
    del scratch[:2]
    entries = reps.select("rep", F.explode("bands").alias("bucket"))
    full = entries.groupBy("bucket").agg(F.min("rep").alias("r1"), F.max("rep").alias("r2"), F.count("*").alias("n")).where("r1 <> r2")
    entries = step_table(entries.join(step_table(full.select("bucket", "n"), "buckets"), "bucket"), "entries")
    central = step_table(entries.groupBy("rep").agg(F.sum("n").alias("central")), "central")
    best = F.max(F.struct("central", (-F.col("rep")).alias("low"), "rep")).alias("hub")
    hubs = step_table(entries.join(central, "rep").groupBy("bucket").agg(best).select("bucket", F.col("hub.rep").alias("hub")), "hubs")
    pairs = entries.join(hubs, "bucket").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    tried = step_table(pairs, "pairs")
    links = step_table(verify(tried, docs), "links")
    several = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("r1"), F.max("rep").alias("r2")).where("r1 <> r2")
    if several.head(1):
        links = links.union(members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = connected_components(links)

    for step in range(hub_rounds + 1):
        placed = entries.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
        order = F.struct(F.xxhash64("rep", F.lit(step)).alias("order"), "rep", "component")
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max(order).alias("hub")).where("c1 <> c2")
        mixed = step_table(mixed.select("bucket", "hub.rep", "hub.component").toDF("bucket", "hub", "hub_component"), "mixed")
        placed = step_table(placed.join(mixed, "bucket"), "open")
        if step < hub_rounds:
            pairs = placed.where("component <> hub_component").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
            pairs = step_table(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            more = step_table(verify(pairs, docs), "links")
            tried = tried.union(pairs)
        elif placed.head(1):
            more = _prefix_links(placed, tried, docs, step_table)
        else:
            break
        if more.head(1):
            links = links.union(more)
            found = connected_components(links)
    # The result reads the members and the last components only.
    release(*scratch)

    out = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
