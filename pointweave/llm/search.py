"""Ranked lexical search: exact inner-product search of sparse documents in ball trees, scored in integers at the leaves."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.shared import materialise, release
from pointweave.llm.textkit import LOWER, text_slices, words_of

#: Digits, letters, and all that is no ASCII character make terms.
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Documents of one tree and of one leaf; different terms of the items that are answered in one pass over the documents.
TREE, LEAF, BLOCK_TERMS = 8_192, 32, 16_384


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, _, data, offsets in text_slices(batch.column("text")):
            terms, rows = words_of(LOWER[data], offsets, NO_TERM)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows + at)), terms.cast(pa.string())], names=["item_id", "term"])


def _vectors(vocabulary: list[str]):
    """Of each document: the number of its terms, and those of the vocabulary with how often they occur."""
    known = pa.array(vocabulary, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column("text")):
                terms, rows = words_of(LOWER[data], offsets, NO_TERM)
                coded = terms.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False)
                term = place[coded.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
                hit = term >= 0
                key, tf = np.unique(rows[hit] * len(vocabulary) + term[hit], return_counts=True)
                row, term = np.divmod(key, max(1, len(vocabulary)))
                cuts = pa.array(np.searchsorted(row, np.arange(end - at + 1)), pa.int32())
                columns = [
                    batch.column("doc_id").slice(at, end - at), pa.array(np.bincount(rows, minlength=end - at), pa.int64()),
                    pa.ListArray.from_arrays(cuts, pa.array(term, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return run


def _row_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of each row's run of values; empty runs are zero."""
    total = np.append(np.zeros(1, values.dtype), np.cumsum(values))
    return total[cuts[1:]] - total[cuts[:-1]]


def _rows(cuts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, and the cuts between these rows."""
    sizes = cuts[rows + 1] - cuts[rows]
    fresh = np.append(0, np.cumsum(sizes))
    return np.repeat(cuts[rows] - fresh[:-1], sizes) + np.arange(fresh[-1]), fresh


class BallTree:
    """Sparse documents, as vectors of what each term adds to a score, in nested balls around centroids.

    A document's score for a set of terms is the inner product of its vector with the 0/1 vector of the set. Terms are
    in bands, common ones apart from rare ones, and a ball has a radius in each band's coordinates: a score is at most
    the centroid's inner product plus, for each band, the radius times the root of the number of the set's terms that
    occur in the ball. ``parts`` are integers; floating point serves the bounds only, which are raised by far more than
    rounding can take from them.
    """

    def __init__(self, cuts: np.ndarray, terms: np.ndarray, parts: np.ndarray, band: np.ndarray):
        n, n_terms, n_bands = len(cuts) - 1, len(band), int(band.max(initial=0)) + 1
        values, order = parts.astype(np.float64), np.arange(n)
        norms = _row_sums(values**2, cuts)
        self.balls, centres, radii, present = [], [], [], []
        waiting = [(0, n, -1)]
        while waiting:
            lo, hi, parent = waiting.pop()
            docs = order[lo:hi]
            at, fresh = _rows(cuts, docs)
            own_terms, own = terms[at], values[at]
            centre = np.bincount(own_terms, own, n_terms) / max(1, hi - lo)
            # Squared distances by band: what a document lacks counts by the centroid, what it has instead of that.
            theirs = centre[own_terms]
            row = np.repeat(np.arange(hi - lo), np.diff(fresh))
            instead = np.bincount(row * n_bands + band[own_terms], (own - theirs) ** 2 - theirs**2, (hi - lo) * n_bands).reshape(-1, n_bands)
            apart = instead + np.bincount(band, centre**2, n_bands)
            # These are differences of sums over the ball, so a radius gets more than their rounding can hide.
            slack = 1e-9 * (np.bincount(band[own_terms], own**2, n_bands) + np.bincount(band, centre**2, n_bands))
            if parent >= 0:
                self.balls[parent][2].append(len(self.balls))
            self.balls.append((lo, hi, []))
            centres.append(centre)
            radii.append(np.sqrt(np.maximum(apart.max(0, initial=0.0), 0.0) + slack))
            present.append(np.bincount(own_terms, minlength=n_terms) > 0)
            if hi - lo > LEAF:
                place, ends = int(apart.sum(1).argmax()), []
                for _ in range(2):
                    point = np.zeros(n_terms)
                    point[own_terms[fresh[place] : fresh[place + 1]]] = own[fresh[place] : fresh[place + 1]]
                    ends.append(norms[docs] - 2 * _row_sums(own * point[own_terms], fresh))
                    place = int(ends[0].argmax())
                # Of two far documents the nearer counts; halves at the median keep the tree shallow for any documents.
                order[lo:hi] = docs[np.argsort(ends[0] - ends[1], kind="stable")]
                mid = (lo + hi) // 2
                waiting += [(lo, mid, len(self.balls) - 1), (mid, hi, len(self.balls) - 1)]
        self.centres, self.radii, self.present, self.order = np.array(centres), np.array(radii), np.array(present), order
        # Documents of a ball stand together.
        at, self.cuts = _rows(cuts, order)
        self.terms, self.parts, self.band = terms[at], parts[at], band
        self.opened = 0

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """What no score of a document of each ball exceeds."""
        of_band = np.zeros((len(terms), self.radii.shape[1]))
        of_band[np.arange(len(terms)), self.band[terms]] = 1
        reach = (self.radii * np.sqrt(self.present[:, terms] @ of_band)).sum(1)
        return (self.centres[:, terms].sum(1) + reach) * (1 + 1e-9) + 1.0

    def best(self, terms: np.ndarray, k: int, least: int, key: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, document) with scores of at least max(1, ``least``), equal scores by ascending ``key``; exact.

        Balls are opened by their bounds, highest first, until none can hold a score that would change the result.
        """
        bounds = self.bounds(terms)
        wanted = np.zeros(len(self.band), np.int64)
        wanted[terms] = 1
        least, found, waiting = max(1, least), [], [(-bounds[0], 0)]
        while waiting and -waiting[0][0] >= least:
            lo, hi, children = self.balls[heapq.heappop(waiting)[1]]
            for child in children:
                if bounds[child] >= least:
                    heapq.heappush(waiting, (-bounds[child], child))
            if children:
                continue
            self.opened += 1
            cuts = self.cuts[lo : hi + 1]
            run = slice(cuts[0], cuts[-1])
            scores = _row_sums(self.parts[run] * wanted[self.terms[run]], cuts - cuts[0])
            for at in np.flatnonzero(scores >= least):
                doc = int(self.order[lo + at])
                entry = (int(scores[at]), -int(key[doc]), doc)
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
            if len(found) == k:
                least = max(least, found[0][0])
        return [(score, doc) for score, _, doc in found]


def bands(weights: np.ndarray) -> np.ndarray:
    """A band for each term: the most common one, the next two, the next four and so on."""
    rank = np.empty(len(weights), np.int64)
    rank[np.argsort(weights, kind="stable")] = np.arange(len(weights))
    return np.log2(rank + 1).astype(np.int64)


LAST = np.int64(2**63 - 1)


def _searched(items: list, weights: np.ndarray, n_docs: int, n_words: int, k: int):
    """The k best documents of each item of a partition: a tree for every TREE documents, each with what the last ones left to beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = bands(weights)
        best: list[list[tuple[int, int]]] = [[] for _ in items]  # (score, -key), the worst first

        def answer(rows: pa.Table) -> None:
            ids = rows.column("doc_id").combine_chunks()
            key = pc.fill_null(ids, LAST).to_numpy(zero_copy_only=False)
            lists = rows.column("terms").combine_chunks()
            cuts = np.asarray(lists.offsets, np.int64)
            terms, tf = (np.asarray(x.values)[cuts[0] : cuts[-1]].astype(np.int64) for x in (lists, rows.column("tfs").combine_chunks()))
            n = np.repeat(rows.column("n").to_numpy(), np.diff(cuts))
            m = 10 + (90 * n * n_docs) // n_words
            tree = BallTree(cuts - cuts[0], terms, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m)), band)
            for own, (_, wanted) in zip(best, items, strict=True):
                least = own[0][0] if len(own) == k else 1
                for score, doc in tree.best(wanted, k, least, key):
                    (heapq.heappush if len(own) < k else heapq.heappushpop)(own, (score, -int(key[doc])))

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TREE:
                answer(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            answer(pa.Table.from_batches(held))
        rows = [(item, None if -key == LAST else -key, score) for (item, _), own in zip(items, best, strict=True) for score, key in own]
        at, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of docs(doc_id, text) for each of items(item_id, text), exactly.

    Items are answered in blocks of about BLOCK_TERMS terms; an item is in one block. For a block, one pass over whole
    texts keeps of each document its length and the block's terms in it, as a table. Counts over all documents make the
    weights. Then every task puts its documents, TREE at a time, into ball trees and searches them for all items; the
    few best of each task meet in a ranking by item. No document is compared with another, and none moves.

    Null texts have no terms and empty ones neither; such documents do not count, such items have no rows. Repeated rows
    of a doc_id are documents of their own, which tie where their texts agree. Rows of one item_id are one item with the
    terms of all. A document without doc_id comes after equal scores with one. Empty tables give no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    asked = materialise(asked.mapInArrow(_item_terms, f"item_id {kind.simpleString()}, term string").distinct(), "items")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    ranked = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        vocabulary = [r["term"] for r in own.select("term").distinct().orderBy("term").collect()]  # bounded by the block
        number = {t: j for j, t in enumerate(vocabulary)}
        by_item = own.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        wanted = [(j, np.array(sorted(number[t] for t in r["terms"]))) for j, r in enumerate(by_item)]
        vectors = materialise(docs.mapInArrow(_vectors(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "vectors")
        total = vectors.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = vectors.where(F.size("terms") > 0).mapInArrow(_searched(wanted, weights, total["docs"], total["words"], k), "item int, doc_id long, score long")
        found = materialise(found, "found")
        release(vectors)
        names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(by_item)], f"item int, item_id {kind.simpleString()}")
        ranked.append(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    release(asked)
    out = ranked[0]
    for more in ranked[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
