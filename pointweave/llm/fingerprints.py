"""Document fingerprints by Order MinHash: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.textkit import U64, mix, powers

#: Code points of a k-mer, coordinates of a fingerprint, k-mers of a coordinate's tuple.
K, COORDINATES, TUPLE = 8, 128, 2
#: A coordinate is kept as three bytes: two that differ look equal once in 16 million.
WIDTH = 3

SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0xA24BAED4963EE407))
#: K-mers looked at for each coordinate at first; two of them are as good as always enough.
CROWD = 6 * TUPLE
EDGES = np.arange(COORDINATES, dtype=U64) << U64(57)
PLACE = mix(np.arange(1, TUPLE + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)


def kmers(text: str) -> np.ndarray:
    """A hash of each k-mer of a text in its order, each with the number of its earlier occurrences; a text below K is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64)
    n = len(codes)
    if not n:
        return np.zeros(0, U64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(codes) * up[:n], out=total[1:])
    k = min(K, n)
    grams = mix((total[k:] - total[:-k]) * down[: n - k + 1] + U64(k))
    # Equal k-mers stand together, in text order, when sorted with their places in the low bits.
    bits = U64(max(1, int(len(grams)).bit_length()))
    place_mask = (U64(1) << bits) - U64(1)
    packed = np.sort((grams & ~place_mask) | np.arange(len(grams), dtype=U64))
    at = (packed & place_mask).astype(np.int64)
    kind = packed >> bits
    first = np.append(True, kind[1:] != kind[:-1])
    starts = np.flatnonzero(first)
    earlier = np.empty(len(grams), U64)
    earlier[at] = (np.arange(len(grams)) - starts[np.cumsum(first) - 1]).astype(U64)
    return mix(grams ^ (earlier * U64(0xD1342543DE82EF95)))


def order_minhash(items: np.ndarray) -> np.ndarray:
    """COORDINATES hashes of tuples of a text's occurrence-numbered k-mers.

    In round i < t every k-mer gets one hashed coordinate and a hashed value; round t + j gives every k-mer to
    coordinate j. A coordinate selects the TUPLE k-mers with the least (round, value), so later rounds change nothing
    in one that has enough, and long and short texts are comparable. The selected ones are hashed in text order.
    """
    n, t = len(items), COORDINATES
    chosen = _chosen(items) if n > TUPLE else np.tile(np.arange(n), (t, 1))
    tuples = (items[chosen] * PLACE[: chosen.shape[1]]).sum(1, dtype=U64)
    return mix(tuples + U64(chosen.shape[1]))


def _chosen(items: np.ndarray) -> np.ndarray:
    """Places of the selected k-mers of each coordinate, in text order."""
    n, t = len(items), COORDINATES
    keys, at, start = np.zeros(0, U64), np.zeros(0, np.int64), 0
    while start < t:
        rounds = min(t - start, max(1, -(-CROWD * t // n)))
        hashed = mix(items[None, :] ^ SEEDS[start : start + rounds, None])
        # Of a long text only small values are looked at, unless they leave a coordinate short.
        if not start and n > CROWD * t:
            few = np.flatnonzero(hashed[0] >> U64(15) < U64((CROWD * t << 49) // n))
            found = _least(_keys(hashed[0, few] & U64(t - 1), U64(0), hashed[0, few]), few, True)
            if found is not None:
                return found
        fresh = _keys(hashed & U64(t - 1), np.arange(start, start + rounds, dtype=U64)[:, None], hashed)
        keys, at = np.append(keys, fresh), np.append(at, np.tile(np.arange(n), rounds))
        start += rounds
        found = _least(keys, at, start == 1)
        if found is not None:
            return found
    for j in range(t):
        keys = np.append(keys, _keys(U64(j), U64(t + j), mix(items ^ SEEDS[t + j])))
        at = np.append(at, np.arange(n))
    return _least(keys, at, False)


def _keys(coordinate: np.ndarray, number: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Coordinate, round and hashed value in this order as one number."""
    return (coordinate << U64(57)) | (number << U64(49)) | (hashed >> U64(15))


def _least(keys: np.ndarray, at: np.ndarray, once: bool) -> np.ndarray | None:
    """The TUPLE different k-mers with the least keys of each coordinate, in text order; None if one has fewer."""
    order = np.argsort(keys)
    keys, at = keys[order], at[order]
    if not once:
        # A k-mer that came to its coordinate in several rounds counts by the first of them.
        _, first = np.unique((keys >> U64(57) << U64(40)) + at.astype(U64), return_index=True)
        first.sort()
        keys, at = keys[first], at[first]
    starts = np.append(np.searchsorted(keys, EDGES), len(keys))
    if np.diff(starts).min() < TUPLE:
        return None
    return np.sort(at[starts[:-1, None] + np.arange(TUPLE)], axis=1)


def fingerprint(text: str) -> np.ndarray:
    """COORDINATES numbers below 2**24; texts without characters have zeros, which no other text has but by chance."""
    items = kmers(text)
    return order_minhash(items) & U64((1 << 8 * WIDTH) - 1) if len(items) else np.zeros(COORDINATES, U64)


def as_string(print_: np.ndarray) -> str:
    return base64.b64encode(print_.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :WIDTH].tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal coordinates, an estimate of how much of two texts agrees in content and order; 1 for equal texts."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of another, or by all of that if it is shorter."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs and a column ``fingerprint`` of their ``text``; null texts have that of the empty text."""

    @F.pandas_udf("string")
    def made(text: pd.Series) -> pd.Series:
        return pd.Series([as_string(fingerprint(x or "")) for x in text], dtype=object)

    return docs.withColumn("fingerprint", made(F.col("text").cast("string")))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by ascending doc_id, so each row's next document has just passed; guests only pass."""
    before, before_print = "", fingerprint("")
    for batch in batches:
        rows = []
        for doc_id, text, copies in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies")), strict=True):
            own = fingerprint(text)
            if copies:
                new = edited(text, before)
                other = fingerprint(new)
                sha = hashlib.sha256(new.encode()).hexdigest()
                rows.append((doc_id, len(text), sha, as_string(own), as_string(other), likeness(own, other), likeness(own, before_print), copies))
            before, before_print = text, own
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _bounds(ids: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """At most parts - 1 pairs (doc_id, text hash) that cut the rows into parts of about equal size, in order.

    A doc_id that fills several parts by itself is cut by even steps of the hash.
    """
    cuts = np.array(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else [], np.float64)
    cuts = np.clip(cuts, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    hashes = np.full(len(cuts), -(2**63), np.int64)
    for x, n in zip(*np.unique(cuts, return_counts=True), strict=True):
        hashes[cuts == x] = [-(2**63) + k * (2**64 // int(n)) for k in range(n)]
    return cuts, hashes


def edit_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text).

    The next document is the one with the next smaller doc_id; that of the smallest is the largest. Rows are dealt by
    ranges of doc_id and sorted within; the largest of each range also goes, as a guest, to the range above it, the
    largest of all to the lowest one. So texts move once, and one text is kept at a time.

    Null texts are empty ones; an empty text's edited text is empty, its fingerprint like only other empty texts. Of
    repeated rows of a doc_id equal texts give equal rows and count once in the order; different texts of a doc_id
    follow each other by a hash of the text. Rows without doc_id have no place in the order: their next document is the
    empty text. A single document is its own next one. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(1).cast("long").alias("copies"))
    known = docs.where("doc_id IS NOT NULL")
    ids = known.select("doc_id")
    repeated = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.head(1):
        # Equal rows combine map-side.
        again = known.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.sum("copies").alias("copies"))
        known = known.join(repeated, "doc_id", "left_anti").unionByName(again)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, hashes = _bounds(ids, parts)

    def part_of(doc_id: pd.Series, hashed: pd.Series) -> pd.Series:
        x, h = doc_id.to_numpy(np.int64), hashed.to_numpy(np.int64)
        low, high = np.searchsorted(cuts, x, "left"), np.searchsorted(cuts, x, "right")
        for k in np.flatnonzero(high > low):  # a doc_id that is itself a cut
            low[k] += np.searchsorted(hashes[low[k] : high[k]], h[k], "right")
        return pd.Series(low.astype(np.int32))

    part = F.pandas_udf(part_of, "int")

    # Only ids are read for the ends of parts, but for repeated ones, whose hashes count.
    keys = known.select("doc_id", F.xxhash64("text").alias("hashed")) if len(np.unique(cuts)) < len(cuts) or repeated.head(1) else ids.select("doc_id", F.lit(0).cast("long").alias("hashed"))
    ends = keys.withColumn("part", part("doc_id", "hashed")).groupBy("part").agg(F.max(F.struct("doc_id", "hashed")).alias("end")).select("part", "end.*")
    ends = sorted((r["part"], r["doc_id"], r["hashed"]) for r in ends.collect())  # a row for each part at most
    by_hash = any(h for _, _, h in ends)
    guest_of = {(x, h): ends[(k + 1) % len(ends)][0] for k, (_, x, h) in enumerate(ends)}

    def places_of(doc_id: pd.Series, hashed: pd.Series) -> pd.Series:
        own = part_of(doc_id, hashed)
        guests = (guest_of.get((x, h if by_hash else 0)) for x, h in zip(doc_id, hashed, strict=True))
        return pd.Series([[p] if g is None else [p, -1 - g] for p, g in zip(own, guests, strict=True)])

    places = F.pandas_udf(places_of, "array<int>")
    hashed = F.xxhash64("text") if by_hash else F.lit(0).cast("long")
    dealt = known.withColumn("hashed", hashed).withColumn("place", F.explode(places("doc_id", "hashed")))
    guest = F.col("place") < 0
    dealt = dealt.withColumns({"part": F.when(guest, -1 - F.col("place")).otherwise(F.col("place")), "copies": F.when(guest, 0).otherwise(F.col("copies")), "own": ~guest})
    # A guest comes first: it is smaller than all others of its part, or the largest of all before the smallest.
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("own", "doc_id", "hashed", "text")
    out = dealt.select("doc_id", "text", "copies").mapInArrow(_compared, SCHEMA)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))) if repeated.head(1) else out
    lone = docs.where("doc_id IS NULL").select("doc_id", "text", "copies").mapInArrow(_alone, SCHEMA)
    columns = [c.split()[0] for c in SCHEMA.split(", ")][:-1]
    return out.select(*columns).unionByName(lone.select(*columns))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a place in the order."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield from _compared(iter([batch.slice(k, 1)]))
