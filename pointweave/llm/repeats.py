"""Removal of repeated passages: every byte of a 100-byte string that also starts earlier, in any document.

Anchors chosen by content say where equal strings can lie; enhanced suffix arrays over the text around anchors that
repeat in differing surroundings give the maximal repeat groups with all their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.textkit import BYTE_CODE, SLICE_BYTES, U64, mix, powers, text_slices

#: Bytes of a repeat, of an anchor, and anchors in a repeat, of which the one with the least hash represents it.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Windows at most so far before their anchor share its right side, the others its left side.
NEAR = 34
#: Contexts that one suffix array covers, unless one key has more.
CHUNK = 8_000
#: Runs of one anchor beyond which their windows are compared one by one, by a hash of their 100 bytes.
HOT = 8_000
#: Bytes beyond the first 100 that order suffixes; no context is longer.
BEYOND = 72


def _prefix_hashes(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def _string_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total))[1][start] + (end - start).astype(U64))


def anchored_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of consecutive 100-byte windows of a text that have the same anchor.

    (row, first window, last window, anchor) as places within the row's text, and hashes of the anchor and of the run's
    whole context, the bytes of all its windows. A window's anchor is the leftmost of the 32-byte strings in it with
    the least hash, so it depends on the window's bytes alone.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    total, (_, down) = _prefix_hashes(data), powers(n + 1)
    grams = (total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]
    grams ^= grams >> U64(32)
    grams *= U64(0xD6E8FEB86659FD93)
    least = (grams & ~U64((1 << 28) - 1)) | np.arange(len(grams), dtype=U64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[SPAN - width : SPAN - width + n - LENGTH + 1])
    anchor = (least & U64((1 << 28) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[: len(anchor)]) > 0
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
    at = anchor[lo]
    row = np.searchsorted(offsets, lo, "right") - 1
    key = _string_hashes(total, at, at + GRAM)
    context = mix(_string_hashes(total, lo, hi + LENGTH) + (at - lo).astype(U64) * U64(0x9E3779B97F4A7C15))
    base = offsets[row]
    return row, lo - base, hi - base, at - base, key, context


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places within their texts, bytes, offsets): as text_slices(), with long texts in overlapping pieces."""
    for at, end, data, offsets in text_slices(column):
        if len(data) <= 2 * SLICE_BYTES:
            yield np.arange(at, end), np.zeros(end - at, np.int64), data, offsets
            continue
        for lo in range(0, len(data) - LENGTH + 1, SLICE_BYTES):
            part = data[lo : lo + SLICE_BYTES + LENGTH - 1]
            yield np.array([at]), np.array([lo]), part, np.array([0, len(part)])


RUNS = "key long, context long, doc_id long, run long"


def packed_runs(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A run in one number: first window, and last window and anchor counted from it, of 7 bits each; then again and hot.

    The last window and the anchor are less than SPAN places from the first. Numbers sort by the first window.
    """
    return (lo.astype(np.int64) << 16) | ((hi - lo).astype(np.int64) << 9) | ((at - lo).astype(np.int64) << 2) | again.astype(np.int64)


def unpacked_runs(run: np.ndarray) -> dict[str, np.ndarray]:
    lo = run >> 16
    return {"lo": lo, "hi": lo + ((run >> 9) & 127), "at": lo + ((run >> 2) & 127), "again": (run & 1) > 0, "hot": (run & 2) > 0}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts = batch.column(0).to_numpy(zero_copy_only=False), []
        for rows, places, data, offsets in _pieces(batch.column(1)):
            row, lo, hi, at, key, context = anchored_runs(data, offsets)
            move = places[row]
            parts.append((ids[rows[row]], lo + move, hi + move, at + move, key, context))
        if not parts:
            continue
        doc, lo, hi, at, key, context = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Combined before the shuffle: of the runs of one context, all but the batch's earliest are repeats already.
        order = np.lexsort((lo, doc, context, key))
        same = np.r_[False, (key[order][1:] == key[order][:-1]) & (context[order][1:] == context[order][:-1])]
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        again = np.zeros(len(order), bool)
        again[order] = same & ((doc[first] != doc[order]) | (lo[first] != lo[order]))
        key = np.where(again, mix(key + lo.astype(U64) * U64(31) + doc.astype(U64)), key)
        columns = [key.view(np.int64), context.view(np.int64), doc, packed_runs(lo, hi, at, again)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "context", "doc_id", "run"])


def _flat(column: pa.Array, at: int, end: int) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of rows at .. end of a column of arrays, without an object per element."""
    part = column.slice(at, end - at)
    lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(False)
    return np.repeat(np.arange(len(part)), lengths), part.flatten()


def _ranges(lo: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - lengths), lengths)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every run to compare, the bytes of its windows, in two parts by the side of the anchor that they share.

    Runs of hot anchors give a row for each window instead: windows 0, no bytes, and the hash of its 100 bytes as part.
    Of a slice's equal windows only the earliest is compared with others; the rest are repeats already, with windows -1
    and parts that scatter them.
    """
    names = ["part", "doc_id", "lo", "windows", "bytes"]
    for batch in batches:
        ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
        for at, end, data, offsets in text_slices(batch.column("text")):
            rows, runs = _flat(batch.column("runs"), at, end)
            runs = unpacked_runs(runs.to_numpy(False))
            # Runs of another text of the same doc_id may reach beyond this one.
            used = np.flatnonzero(~runs["again"] & (runs["hi"] + LENGTH <= (offsets[1:] - offsets[:-1])[rows]))
            if not len(used):
                continue
            rows, lo, hi, place, hot = rows[used], *(runs[k][used] for k in ("lo", "hi", "at", "hot"))
            total, base, doc = _prefix_hashes(data), offsets[rows], ids[at:end][rows].astype(np.int64)
            cut = place - NEAR
            for side, first, last in ((0, np.maximum(lo, cut), hi), (1, lo, np.minimum(hi, cut - 1))):
                k = np.flatnonzero((first <= last) & ~hot)
                shared = (base + place, base + place + LENGTH - NEAR) if side == 0 else (base + cut - 1, base + place + GRAM)
                part = mix(_string_hashes(total, shared[0][k], shared[1][k]) + U64(side))
                size = last[k] - first[k] + LENGTH
                body = pa.py_buffer(data[_ranges((base + first)[k], size)].tobytes())
                ends = pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes())
                columns = [pa.array(part.view(np.int64)), pa.array(doc[k]), pa.array(first[k].astype(np.int32)), pa.array((size - LENGTH + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.Array.from_buffers(pa.binary(), len(k), [None, ends, body])], names=names)
            if hot.any():
                k = np.flatnonzero(hot)
                count = hi[k] - lo[k] + 1
                start, owner = _ranges(lo[k], count), np.repeat(doc[k], count)
                left = np.repeat(base[k], count) + start
                part = mix(_string_hashes(total, left, left + LENGTH) + U64(2))
                order = np.lexsort((start, owner, part))
                part, owner, start = part[order], owner[order], start[order]
                again = np.r_[False, part[1:] == part[:-1]]
                # Repeated rows of a doc_id are one document: its equal places are one place.
                again &= ~np.r_[False, (owner[1:] == owner[:-1]) & (start[1:] == start[:-1])]
                part = np.where(again, mix(owner.astype(U64) * U64(31) + start.astype(U64)), part)
                columns = [pa.array(part.view(np.int64)), pa.array(owner), pa.array(start.astype(np.int32)), pa.array(-again.astype(np.int32)), pa.array([b""] * len(part), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def common_prefix_intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of a suffix array whose suffixes share a prefix of ``least`` or more.

    ``common[i]`` is the common prefix length of suffixes i and i + 1. One pass with a stack of open intervals: an
    interval closes when a shorter common prefix follows; the one that stays open reaches back to its start. Every
    interval is given with the whole range of its suffixes, children before parents.
    """
    stack: list[tuple[int, int]] = []
    values = common.tolist()
    values.append(0)
    for i, length in enumerate(values):
        start = i
        while stack and stack[-1][0] > length:
            depth, start = stack.pop()
            yield depth, start, i
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, start))


def repeat_groups(data: np.ndarray, starts: np.ndarray, limits: np.ndarray, opens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, members) of every maximal repeat of 100 bytes or more among the suffixes of data at ``starts``.

    ``limits`` is where each suffix's context ends, ``opens`` tells that nothing is known of the byte before it.
    members are places in ``starts`` of all occurrences. The suffix array is made of the suffixes whose first 100 bytes
    repeat, in buckets of equal first 100 bytes, each ordered by what follows; no interval of 100 bytes or more crosses
    buckets. Groups whose occurrences all have the same byte before them are left out: they continue to the left.
    """
    total = _prefix_hashes(data)
    prefix = _string_hashes(total, starts, starts + LENGTH)
    _, inverse, counts = np.unique(prefix, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[inverse] > 1)
    if not len(some):
        return
    padded = np.concatenate([data, np.zeros(LENGTH + BEYOND, np.uint8)])
    tail = padded[starts[some, None] + LENGTH + np.arange(BEYOND)[None, :]]
    tail[starts[some, None] + LENGTH + np.arange(BEYOND)[None, :] >= limits[some, None]] = 0
    words = tail.view(">u8").astype(U64)
    order = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), inverse[some]))
    array, tail = some[order], tail[order]
    equal = tail[1:] == tail[:-1]
    beyond = np.where(equal.all(1), BEYOND, equal.argmin(1))
    left = limits[array] - starts[array] - LENGTH
    common = LENGTH + np.minimum(beyond, np.minimum(left[1:], left[:-1]))
    common[inverse[array][1:] != inverse[array][:-1]] = 0
    near = np.flatnonzero(common)
    for lo in range(0, len(near), 100_000):  # equal hashes are confirmed on the bytes
        i = near[lo : lo + 100_000]
        span = np.arange(LENGTH)[None, :]
        differ = (data[starts[array[i]][:, None] + span] != data[starts[array[i + 1]][:, None] + span]).any(1)
        common[i[differ]] = 0
    before = np.where(opens[array], -1, data[np.maximum(starts[array] - 1, 0)].astype(np.int16))
    # Places where the byte before changes, or is unknown: an interval without one does not vary to the left.
    varied = np.r_[0, np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0))]
    for length, first, last in common_prefix_intervals(common, LENGTH):
        if varied[last] > varied[first]:
            yield length, array[first : last + 1]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that repeat an earlier place, from contexts sorted by part, doc_id and lo; a part's contexts are compared together.

    Rows of single windows are not held: the first row of a part is its earliest place.
    """
    first = np.zeros((3, 0), np.int64)

    def later(part: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
        nonlocal first
        own = np.concatenate([first, np.stack([part, doc, lo.astype(np.int64)])], axis=1)
        begins = np.r_[True, own[0, 1:] != own[0, :-1]]
        at = np.maximum.accumulate(np.where(begins, np.arange(own.shape[1]), 0))
        out = (own[1:, at] != own[1:]).any(0)[first.shape[1] :]
        first = own[:, at[-1:]]
        return out

    def spans(rows: pa.Table) -> pa.RecordBatch:
        doc, lo, windows = (rows.column(k).to_numpy() for k in ("doc_id", "lo", "windows"))
        body = b"".join(rows.column("bytes").to_pylist())
        data = np.frombuffer(body, np.uint8)
        ends = np.cumsum(windows + LENGTH - 1, dtype=np.int64)
        base = ends - (windows + LENGTH - 1)
        context = np.repeat(np.arange(len(doc)), windows)
        step = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts, place = base[context] + step, lo[context].astype(np.int64) + step
        docs, out = doc[context], ([], [], [])
        for length, members in repeat_groups(data, starts, ends[context], step == 0):
            d, p = docs[members], place[members]
            earliest = np.lexsort((p, d))[0]
            later = (d != d[earliest]) | (p != p[earliest])
            out[0].append(d[later])
            out[1].append(p[later])
            out[2].append(p[later] + length)
        d, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "start", "end"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        windows = batch.column("windows").to_numpy()
        if (windows <= 0).any():
            part, doc, lo = (batch.column(k).to_numpy() for k in ("part", "doc_id", "lo"))
            gone, alone = windows < 0, np.flatnonzero(windows == 0)
            if len(alone):
                gone[alone] = later(part[alone], doc[alone], lo[alone])
            columns = [doc[gone], lo[gone], lo[gone] + np.int32(LENGTH)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "start", "end"])
            batch = batch.filter(pa.array(windows > 0))
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        part = rows.column("part").to_numpy()
        at = 0
        while len(part) - at >= CHUNK:
            end = int(np.searchsorted(part, part[at + CHUNK - 1], "left"))
            if end == at:  # one part alone is longer
                end = int(np.searchsorted(part, part[at], "right"))
                if end == len(part):
                    break
            yield spans(rows.slice(at, end - at))
            at = end
        held = rows.slice(at).to_batches()
    if held and sum(b.num_rows for b in held):
        yield spans(pa.Table.from_batches(held).combine_chunks())


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in text_slices(batch.column("text")):
            size = np.diff(offsets)
            (r1, runs), (r2, spans) = _flat(batch.column("runs"), at, end), _flat(batch.column("spans"), at, end)
            runs, (start, stop) = unpacked_runs(runs.to_numpy(False)), (spans.field(k).to_numpy(False).astype(np.int64) for k in (0, 1))
            again = runs["again"]
            row = np.concatenate([r1[again], r2])
            a = np.minimum(np.concatenate([runs["lo"][again], start]), size[row])
            b = np.minimum(np.concatenate([runs["hi"][again] + LENGTH, stop]), size[row])
            some = b > a
            row, a, b = row[some], a[some] + offsets[row[some]], b[some] + offsets[row[some]]
            order = np.lexsort((a, row))
            row, a, b = row[order], a[order], b[order]
            # Spans that touch or overlap are one; spans of different texts never meet.
            top = np.maximum.accumulate(b) if len(b) else b
            opens = np.flatnonzero(np.r_[True, (a[1:] > top[:-1]) | (row[1:] != row[:-1])]) if len(b) else np.zeros(0, np.int64)
            a, b, row = a[opens], top[np.r_[opens[1:], len(top)] - 1] if len(b) else b, row[opens]
            gone = np.zeros(len(data) + 1, np.int32)
            gone[a] += 1
            gone[b] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            removed = np.r_[0, np.cumsum(gone)][offsets]
            kept = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer((offsets - removed).astype(np.int32).tobytes()), pa.py_buffer(data[~gone].tobytes())])
            ends = np.searchsorted(row, np.arange(end - at + 1)).astype(np.int32)
            pairs = pa.array(np.stack([a - offsets[row], b - offsets[row]], 1).ravel().astype(np.int32))
            merged = pa.ListArray.from_arrays(pa.array(ends), pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(a) + 1, 2, dtype=np.int32)), pairs))
            columns = [batch.column("doc_id").slice(at, end - at), pa.array(size), pa.array(np.diff(removed)), pa.array(np.diff(ends).astype(np.int64)), kept, merged]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _with_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) plus runs, an array of those that are repeats or are to be compared."""
    runs = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_runs, RUNS)
    by_key = W.partitionBy("key")
    runs = runs.withColumns({"n": F.count("*").over(by_key), "c1": F.min("context").over(by_key), "c2": F.max("context").over(by_key)})
    settled = F.col("run").bitwiseAND(F.lit(1).cast("long")) == 1
    runs = runs.where((F.col("n") > 1) | settled)
    place = F.struct("doc_id", "run")
    again = settled | (place != F.min(place).over(W.partitionBy("key", "context")))
    flags = F.when(again, 1).otherwise(0) + F.when(F.col("n") > HOT, 2).otherwise(0)
    runs = runs.select("doc_id", "c1", "c2", again.alias("again"), F.col("run").bitwiseOR(flags.cast("long")).alias("run"))
    runs = runs.where("again OR c1 <> c2").groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    return docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs")


def _compared(with_runs: DataFrame) -> DataFrame:
    return with_runs.mapInArrow(_contexts, "part long, doc_id long, lo int, windows int, bytes binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), spans (array of [start, end]) of docs(doc_id, text).

    A byte goes if a 100-byte string that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Strings are judged on the input.

    1. Windows of 100 bytes are represented by anchors, about one in 35 bytes. Runs of windows of one anchor are
       shuffled by the anchor's hash, with a hash of their context instead of its bytes. A run whose context occurred
       earlier is a repeat as a whole; batches settle that among their own runs first, so that a frequent passage
       sends one run per batch.
    2. The first run of a context goes on if its anchor has other contexts too. Only these runs' bytes are shuffled,
       by the 66 bytes beside the anchor; suffix arrays over them give the maximal repeat groups. Runs of an anchor
       with more than HOT runs go on window by window instead, by a hash of each window's 100 bytes, so that no group
       of differing contexts is held by one task; equal windows are combined within batches before.
    3. Each document's spans are joined with its text.

    Null text is empty. Texts under 100 bytes lose nothing. Documents with a null doc_id keep all and count as no
    one's earlier place. Repeated rows of a doc_id are one document, and none of them is the earlier; if their texts
    differ, spans of each apply to all, clipped to their length.
    """
    with_runs = _with_runs(_texts(docs))
    contexts = _compared(with_runs)
    spans = contexts.repartition("part").sortWithinPartitions("part", "doc_id", "lo").mapInArrow(_repeated, "doc_id long, start int, end int")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = with_runs.join(spans, "doc_id", "left").select("doc_id", "text", "runs", "spans")
    return whole.mapInArrow(_cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<int>>")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

