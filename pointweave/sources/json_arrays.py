"""JSON arrays larger than a task: one file read as byte ranges, each by a task of its own.

A range alone does not tell whether it starts within a string. A first pass works out, for each state that a range may
start in, the state that it ends in; a fold over a file's ranges, a row each, then gives every range its state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.sources.files import located

BUFFER = 1 << 20
#: Bytes of the largest record that is read.
MOST = 16 << 20
#: Change of depth by byte value.
STEP = np.zeros(256, np.int8)
STEP[[ord("["), ord("{")]] = 1
STEP[[ord("]"), ord("}")]] = -1
MARK = STEP != 0
MARK[ord(",")] = True
#: What a range may start in, as (within a string, after a backslash there).
STARTS = ((False, False), (True, False), (True, True))
BLANK = b" \t\r\n"


def structure(body: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, bool, bool]:
    """(places of brackets and commas outside strings, within a string after body, after a backslash there)."""
    quotes, slashes = np.flatnonzero(body == 34), np.flatnonzero(body == 92)
    # Length of the run of backslashes that ends at each one, counting one before body.
    starts = np.r_[True, slashes[1:] != slashes[:-1] + 1] if len(slashes) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(starts, np.arange(len(slashes)), 0)) if len(slashes) else starts
    run = np.arange(len(slashes)) - first + 1
    if escaped and len(slashes) and slashes[0] == 0:
        run[first == 0] += 1
    at = np.searchsorted(slashes, quotes - 1)
    near = at < len(slashes)
    near[near] = slashes[at[near]] == quotes[near] - 1
    odd = np.zeros(len(quotes), bool)
    odd[near] = run[at[near]] % 2 == 1
    if escaped and len(quotes) and quotes[0] == 0:
        odd[0] = True
    quotes = quotes[~odd]
    marks = np.flatnonzero(MARK[body])
    marks = marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]
    inside = bool((len(quotes) + inside) % 2)
    after = bool(run[-1] % 2) if len(slashes) and slashes[-1] == len(body) - 1 else escaped and not len(body)
    return marks, inside, after and inside


def passage(chunks: Iterator[bytes]) -> list[tuple[int, int, int, int]]:
    """(state it ends in, as a place in STARTS, change of depth, brackets seen, bytes) for each state in STARTS."""
    states = [[inside, escaped, 0, 0, 0] for inside, escaped in STARTS]
    for chunk in chunks:
        body = np.frombuffer(chunk, np.uint8)
        for s in states:
            marks, s[0], s[1] = structure(body, s[0], s[1])
            steps = STEP[body[marks]]
            s[2] += int(steps.sum())
            s[3] += int(np.count_nonzero(steps))
            s[4] += len(chunk)
    return [(STARTS.index((s[0], s[1])), *s[2:]) for s in states]


def elements(read: Callable[[int, int], bytes], start: int, end: int, size: int, state: int, depth: int, begun: bool, most: int = MOST) -> Iterator[bytes]:
    """Objects of the array whose comma or bracket before them is in start .. end; the last may go on beyond.

    ``read(n, at)`` gives up to n bytes. Anything but one array of objects raises.
    """
    inside, escaped = STARTS[state]
    held = bytearray()
    before, values = "", 0  # the mark before the open element, or nothing; values closed in it
    at = start
    while at < size and (at < end or before):
        chunk = read(min(BUFFER, (end if at < end else size) - at), at)
        if not chunk:
            raise ValueError("truncated JSON array")
        body = np.frombuffer(chunk, np.uint8)
        marks, inside, escaped = structure(body, inside, escaped)
        steps = STEP[body[marks]]
        depths = depth + np.cumsum(steps, dtype=np.int64)
        top = np.flatnonzero((depths == 0) | ((depths == 1) & (steps <= 0)) | ((depths == 1) & (depths - steps == 0)) | (depths < 0))
        done = 0
        for k in top.tolist():
            place, step, now = int(marks[k]), int(steps[k]), int(depths[k])
            mark = chr(body[place])
            if now < 0 or (now == 0 and step == 0) or (now == 0 and mark != "]") or (now == 1 and step == 1 and (mark != "[" or begun)):
                raise ValueError("not one JSON array")
            if now == 1 and step < 0:  # a value of the array closes
                values += 1
                continue
            if now == 1 and step == 1:
                if chunk[done:place].strip(BLANK):
                    raise ValueError("text before a JSON array")
                begun = True
            elif before:
                held += chunk[done:place]
                text = bytes(held).strip(BLANK)
                if text:
                    if len(text) > most:
                        raise ValueError("a record is too large")
                    if values != 1 or text[:1] != b"{" or text[-1:] != b"}":
                        raise ValueError("an element of a JSON array is no object")
                    yield text
                elif before == "," or mark == ",":
                    raise ValueError("a JSON array misses an element")
            held.clear()
            values, done = 0, place + 1
            before = mark if now == 1 and at + place < end else ""
            if not before and at + place >= end:
                return
        depth = int(depths[-1]) if len(depths) else depth
        if before:
            held += chunk[done:]
            if len(held) > most + BUFFER:
                raise ValueError("a record is too large")
        elif depth == 0 and chunk[done:].strip(BLANK):
            raise ValueError("text beside a JSON array")
        at += len(chunk)
    if before:
        raise ValueError("truncated JSON array")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files of a folder; contents stay unread."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def json_array(files: DataFrame, schema: str, range_bytes: int = 64 << 20, most: int = MOST) -> DataFrame:
    """Records of files(path, length), each one JSON array of objects in UTF-8, read by ranges of ``range_bytes``.

    Both passes read in buffers of a megabyte; a task holds a buffer and a record. A malformed or truncated file is an
    error, so is a record of over ``most`` bytes. ``[]`` has no records. One task folds a file's ranges: 16,000 short
    rows for a terabyte.
    """
    step = F.lit(range_bytes).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)).cast("long"), step)
    ranges = files.select("path", F.col("length").alias("size"), F.explode(starts).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + step, F.col("size")))
    number = files.agg(F.sum(F.ceil((F.col("length") + 1) / range_bytes)).alias("n")).first()["n"] or 1
    tasks = int(min(number, 20_000))
    first_pass = ", ".join(f"to{k} long, depth{k} long, seen{k} long" for k in range(len(STARTS)))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = located(row["path"])
                with store.open_input_file(place) as file:
                    found = passage(file.read_at(min(BUFFER, row["end"] - at), at) for at in range(row["start"], row["end"], BUFFER))
                if any(f[3] != row["end"] - row["start"] for f in found):
                    raise ValueError(f"{row['path']} is shorter than its length")
                for k, (to, depth, seen, _) in enumerate(found):
                    row |= {f"to{k}": to, f"depth{k}": depth, f"seen{k}": seen}
                yield pa.RecordBatch.from_pylist([row])

    def folded(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("start", ignore_index=True)
        state, depth, seen, rows = 0, 0, 0, []
        for row in part.itertuples():
            rows.append((state, depth, seen > 0))
            state, depth, seen = getattr(row, f"to{state}"), depth + getattr(row, f"depth{state}"), seen + getattr(row, f"seen{state}")
        if state or depth or not seen:
            raise ValueError(f"truncated JSON array: {part['path'].iloc[0]}")
        part[["state", "depth", "begun"]] = rows
        return part[["path", "size", "start", "end", "state", "depth", "begun"]]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = located(row["path"])
                with store.open_input_file(place) as file:
                    found, held = [], 0
                    for text in elements(file.read_at, row["start"], row["end"], row["size"], row["state"], row["depth"], row["begun"], most):
                        found.append(text)
                        held += len(text)
                        if held >= BUFFER:
                            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], names=["value"])
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string())], names=["value"])

    layout = "path string, size long, start long, end long"
    dealt = ranges.repartition(tasks, "path", "start")
    states = dealt.mapInArrow(summaries, f"{layout}, {first_pass}").groupBy("path").applyInPandas(folded, f"{layout}, state int, depth long, begun boolean")
    texts = states.repartition(tasks, "path", "start").mapInArrow(records, "value string")
    return texts.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record")).select("record.*")


def write_json_arrays(rows: DataFrame, path: str) -> DataFrame:
    """path, length of the files written: a JSON array for each partition of rows, which is streamed, not held.

    The list is stored as ``<path>/files`` and names what committed tasks wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(f"{path}/data")
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(b"[")
            between = b"\n"
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write(between + text.encode())
                    between = b",\n"
            out.write(b"\n]\n")
            length = out.tell()
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/data/{name}"]), pa.array([length])], names=["path", "length"])

    text = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    text.mapInArrow(run, "path string, length long").write.mode("errorifexists").parquet(f"{path}/files")
    return rows.sparkSession.read.schema("path string, length long").parquet(f"{path}/files")
