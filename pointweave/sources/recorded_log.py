"""Recorded logs: messages by topic and frame in blocks, with an index of blocks, scanned by ranges.

``<path>/data`` holds files of blocks, ``<path>/index`` a Parquet row per block. Only files that the index names are
part of the log, so what a lost or repeated task wrote is never read.
"""

from __future__ import annotations

import json
import operator
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointweave.sources.files import located

#: Before each payload: frame, stamp_ns, bytes of the payload.
HEAD = "<qqI"
HEAD_BYTES = struct.calcsize(HEAD)
SCHEMA = "topic string, frame long, stamp_ns long, data binary"
INDEX = "topic string, file string, offset long, length long, n long, first_frame long, last_frame long, first_stamp_ns long, last_stamp_ns long"
#: Bytes of messages in one Arrow batch.
BATCH_BYTES = 8 << 20


def write_log(messages: DataFrame, path: str, block_bytes: int = 32 << 20, files: int | None = None) -> None:
    """messages(topic, frame, stamp_ns, data) as a log; nulls are an error, so is a log that exists.

    Ranges of topic and frame are sorted in tasks of their own, a hot topic in many, ``files`` of them if it is given.
    A block has one topic and ends with the message that takes it to ``block_bytes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        out = block = None
        name = f"{uuid.uuid4().hex}.log"
        try:
            for batch in batches:
                if any(column.null_count for column in batch.columns):
                    raise ValueError("a message of a log has a null")
                for topic, frame, stamp, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None:
                        store, base = located(f"{path}/data")
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}")
                    if block is None or block["topic"] != topic or block["length"] >= block_bytes:
                        block = {"topic": topic, "file": name, "offset": out.tell(), "length": 0, "n": 0}
                        block |= {"first_frame": frame, "last_frame": frame, "first_stamp_ns": stamp, "last_stamp_ns": stamp}
                        rows.append(block)
                    out.write(struct.pack(HEAD, frame, stamp, len(data)))
                    out.write(data)
                    block["length"] += HEAD_BYTES + len(data)
                    block["n"] += 1
                    for key, value in (("frame", frame), ("stamp_ns", stamp)):
                        block[f"first_{key}"] = min(block[f"first_{key}"], value)
                        block[f"last_{key}"] = max(block[f"last_{key}"], value)
        finally:
            if out is not None:
                out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    one = messages.selectExpr("CAST(topic AS STRING) AS topic", "CAST(frame AS LONG) AS frame", "CAST(stamp_ns AS LONG) AS stamp_ns", "CAST(data AS BINARY) AS data")
    ranged = one.repartitionByRange("topic", "frame") if files is None else one.repartitionByRange(files, "topic", "frame")
    ordered = ranged.sortWithinPartitions("topic", "frame", "stamp_ns")
    ordered.mapInArrow(run, INDEX).write.mode("errorifexists").parquet(f"{path}/index")


class Blocks(InputPartition):
    """Blocks of one file: (topic, offset, length, messages) each."""

    def __init__(self, file: str, blocks: list[tuple[str, int, int, int]]):
        self.file, self.blocks = file, blocks


class LogReader(DataSourceReader):
    """Topics and ranges choose blocks by the index, then messages by their heads."""

    def __init__(self, options: dict[str, str]):
        self.path, self.split_bytes = options["path"], int(options.get("split_bytes", 128 << 20))
        self.topics: list[str] | None = json.loads(options.get("topics", "null"))
        self.ranges: dict[str, tuple[int, int]] = {name: tuple(json.loads(options[name])) for name in ("frame", "stamp_ns") if name in options}

    def chosen(self) -> ds.Expression | None:
        """The condition on rows of the index that a block must meet to hold a wanted message."""
        parts = [] if self.topics is None else [ds.field("topic").isin(pa.array(self.topics, pa.string()))]
        parts += [(ds.field(f"last_{name}") >= first) & (ds.field(f"first_{name}") < beyond) for name, (first, beyond) in self.ranges.items()]
        return reduce(operator.and_, parts) if parts else None

    def partitions(self) -> list[Blocks]:
        store, base = located(f"{self.path}/index")
        index = ds.dataset(base, filesystem=store, format="parquet", schema=pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in INDEX.split(", ")]))
        rows = index.to_table(["file", "offset", "length", "n", "topic"], self.chosen()).sort_by([("file", "ascending"), ("offset", "ascending")])
        out: list[Blocks] = []
        held = 0
        for file, offset, length, n, topic in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if not out or out[-1].file != file or held + length > self.split_bytes:
                out.append(Blocks(file, []))
                held = 0
            out[-1].blocks.append((topic, offset, length, n))
            held += length
        return out or [Blocks("", [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        store, base = located(f"{self.path}/data")
        every = -(1 << 63), 1 << 63
        (frame_from, frame_to), (stamp_from, stamp_to) = self.ranges.get("frame", every), self.ranges.get("stamp_ns", every)
        with store.open_input_file(f"{base}/{partition.file}") as file:
            for topic, offset, length, n in partition.blocks:
                body = memoryview(file.read_at(length, offset))
                if len(body) != length:
                    raise ValueError(f"{partition.file}: the block at {offset} is cut off")
                at = found = held = 0
                frames, stamps, data = [], [], []
                while at + HEAD_BYTES <= length:
                    frame, stamp, size = struct.unpack_from(HEAD, body, at)
                    at += HEAD_BYTES + size
                    found += 1
                    if frame_from <= frame < frame_to and stamp_from <= stamp < stamp_to:
                        frames.append(frame)
                        stamps.append(stamp)
                        data.append(body[at - size : at])
                        held += size
                    if held >= BATCH_BYTES:
                        yield self.batch(topic, frames, stamps, data)
                        held, frames, stamps, data = 0, [], [], []
                if at != length or found != n:
                    raise ValueError(f"{partition.file}: the block at {offset} holds other messages than its index says")
                if frames:
                    yield self.batch(topic, frames, stamps, data)

    @staticmethod
    def batch(topic: str, frames: list, stamps: list, data: list) -> pa.RecordBatch:
        columns = [pa.array([topic] * len(frames), pa.string()), pa.array(frames, pa.int64()), pa.array(stamps, pa.int64()), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["topic", "frame", "stamp_ns", "data"])


class RecordedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def recorded_log(
    spark: SparkSession, path: str, topics: list[str] | None = None, frames: tuple[int, int] | None = None, stamps_ns: tuple[int, int] | None = None, split_bytes: int = 128 << 20
) -> DataFrame:
    """topic, frame, stamp_ns, data of a log, or of some topics, frames and times in it, each from the first to before the last.

    Blocks outside are not read, nor files that hold no others. The index is read on the driver, a row for each block
    that is left. Ranges are arguments, not pushed conditions: Spark 4.1.2 keeps the conditions that a Python source took
    for later scans of the same DataFrame, which then lose rows.
    """
    spark.dataSource.register(RecordedLog)
    load = spark.read.format("recorded_log").option("split_bytes", str(split_bytes))
    for name, value in (("topics", topics), ("frame", frames), ("stamp_ns", stamps_ns)):
        load = load if value is None else load.option(name, json.dumps(value))
    return load.load(path)
