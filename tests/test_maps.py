"""Incremental maps against a rebuild, and what they write."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pointweave.streaming.maps import IncrementalMap, follow

SCHEMA = "tile long, key long, cls int, w long, n long"


def made(seed, n, tiles):
    r = random.Random(seed)
    return [(t := r.choice(tiles), t * 100 + r.randint(0, 9), r.randint(0, 3), r.randint(1, 50), 1) for _ in range(n)]


def rebuilt(rows):
    out = {}
    for t, k, c, w, n in rows:
        a, b = out.get((k, c, t), (0, 0))
        out[k, c, t] = a + w, b + n
    return sorted((*k, *v) for k, v in out.items() if v != (0, 0))


def read(m):
    return sorted(tuple(r) for r in m.snapshot().select("key", "cls", "tile", "w", "n").collect())


def size(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


@pytest.mark.parametrize("most", [2, 100])
def test_adds_revisions_and_compactions_equal_a_rebuild(spark, tmp_path, most):
    m = IncrementalMap(spark, f"file://{tmp_path}", ["key", "cls"], ["w", "n"], "tile", buckets=8, most=most)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    batches = [made(k, 80, range(k, k + 12)) for k in range(4)]
    for k, rows in enumerate(batches):
        m.add(frame(rows), k)
        assert read(m) == rebuilt(sum(batches[: k + 1], []))
        m.compact()
        assert read(m) == rebuilt(sum(batches[: k + 1], []))
    m.add(frame(batches[3]), 3) if most == 100 else None  # delivered again: replaced, not added
    moved = made(9, 80, range(40, 44))
    m.revise(frame(batches[1]), frame(moved), 4)
    assert read(m) == rebuilt(batches[0] + moved + batches[2] + batches[3])
    m.add(frame([]), 5)
    assert m.compact() >= (1 if most == 2 else 0)
    assert read(m) == rebuilt(batches[0] + moved + batches[2] + batches[3])
    told = m.versions().agg(F.sum("changed"), F.sum("superseded")).first()
    assert told[0] - told[1] == m.versions().count()


def test_what_is_written_follows_the_touched_tiles(spark, tmp_path):
    m = IncrementalMap(spark, f"file://{tmp_path}", ["key", "cls"], ["w", "n"], "tile", buckets=64, most=100)
    m.add(spark.createDataFrame(made(1, 20_000, range(3_000)), SCHEMA), 0)
    m.add(spark.createDataFrame(made(2, 40, [7]), SCHEMA), 1)
    whole, small = size(f"{tmp_path}/changes/0"), size(f"{tmp_path}/changes/1")
    assert small < whole / 50
    assert len([d for d in os.listdir(f"{tmp_path}/changes/1") if d.startswith("bucket=")]) == 1
    m.most = 2
    before = size(f"{tmp_path}/changes/0")
    assert m.compact() == 1  # the one bucket of tile 7
    assert size(f"{tmp_path}/compact") < whole / 20 and size(f"{tmp_path}/changes/0") > before * 0.9


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    m = IncrementalMap(spark, f"file://{tmp_path}/map", ["key", "cls"], ["w", "n"], "tile", buckets=4, most=2)
    rows = []
    for k in range(5):
        rows += made(k, 30, range(6))
        spark.createDataFrame(rows[-30:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k % 2 == 0:
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            got = sorted(tuple(r) for r in follow(stream, m).select("key", "cls", "tile", "w", "n").collect())
            assert got == rebuilt(rows)
