"""Sources that read by ranges: recorded logs by topic and frame, JSON arrays by bytes."""

import hashlib
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from pointweave.sources import readers
from pointweave.sources.json_arrays import STARTS, elements, json_array, passage, sizes, write_json_arrays
from pointweave.sources.recorded_log import recorded_log, write_log

ODD = ["", "a", '"', "\\", '\\"', "[", "]{}", ",", '",{"', "é▁", "\n", "\\\\", "x" * 40]


def by_ranges(body: bytes, width: int, most: int = 1 << 20) -> list:
    """json_array() without Spark."""
    state, depth, seen, out = 0, 0, 0, []
    spans = [(at, min(at + width, len(body))) for at in range(0, max(len(body), 1), width)]
    read = lambda n, at: body[at : at + n]
    for lo, hi in spans:
        out += [json.loads(t) for t in elements(read, lo, hi, len(body), state, depth, seen > 0, most)]
        to, change, marks, _ = passage([body[lo:hi]])[state]
        state, depth, seen = to, depth + change, seen + marks
    if state or depth or not seen:
        raise ValueError("truncated")
    return out


def test_every_cut_of_a_json_array_gives_the_whole_parse(monkeypatch):
    rng = random.Random(3)
    records = [{rng.choice("ab") + str(k): rng.choice([rng.choice(ODD) + rng.choice(ODD), [1, {"z": rng.choice(ODD)}], None, -1.5e3]) for k in range(rng.randrange(4))} for _ in range(25)]
    for body in (json.dumps(records), json.dumps(records, indent=1, ensure_ascii=False), "[]", " [ \n ] ", "[{}]"):
        raw = body.encode()
        want = json.loads(body)
        for width in range(1, len(raw) + 1):
            if width < 60 or width % 17 == 0 or width > len(raw) - 3:
                assert by_ranges(raw, width) == want, width
    raw = json.dumps(records).encode()
    for buffer in (1, 2, 3, 7, 64):  # the same with small buffers
        monkeypatch.setattr("pointweave.sources.json_arrays.BUFFER", buffer)
        assert by_ranges(raw, 50) == records
    for cut in range(0, len(raw), 3):  # every truncation is an error, in ranges of any width
        with pytest.raises(ValueError):
            by_ranges(raw[:cut], 31)


@pytest.mark.parametrize("body", ["", "{}", "[{}", "[{},]", "[,{}]", "[{},,{}]", "[{} {}]", "[{}5]", "[5]", "[null]", "[[]]", "[{}]]", "[{}][{}]", "[{}] x", "x [{}]", "[{}}", '["a"]', "[{}],", '[{"a":1]'])
def test_what_is_no_array_of_objects_is_an_error_at_every_cut(body):
    for width in range(1, len(body) + 2):
        with pytest.raises(ValueError):
            by_ranges(body.encode(), width)


def test_states_compose():
    rng = random.Random(5)
    for _ in range(300):
        body = "".join(rng.choice('"\\[]{},x') for _ in range(rng.randrange(12))).encode()
        cut = rng.randrange(len(body) + 1)
        for state in range(len(STARTS)):
            a = passage([body[:cut]])[state]
            b = passage([body[cut:]])[a[0]]
            if b'\\' not in body or state:  # outside strings a backslash is no JSON
                whole = passage([body])[state]
                if whole[:3] != (b[0], a[1] + b[1], a[2] + b[2]):
                    assert _has_slash_outside(body, *STARTS[state])


def _has_slash_outside(body: bytes, inside: bool, escaped: bool) -> bool:
    for c in body:
        if not inside and c == 92:
            return True
        if escaped:
            escaped = False
        elif c == 92:
            escaped = True
        elif c == 34:
            inside = not inside
    return False


def test_json_arrays_of_several_files(spark, tmp_path):
    rows = [(k, ODD[k % len(ODD)], None if k % 5 == 0 else [k, k + 1]) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, s string, v array<long>")
    files = write_json_arrays(df.repartition(3), str(tmp_path / "arrays"))
    (tmp_path / "arrays" / "data" / "lost.json").write_text("[{")  # of a lost task: not listed, not read
    assert files.count() == 3
    for width in (700, 5_000, 1 << 20):
        back = json_array(files, "k long, s string, v array<long>", width)
        assert sorted((r.k, r.s, r.v) for r in back.collect()) == rows
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "a.json").write_text(json.dumps([{"k": k} for k in range(100)]))
    assert json_array(sizes(spark, str(whole)), "k long", 90).agg(F.sum("k")).first()[0] == 4950
    (whole / "b.json").write_text(json.dumps([{"k": 1}])[:-1])
    with pytest.raises(Exception, match="truncated"):
        json_array(sizes(spark, str(whole)), "k long", 64).collect()
    (whole / "b.json").write_text('[{"k": 1x}]')
    with pytest.raises(Exception):
        json_array(sizes(spark, str(whole)), "k long", 64).collect()
    (whole / "b.json").write_text(json.dumps([{"k": "y" * 5000}]))
    with pytest.raises(Exception, match="too large"):
        json_array(sizes(spark, str(whole)), "k string", 64, most=1000).collect()
    assert json_array(sizes(spark, str(whole)).where("false"), "k long").count() == 0


def test_log_ranges_open_only_the_files_they_need(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"/t{k % 3}", k // 3, 1000 + 7 * (k // 3), struct.pack("<fff", k, 2, 3) * 2) for k in range(600)]
    schema = "topic string, frame long, stamp_ns long, data binary"
    write_log(spark.createDataFrame(rows, schema).repartition(5), path, block_bytes=500, files=6)
    log = recorded_log(spark, path, split_bytes=1000)
    key = lambda r: (r[0], r[1], r[2], bytes(r[3]))
    assert sorted(map(key, log.collect())) == sorted(rows)
    some = [r for r in rows if r[0] == "/t1" and 20 <= r[1] < 30]
    ranged = recorded_log(spark, path, ["/t1"], (20, 30))
    for scan, want in (
        (ranged, some),
        (recorded_log(spark, path, stamps_ns=(1001, 1022)), [r for r in rows if 1001 <= r[2] < 1022]),
        (recorded_log(spark, path, ["/t0", "/t2"], (3, 4), (0, 2000)), [r for r in rows if r[0] != "/t1" and r[1] == 3]),
        (log.where("frame % 50 = 1 OR frame = 2"), [r for r in rows if r[1] % 50 == 1 or r[1] == 2]),
        (recorded_log(spark, path, frames=(5, 5)), []),
        (recorded_log(spark, path, []), []),
        (recorded_log(spark, path, ["/t9"]), []),
    ):
        assert sorted(map(key, scan.collect())) == sorted(want)
    # Scans of one DataFrame do not disturb each other.
    assert log.where("frame < 10").union(log.where("topic = '/t0'")).count() == 230 and log.count() == 600
    assert log.join(log.where("frame < 10").select("topic", "frame"), ["topic", "frame"], "left").count() == 600
    need = {r.file for r in spark.read.parquet(f"{path}/index").where("topic = '/t1' AND last_frame >= 20 AND first_frame < 30").collect()}
    assert 0 < len(need) < len(os.listdir(f"{path}/data"))
    for name in os.listdir(f"{path}/data"):
        if name not in need:
            os.remove(f"{path}/data/{name}")
    assert sorted(map(key, ranged.collect())) == sorted(some)
    clouds = ranged.selectExpr("stamp_ns", "2 AS width", "1 AS height", "12 AS point_step", "24 AS row_step", "false AS big_endian", "0 AS ox", "4 AS oy", "8 AS oz", "data")
    assert sorted(r.x for r in readers.point_clouds(clouds).collect()) == sorted(2 * [float(3 * f + 1) for f in range(20, 30)])
    with pytest.raises(Exception):
        log.collect()


def test_log_edges(spark, tmp_path):
    schema = "topic string, frame long, stamp_ns long, data binary"
    write_log(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert recorded_log(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="null"):
        write_log(spark.createDataFrame([("a", None, 1, b"")], schema), str(tmp_path / "null"))
    same = [("a", 1, 1, b"x"), ("a", 1, 1, b"x"), ("a", 1, 1, b"")]
    write_log(spark.createDataFrame(same, schema), str(tmp_path / "same"))
    with pytest.raises(Exception):
        write_log(spark.createDataFrame(same, schema), str(tmp_path / "same"))
    back = recorded_log(spark, str(tmp_path / "same")).collect()
    assert sorted(hashlib.sha256(r.data).hexdigest() for r in back) == sorted(hashlib.sha256(r[3]).hexdigest() for r in same)
    name = os.listdir(tmp_path / "same" / "data")
    file = next(tmp_path / "same" / "data" / n for n in name if n.endswith(".log"))
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="cut off"):
        recorded_log(spark, str(tmp_path / "same")).collect()
