"""Streams in event time: rows shuffled over files, rows that come too late, keys that fall idle."""

import datetime
import os
import shutil

import pandas as pd
import pytest

from pointweave.plans import ORACLE_SQL, QUERIES
from pointweave.streaming import machines, runs

SF = "/root/testdata/sf0.001"
BATCH = {
    "stream_keyframes": "keyframe_thinning", "stream_pose_buffer": "causal_pose_buffer", "stream_session_restarts": "session_restarts", "stream_evidence": "evidence_ledger",
    "stream_packet_claims": "packet_claims", "stream_instance_semantics": "instance_semantics", "stream_gap_sessions": "gap_sessions", "stream_exact_pairs": "exact_stamp_pairs",
}


@pytest.fixture(scope="module")
def shuffled(tmp_path_factory):
    """The smallest tables, with the events in random order over four files."""
    folder = tmp_path_factory.mktemp("shuffled")
    for t in ("events", "lineitem"):
        rows = pd.read_parquet(f"{SF}/{t}.parquet").sample(frac=1, random_state=5)
        (folder / f"{t}.parquet").mkdir()
        for k in range(4):
            rows.iloc[k::4].to_parquet(folder / f"{t}.parquet" / f"part-{k}.parquet", coerce_timestamps="us")
    yield str(folder)
    shutil.rmtree(folder)


def bag(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", sorted(BATCH))
def test_stream_of_shuffled_files_equals_the_batch_form(spark, shuffled, name):
    assert bag(QUERIES[name](spark, shuffled)) == bag(QUERIES[BATCH[name]](spark, SF))


@pytest.mark.parametrize("name", ["stream_deduplicated", "stream_vote_map", "snapshot_throttle", "queue_drops"])
def test_other_streams_do_not_depend_on_files(spark, shuffled, name):
    assert bag(QUERIES[name](spark, shuffled)) == bag(QUERIES[name](spark, SF))


def stream_of_files(spark, folder, files):
    """A stream that takes a file a micro-batch, in the order given."""
    for k, rows in enumerate(files):
        pdf = pd.DataFrame(rows, columns=["user_id", "t_us"])
        pdf["ts"] = pd.to_datetime(pdf["t_us"], unit="us", utc=True)
        path = folder / f"{k}.parquet"
        pdf.to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_600_000_000 + k, 1_600_000_000 + k))
    return spark.readStream.schema("user_id long, t_us long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))


def us(day, second=0):
    return int(datetime.datetime(2024, 1, day, tzinfo=datetime.UTC).timestamp() * 1e6) + second * 1_000_000


def order():
    """A machine that tells the place of each row among those stepped; a local class, which workers get by value."""

    class Order:
        def __init__(self):
            self.n = 0

        def step(self, row):
            self.n += 1
            return {"user_id": int(row["user_id"]), "t_us": int(row["t_us"]), "place": self.n}

    return Order


def test_late_rows_are_counted_and_not_stepped(spark, tmp_path):
    files = [[(1, us(10)), (2, us(10))], [(1, us(9, 3600 * 20)), (1, us(12))], [(2, us(14))], [(1, us(11)), (1, us(13))], [(1, us(14, 5)), (1, us(11, 1))]]
    rows = stream_of_files(spark, tmp_path, files)
    out = machines.fold_stream(rows, ["user_id"], ["t_us"], order(), "user_id long, t_us long, place long, late long", delay="1 day", late="late")
    found = sorted(tuple(r) for r in runs.append_all(out, "late").select("user_id", "t_us", "place", "late").collect() if r["t_us"] is not None)
    notes = sorted((r["user_id"], r["late"]) for r in runs.append_all(machines.fold_stream(stream_of_files(spark, tmp_path, files), ["user_id"], ["t_us"], order(), "user_id long, t_us long, place long, late long", delay="1 day", late="late"), "late").where("t_us IS NULL").collect())
    # The row of the 9th overtakes none that was released: it is within the day. Those of the 11th come after the 13th has passed.
    assert [r[:3] for r in found] == [(1, us(9, 3600 * 20), 1), (1, us(10), 2), (1, us(12), 3), (1, us(13), 4), (1, us(14, 5), 5), (2, us(10), 1), (2, us(14), 2)]
    assert notes == [(1, 1), (1, 2)]
    assert found[4][3] == 2


def test_idle_keys_lose_their_state(spark, tmp_path):
    files = [[(1, us(2)), (2, us(2))], [(2, us(10))], [(2, us(20))], [(1, us(21)), (2, us(22))]]
    schema = "user_id long, t_us long, place long"
    kept = machines.fold_stream(stream_of_files(spark, tmp_path, files), ["user_id"], ["t_us"], order(), schema, delay="1 hour")
    assert sorted(r["place"] for r in runs.append_all(kept, "kept").where("user_id = 1").collect()) == [1, 2]
    gone = machines.fold_stream(stream_of_files(spark, tmp_path, files), ["user_id"], ["t_us"], order(), schema, delay="1 hour", idle="5 days")
    found = runs.append_all(gone, "gone")
    assert sorted(r["place"] for r in found.where("user_id = 1").collect()) == [1, 1]  # the later row began anew
    assert sorted(r["place"] for r in found.where("user_id = 2").collect()) == [1, 2, 3, 4]  # its own rows kept it in time


def test_streams_have_sql():
    assert {n for n in BATCH if n not in ORACLE_SQL} <= {"stream_packet_claims", "stream_instance_semantics"}
