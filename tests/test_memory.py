"""The evidence memory against a plain simulation, frame by frame."""

import random

import pytest

from pointweave.operators import memory


def simulated(records, fronts, margin, per_cell, most_age, frames):
    """(id, at, readable, revoked) by keeping the memory itself: prepare, read, write, in each frame."""
    held, out = [], []
    for at in frames:
        held = [h for h in held if at - h["frame"] <= most_age]
        stays = []
        for h in held:
            front = fronts.get((at, h["ray"]))
            if front is not None and h["r"] < front - margin:
                out.append((h["id"], at, False, True))
            else:
                out.append((h["id"], at, not (front is not None and h["r"] > front + margin), False))
                stays.append(h)
        held = [r for r in records if r["frame"] == at] + stays
        cells = {}
        for h in sorted(held, key=lambda h: -h["frame"]):
            cells.setdefault(h["cell"], []).append(h)
        held = [h for c in cells.values() for h in c[:per_cell]]
    return sorted(out)


def made(records):
    return [(r["frame"], *r["cell"], r["id"], r["ray"], r["r"]) for r in records]


SCHEMA = "frame int, gx long, gy long, gz long, id long, ray long, r long"


@pytest.mark.parametrize("seed", range(4))
def test_evidence_equals_a_simulation(spark, seed):
    r = random.Random(seed)
    frames = range(25)
    records, n = [], 0
    for f in frames:
        for c in range(12):
            if r.random() < 0.7:
                n += 1
                records.append({"frame": f, "cell": (c, 0, -c), "id": n, "ray": c % 5, "r": r.randint(0, 100)})
    fronts = {(f, k): r.randint(0, 100) for f in frames for k in range(5) if r.random() < 0.8}
    f = spark.createDataFrame([(*k, v) for k, v in fronts.items()], "at int, ray long, front long")
    got = memory.evidence(spark.createDataFrame(made(records), SCHEMA), f, 10, 3, 6).where("at < 25")
    assert sorted(tuple(x) for x in got.select("id", "at", "readable", "revoked").collect()) == simulated(records, fronts, 10, 3, 6, frames)


def test_a_revoked_record_frees_its_place(spark):
    """Of five records of a cell, the second is revoked after two more writes: the first stays a write longer."""
    records = [{"frame": k, "cell": (0, 0, 0), "id": k, "ray": 0 if k == 1 else 1, "r": 10} for k in range(5)]
    rows = spark.createDataFrame(made(records), SCHEMA)
    fronts = lambda at: spark.createDataFrame([(at, 0, 100)], "at int, ray long, front long")
    last = lambda at: {x["id"]: x["last"] for x in memory.kept_until(rows, fronts(at), 5, 3, 50).collect()}
    assert last(90)[0] == 3 and last(2)[0] == 4  # without and with the revocation
    told = memory.evidence(rows, fronts(2), 5, 3, 50).where("id = 1").select("at", "revoked").collect()
    assert [tuple(x) for x in told] == [(2, True)]
