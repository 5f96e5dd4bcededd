import random
from hashlib import sha256

import numpy as np

from pointweave.llm import repeats
from pointweave.llm.repeats import common_prefix_intervals, remove_repeats, repeat_groups, repeat_report

SCHEMA = "doc_id long, text string"


def brute_force(docs):
    seen, out = set(), {}
    for k, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - 99):
            if (s := data[p : p + 100]) in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(s)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (k, len(data), sum(gone), spans, sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(15, 90)) for _ in range(12)]
    docs = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 400, "y" * 101, "y" * 100]
    for _ in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                at = rng.randrange(len(p))
                p = p[:at] + rng.choice("xyz") + p[at + rng.randint(0, 2) :]
            if rng.random() < 0.4:
                p = p[rng.randrange(len(p) // 2) :]
            parts += [p, text(rng.randint(0, 12))]
        docs.append(rng.choice([" ", "\n"]).join(parts))
    docs += docs[20:26]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return list(zip(order, docs))


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = planted(seed)
        found = repeat_report(spark.createDataFrame(docs, SCHEMA)).collect()
        expected = brute_force(docs)
        assert len(found) == len(docs)
        for r in found:
            assert tuple(r) == expected[r.doc_id]


def test_null_ids_repeated_rows_and_empty_table(spark):
    t = "".join(random.Random(8).choices("abcdefgh ", k=300))
    rows = [(None, t, 1), (3, t, 1), (3, t, 1), (5, t, 2)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in found) == [(-1, 0), (3, 0), (3, 0), (5, 300)]
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_interval_scan_equals_definition():
    rng = np.random.default_rng(4)
    for _ in range(200):
        common = rng.integers(0, 5, rng.integers(0, 12))
        found = set(common_prefix_intervals(common, 1))
        n, expected = len(common) + 1, set()
        for i in range(n):
            for j in range(i + 1, n):
                depth = common[i:j].min()
                if depth >= 1 and (i == 0 or common[i - 1] < depth) and (j == n - 1 or common[j] < depth):
                    expected.add((int(depth), i, j))
        assert found == expected


def test_groups_have_all_occurrences():
    p = bytes(range(33, 126)) + bytes(range(40, 90))
    data = np.frombuffer(b"1" + p + b"2" + b"3" + p + b"4" + b"5" + p + b"6", np.uint8)
    n = len(p) + 2
    starts = np.array([o + k for o in (0, n, 2 * n) for k in range(n - 99)])
    limits = (starts // n + 1) * n
    groups = list(repeat_groups(data, starts, limits, starts % n == 0))
    assert [(length, sorted(starts[m])) for length, m in groups] == [(len(p), [1, n + 1, 2 * n + 1])]


def test_hot_anchors_are_compared_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 5, raising=False)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    short, long = text(80), text(104)
    docs = planted(3)
    docs += [(1000 + k, f"{text(rng.randint(0, 60))}\n{long if k % 3 == 0 else short}\n{text(rng.randint(0, 60)) if k % 4 else 'the same end of a line'}") for k in range(60)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    expected = brute_force(docs)
    assert all(tuple(r) == expected[r.doc_id] for r in repeat_report(df).collect())
    compared = repeats._compared(repeats._with_runs(repeats._texts(df)))
    assert compared.where("windows > 0").groupBy("part").count().agg({"count": "max"}).first()[0] <= 5
    assert compared.where("windows = 0").count() > 0 and compared.where("windows = -1").count() > 0
