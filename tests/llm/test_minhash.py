import random
import re

import numpy as np

from pointweave.llm.minhash import fast_similarity_sketch, near_duplicates

SCHEMA = "doc_id long, text string, component_id long, kept string"


def brute_force(docs):
    """Every pair compared on sets of word tuples."""
    sets = []
    for k, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower() if text is None or text.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), text).encode())
        sets.append((k, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()))
    top = {k: k for k, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {(k, len(s), find(k), find(k) == k) for k, s in sets}


def near_copies(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = [None, "", " \t\n", "one", "One", "two words", "a b c d e", "A B C\nD E", "x" * 5000, "é " * 3000]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 300))]
        docs.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    docs += [docs[-1]] * 5
    return list(enumerate(docs))


def test_equals_brute_force(spark):
    docs = near_copies()
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == brute_force(docs)
    assert len(found) == len(docs)


def test_extra_columns_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2), (None, "alone in the world of words", 3)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [(-1, -1, True), (-1, 4, False), (4, 4, True), (4, 4, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 60, 1000):
        items = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = items[: int(1.5 * n) + 1], items[n // 2 :]
        same = (fast_similarity_sketch(a) == fast_similarity_sketch(b)).mean()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same - true) < 0.2
        assert (fast_similarity_sketch(a) == fast_similarity_sketch(a[::-1].copy())).all()


def test_loose_copies_without_their_origin(spark):
    """Copies that differ by edits of their own, some within 0.75 of each other, some of none."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(4):
        base = [word() for _ in range(rng.randint(60, 160))]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(1, max(2, len(base) // 30))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [word()]
            docs.append(" ".join(copy))
    docs = list(enumerate(docs))
    want = brute_force(docs)
    assert 4 < sum(kept for *_, kept in want) < 60
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == want


def test_crowded_shingles_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr("pointweave.llm.minhash.CROWD", 2)
    test_loose_copies_without_their_origin(spark)


def test_a_doc_id_with_several_texts_links_through_any_of_them(spark):
    rng = random.Random(12)
    text = lambda n: [rng.choice("abcdefghijklm") * rng.randint(1, 5) for _ in range(n)]
    a, b = text(80), text(90)
    rows = [(1, " ".join(a)), (5, " ".join(a + ["q"])), (5, " ".join(b)), (9, " ".join(b + ["r"])), (7, " ".join(text(70))), (5, None), (6, " ".join(b))]
    found = near_duplicates(spark.createDataFrame(rows, SCHEMA.split(", component")[0])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (5, 1, False), (5, 1, False), (5, 5, True), (6, 1, False), (7, 7, True), (9, 1, False)]
