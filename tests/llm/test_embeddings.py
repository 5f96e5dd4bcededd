import numpy as np

from pointweave.llm.embeddings import calibrated_count, similar_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=1, n=300, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    near = base[:60] + rng.normal(size=(60, dims)) * rng.uniform(0.05, 0.6, (60, 1))
    chain = np.cumsum(rng.normal(size=(40, dims)) * 0.12, axis=0) + base[0]
    x = np.concatenate([base, near, chain, base[:5], 3 * base[5:8]]).astype(np.float32)
    return [(int(i), [float(v) for v in r], 0) for i, r in zip(rng.permutation(len(x)) * 3, x, strict=True)]


def brute_force(rows):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    top = list(range(len(x)))
    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = i, j
        while top[a] != a:
            a = top[a]
        while top[b] != b:
            b = top[b]
        top[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    out = {}
    for i in range(len(x)):
        r = i
        while top[r] != r:
            r = top[r]
        out[ids[i]] = (int(link[i].sum()), ids[r])
    return out


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = vectors(seed)
        found = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
        want = brute_force(rows)
        assert set(found) == set(want)
        total = sum(n for n, _ in want.values())
        assert all(found[k][0] <= want[k][0] for k in want)
        assert sum(n for n, _ in found.values()) >= 0.98 * total
        assert sum(found[k] == want[k] for k in want) >= 0.97 * len(want)


def test_recall_of_borderline_pairs_in_many_dimensions(spark):
    """Pairs of cosine 0.9005 to 0.93 in 64 dimensions."""
    rng = np.random.default_rng(3)
    base, z = (rng.normal(size=(1500, 64)) for _ in range(2))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    z -= (z * base).sum(1, keepdims=True) * base
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.93, 1500)[:, None]
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * z]).astype(np.float32)
    found = similar_vectors(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], SCHEMA)).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * 3000 <= found <= 3000


def test_large_group_is_split_over_blocks(spark, monkeypatch):
    monkeypatch.setattr("pointweave.llm.embeddings.BLOCK", 300)
    monkeypatch.setattr("pointweave.llm.embeddings.TILE", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=16) + 0.02 * rng.normal(size=(1300, 16))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    found = similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(1299, 0)}


def test_tiles_of_a_loose_group_equal_brute_force(spark, monkeypatch):
    """A group in which about half of the pairs are linked, in lists of several blocks and tiles."""
    monkeypatch.setattr("pointweave.llm.embeddings.BLOCK", 150)
    monkeypatch.setattr("pointweave.llm.embeddings.TILE", 40)
    rng = np.random.default_rng(6)
    x = rng.normal(size=16) + 0.33 * rng.normal(size=(600, 16))
    rows = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    found = {r.vec_id: r.n_links for r in similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {k: n for k, (n, _) in brute_force(rows).items()}
    assert 0.2 * 600 * 599 < sum(want.values()) < 0.95 * 600 * 599
    assert all(found[k] <= want[k] for k in want) and sum(found.values()) >= 0.99 * sum(want.values())


def test_unusable_vectors_link_with_nothing(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 0.0]), (7, [1.0, 1.0]), (None, [1.0, 1.0])]
    found = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in found)
    assert got == [(-1, 3, 7, False)] + [(k, 0, k, True) for k in range(1, 7)] + [(7, 3, 7, True)] * 2 + [(8, 3, 7, False), (9, 0, 9, True)]
    assert similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_calibration():
    assert calibrated_count(64, 4096, 0.9) >= 2
    assert calibrated_count(64, 1024, 0.99) >= calibrated_count(64, 1024, 0.9)
