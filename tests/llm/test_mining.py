"""Collocations, fingerprints and ranked search against plain code."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import collocations as C
from pointweave.llm import fingerprints as P
from pointweave.llm import search as S

WORDS = ["ba", "Re", "co", "da-x", "éa", "7a", "Zoo", "mi", "no", "pe"]


def texts(n, seed=1, longest=60):
    r = random.Random(seed)
    made = []
    for _ in range(n):
        made.append("".join(r.choice(WORDS[: r.randint(2, len(WORDS))]) + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(r.randint(0, longest))))
    return made


# --- fingerprints ---------------------------------------------------------------------------------------------------


def plain_report(rows):
    """edit_report by its docstring: a list in ascending order, each with the one before it."""
    known = sorted({(d, t or "") for d, t in rows if d is not None})
    assert len({d for d, _ in known}) == len(known), "for rows without different texts of one doc_id"
    follow = {d: known[k - 1][1] for k, (d, _) in enumerate(known)}
    out = []
    for d, t in rows:
        t = t or ""
        other = follow.get(d, "") if d is not None else ""
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        a, b, c = P.fingerprint(t), P.fingerprint(new), P.fingerprint(other)
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), P.as_string(a), P.as_string(b), P.likeness(a, b), P.likeness(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_edit_report_equals_a_plain_loop(spark, n):
    made = texts(n, seed=n)
    rows = [(7 * k * k - 50, t) for k, t in enumerate(made)]
    if n == 300:
        rows += [(None, "no place of its own"), (None, None), (10**15, None), (2**63 - 1, "last 🙂 one" * 300), (-(2**63), "first"), rows[3], rows[3], rows[4]]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fingerprint string, copies long").repartition(5)
    got = [tuple(r) for r in P.edit_report(docs).collect()]
    assert sorted(got, key=repr) == plain_report(rows)


def test_hot_doc_id_with_different_texts_is_dealt_over_parts(spark):
    made = sorted({f"text number {k} of one document" for k in range(400)})
    rows = [(5, t) for t in made] + [(k, f"other {k}") for k in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cuts, hashes = P._bounds(docs.select("doc_id"), 4)
    assert (cuts == 5).sum() == 3 and len(set(hashes.tolist())) == 3
    got = P.edit_report(docs)
    assert got.count() == len(rows)
    by_hash = [r["text"] for r in docs.where("doc_id = 5").orderBy(F.xxhash64("text")).collect()]
    want = {hashlib.sha256(P.edited(t, by_hash[k - 1] if k else "other 39").encode()).hexdigest() for k, t in enumerate(by_hash)}
    assert {r["edited_sha256"] for r in got.where("doc_id = 5").collect()} == want


def plain_order_minhash(items):
    """Every round over all k-mers, without short cuts."""
    t = P.COORDINATES
    chosen = []
    hashed = [P.mix(items ^ P.SEEDS[i]) for i in range(2 * t)]
    for j in range(t):
        order = []
        for i in range(t):
            mine = np.flatnonzero((hashed[i] & np.uint64(t - 1)) == j)
            order += sorted((i, int(hashed[i][k] >> np.uint64(15)), int(k)) for k in mine)
        order += sorted((t + j, int(hashed[t + j][k] >> np.uint64(15)), int(k)) for k in range(len(items)))
        kept = []
        for _, _, k in order:
            if k not in kept and len(kept) < P.TUPLE:
                kept.append(k)
        chosen.append(sorted(kept))
    return np.array(chosen)


@pytest.mark.parametrize("n", [3, 17, 200, 5000])
def test_selected_kmers_are_the_least_of_all_rounds(n):
    items = P.mix(np.arange(n, dtype=np.uint64) + np.uint64(99))
    assert (P._chosen(items) == plain_order_minhash(items)).all()


def test_kmers_are_numbered_by_their_earlier_occurrences():
    text = "abcdefgh" * 3
    plain, seen = [], Counter()
    for k in range(len(text) - P.K + 1):
        gram = text[k : k + P.K]
        plain.append((gram, seen[gram]))
        seen[gram] += 1
    items = P.kmers(text)
    assert len(items) == len(plain) == len(set(items.tolist()))
    assert items[0] != items[8] and P.kmers("abcdefgh")[0] == items[0]


def test_likeness_follows_edit_distance_and_order():
    r = random.Random(5)
    sentences = [" ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(12)) + ". " for _ in range(80)]
    text = "".join(sentences)
    own = P.fingerprint(text)
    like = lambda x: P.likeness(own, P.fingerprint(x))
    one, many = text.replace(text[100], "Z", 1), "".join("Z" if k % 40 == 7 else c for k, c in enumerate(text))
    assert like(text) == 1.0 and like(one) > 0.9 > like(many) > 0.3
    turned = "".join(reversed(sentences))
    assert len(set(P.kmers(text).tolist()) & set(P.kmers(turned).tolist())) > 0.8 * len(text)  # the same k-mers in another order
    assert like(turned) < 0.6 and like("".join(r.choices("abcdefghij ", k=5000))) < 0.05
    assert P.likeness(P.fingerprint(""), P.fingerprint("")) == 1.0 and P.likeness(P.fingerprint(""), P.fingerprint("a")) == 0.0


# --- ranked search --------------------------------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    import math

    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, words = len(counted), sum(n for *_, n in counted)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(1 for _, x, _ in counted if t in x) + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                scored.append((-score, d is None, d, score))
        out += [(i, rank + 1, d, score) for rank, (_, _, d, score) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [16_384, 9])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_TERMS", block)
    monkeypatch.setattr(S, "TREE", 64)
    docs = [(k, t) for k, t in enumerate(texts(200, seed=3))]
    docs += [(900, docs[5][1]), (901, docs[5][1]), (902, None), (903, ""), (904, ".,;"), (None, docs[6][1]), (7, docs[7][1]), (905, "mi " * 5000)]
    items = [(k, t) for k, t in enumerate(texts(12, seed=4, longest=8))] + [(50, None), (51, "unheard-of"), (52, "MI no"), (52, "pe"), (None, "zoo 7A")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score long").repartition(4)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    got = S.ranked_search(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert S.ranked_search(none, asked).count() == 0
    assert S.ranked_search(some, asked.limit(0)).count() == 0
    assert [tuple(r) for r in S.ranked_search(some, asked).select("item_id", "rank", "doc_id").collect()] == [("x", 1, 1)]


def test_ball_tree_prunes_and_stays_exact():
    r = np.random.default_rng(2)
    n, v = 4000, 400
    centre = r.integers(0, 40, n)
    lists = [np.unique(np.concatenate([c * 10 + r.integers(0, 10, 8), r.integers(0, v, 1)])) for c in centre]
    cuts = np.append(0, np.cumsum([len(x) for x in lists]))
    terms = np.concatenate(lists)
    parts = r.integers(1, 10**9, len(terms))
    weights = r.integers(1, 9000, v)
    parts *= weights[terms]
    parts //= 9000
    tree = S.BallTree(cuts, terms, parts, S.bands(weights))
    leaves = sum(not c for *_, c in tree.balls)
    key = r.permutation(n).astype(np.int64)
    for q in range(20):
        wanted = np.arange(q * 10, q * 10 + 6)
        scores = np.array([parts[a:b][np.isin(terms[a:b], wanted)].sum() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        want = sorted((-int(s), int(key[d])) for d, s in enumerate(scores) if s > 0)[:10]
        got = sorted((-s, int(key[d])) for s, d in tree.best(wanted, 10, 1, key))
        assert got == want
        every = tree.bounds(wanted)
        assert all(every[j] >= scores[tree.order[lo:hi]].max() for j, (lo, hi, _) in enumerate(tree.balls))
    assert tree.opened < 20 * leaves / 2


# --- collocations ---------------------------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, most):
    out = []
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for lang in n:
        scored = []
        for (own, p), a in found.items():
            if own != lang:
                continue
            longer = [b for (x, q), b in found.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if longer and 100 * max(longer) >= 100 * a:
                continue
            s, k, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank + 1, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "sent"), [(6 << 20, 1_000_000), (300, 0)])
def test_collocations_equal_brute_force(spark, monkeypatch, chunk, sent):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "MOST_SENT", sent)
    made = texts(240, seed=8)
    rows = [(["en", "fr", None, "und"][k % 4], t) for k, t in enumerate(made)] + [("en", None), ("en", ""), ("de", ".,\n"), ("en", "x" * 5000), ("en", "ba ba ba ba ba ba"), ("fr", made[1]), ("fr", made[1])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, n long").repartition(3)
    got = C.collocations(docs, 5, 6, 50)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 5, 6, 50)
    assert dict(got.dtypes)["rank"] == "bigint" and dict(got.dtypes)["score"] == "bigint"


def test_collocations_of_nothing_and_large_products(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    x = spark.createDataFrame([(9 * 10**12, 10**13, 9 * 10**12, 10**13)], "a long, n long, l long, r long").selectExpr(*(f"CAST({c} AS DECIMAL(19,0)) AS {c}_x" for c in "anlr"))
    assert x.selectExpr("(a_x * n_x * 1000) div (l_x * r_x) AS s").first()["s"] == 1000
