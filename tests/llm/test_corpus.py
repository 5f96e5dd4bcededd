import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from pointweave.llm.mixing import hash_threshold_mix, source_targets
from pointweave.llm.pieces import PieceModel, encode_batches, encode_texts
from pointweave.llm.queries import OP4_SQL, OP7_SQL, SHARDS, public_tokenizer
from pointweave.llm.sharding import assign_shards, lookup_table

MODEL = public_tokenizer("piece_bpe_32k.model")


def test_pieces_equal_the_library():
    model = PieceModel(MODEL)
    rng = random.Random(1)
    texts = ["", " ", "  a  b ", "\n\t", "▁", "▁▁a ▁ b", "é漢\U0001f642​", "<s> </s> <unk> <0x0A>", "\x00a\x01", "a" * 3000, " " * 500, "� x", "ab" * 40]
    texts += ["".join(rng.choice("ab  \n\té▁漢\U0001f642xyz0<>") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for t in texts:
        want = model.library.encode(t)
        n, ids, back = model.encoded(t)
        assert (n, ids, back) == (len(want), ",".join(map(str, want)), model.library.decode(want))
        assert model.decode(want) == back


def test_every_chunk_is_checked_against_the_library(monkeypatch):
    model = PieceModel(MODEL)
    rng = random.Random(6)
    for t in ["", " ", "a ", "  a   b  ", "▁", "▁▁", "<s> </s> <unk> <0x0A>", "\x00a", "é漢\U0001f642​", "z" * 2000]:
        model.encoded(t)
    for _ in range(500):
        model.encoded("".join(rng.choice("ab  \n\té▁漢\U0001f642xyz0<>") for _ in range(rng.randint(0, 60))))
    assert len(model.unchecked) > 1000
    model.check()
    assert not model.unchecked and not model.unchecked_length
    # A wrong merge of a word that only a late text holds is found, once the word is new.
    right = model.merge
    monkeypatch.setattr(model, "merge", lambda chunk: right(chunk)[::-1] if "zebra" in chunk else right(chunk))
    model.encoded("the crowd")
    model.check()
    model.encoded("the zebras")
    with pytest.raises(AssertionError, match="zebra"):
        model.check()
    # Many unchecked characters are compared before the batch ends.
    monkeypatch.setattr("pointweave.llm.pieces.CHECK_LENGTH", 50)
    with pytest.raises(AssertionError, match="zebra"):
        PieceModel.encoded(model, "zebra" * 20)


def test_heap_and_list_agendas_agree():
    model = PieceModel(MODEL)
    rng = random.Random(2)
    for _ in range(300):
        chunk = "▁" + "".join(rng.choice("theandingrous▁") for _ in range(rng.randint(33, 70)))
        assert model.merge(chunk) == model.merge_short(chunk)


def random_text(rng, most=60):
    return "".join(rng.choice("theandingrous  \n\té▁漢\U0001f642\u0378xyz0<>") for _ in range(rng.randint(0, most)))


def test_tables_of_chunks_equal_single_merges():
    model = PieceModel(MODEL)
    rng = random.Random(3)
    chunks = ["▁", "\u0378", "▁\u0378\u0378漢", "a" * 64, "▁" * 64, "▁the"]
    chunks += ["▁" + "".join(rng.choice("theandingrous▁漢\u0378") for _ in range(rng.randint(0, 63))) for _ in range(500)]
    assert model.merge_many(chunks) == [model.found(model.merge(c)) for c in chunks]
    assert model.merge_many([]) == []


@pytest.mark.parametrize("small", [False, True])
def test_new_chunks_of_many_texts_are_merged_together(monkeypatch, small):
    for name, value in {"PORTION": 7, "CACHE_CHUNKS": 20, "TABLE_ROWS": 2, "CHECK_CHUNKS": 2, "CHECK_LENGTH": 40}.items() if small else ():
        monkeypatch.setattr(f"pointweave.llm.pieces.{name}", value)
    model = PieceModel(MODEL)
    rng = random.Random(4)
    texts = ["", " ", "▁", "  a  b ", "a ", "x" * 65, "q" * 300 + " the " + "q" * 300, "the the"] + [random_text(rng) for _ in range(300)]
    right, calls = model.merge, []
    # Each of 3,000 new words and more was merged by itself in Python before; now only chunks of over 64 symbols are.
    monkeypatch.setattr(model, "merge", lambda chunk: calls.append(chunk) or right(chunk))
    found = model.encoded_many(texts)
    model.check()
    wants = [model.library.encode(t) for t in texts]
    assert found == [(len(w), ",".join(map(str, w)), model.library.decode(w)) for w in wants]
    assert {len(c) > 64 for c in calls} == {True}


def test_batches_stop_at_a_wrong_merge_each_time(monkeypatch):
    right = PieceModel.merge_many

    def wrong(self, chunks):
        return [(n, ",".join(ids.split(",")[::-1]), text) if "zebra" in c else (n, ids, text) for c, (n, ids, text) in zip(chunks, right(self, chunks))]

    def batches():
        yield pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the crowd", "the zebras"]})

    assert list(encode_batches(batches(), MODEL, 0))[0].num_rows == 2
    monkeypatch.setattr(PieceModel, "merge_many", wrong)
    for _ in range(2):
        with pytest.raises(AssertionError, match="zebra"):
            list(encode_batches(batches(), MODEL, 0))


def test_encode_edges(spark):
    rows = [(1, None, 1), (None, "a b", 2), (2, "", 3), (2, "", 3)]
    found = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == [(-1, 2), (1, 0), (2, 0), (2, 0)]
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def mix_rows(seed, hot=False):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        source = "hot" if hot and rng.random() < 0.6 else rng.choice([None, "a", "b", "ä", "c1", "z"])
        out.append((i if i % 50 else i // 100, source, rng.choice([None, "", "w " * rng.randint(0, 9), "x y"]) if rng.random() < 0.9 else "long " * 500, 1))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_mix_equals_sql_and_targets(spark, hot):
    rows = mix_rows(4, hot)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, taken int")
    found = hash_threshold_mix(df)
    got = sorted(map(str, (tuple(r) for r in found.select("doc_id", "size", "source_size", "target", "taken").collect())))
    con = duckdb.connect()
    documents = df.select("doc_id", "source", "text").toPandas()  # noqa: F841  read by name
    want = sorted(map(str, con.sql(OP4_SQL).fetchall()))
    assert got == want
    by = {}
    for r in found.collect():
        t = by.setdefault(r.source, [r.target, 0, 0])
        t[1] += r.taken
        t[2] = max(t[2], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken - target) <= largest for target, taken, largest in by.values())
    assert got == sorted(map(str, (tuple(r) for r in hash_threshold_mix(df.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect())))


def reshared(sizes, weight):
    """Targets by repeated capping."""
    left, capped = dict(weight), {}
    while True:
        share = (sum(sizes.values()) - sum(capped.values())) / sum(left.values())
        over = [s for s in left if share * left[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: share * w for s, w in left.items()}
        for s in over:
            capped[s] = 3 * sizes[s]
            del left[s]


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 5, "e": 200}
    found = {r.source: r.numer / r.denom for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weight = dict(zip(sorted(sizes), [5, 2, 1, 5, 2], strict=True))
    assert found == pytest.approx(reshared(sizes, weight))


def test_mix_of_nothing(spark):
    assert hash_threshold_mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    empty = hash_threshold_mix(spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")).collect()
    assert {(r.size, r.taken) for r in empty} == {(0, 0)}


def test_shards_are_even_and_stable(spark):
    shards = [f"s{k}" for k in range(10)]
    table = lookup_table(shards, 4099)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert [shards[k] for k in table] == [list(reversed(shards))[k] for k in lookup_table(list(reversed(shards)), 4099)]
    fewer = lookup_table(shards[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.2 * 4099
    with pytest.raises(ValueError):
        lookup_table(shards, 4098)
    df = spark.range(2000).select("id").withColumn("shard", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    found = assign_shards(df, "id", shards, 4099)
    assert found.count() == 2000 and found.groupBy("shard").count().agg({"count": "max"}).first()[0] < 300
    rows = assign_shards(spark.createDataFrame([(None,), (None,), (5,)], "id long"), "id", shards, 4099).collect()
    assert len(rows) == 3 and rows[0].shard is not None
    assert assign_shards(spark.createDataFrame([], "id long"), "id", shards, 4099).count() == 0


def test_shards_equal_sql_and_a_plain_filling(spark):
    from hashlib import blake2b

    number = lambda s, salt: int.from_bytes(blake2b(f"{salt}:{s}".encode(), digest_size=8).digest(), "big")
    for names, size in ((["b", "a", "c"], 11), ([f"n{k}" for k in range(7)], 101)):
        orders = {s: [(number(s, "offset") % size + i * (number(s, "skip") % (size - 1) + 1)) % size for i in range(size)] for s in names}
        owner = {}
        while len(owner) < size:
            for s in sorted(names):
                free = [slot for slot in orders[s] if slot not in owner]
                if free:
                    owner[free[0]] = s
        assert [names[k] for k in lookup_table(names, size)] == [owner[slot] for slot in range(size)]
    rows = [(k, f"s{k % 3}", k) for k in range(3000)] + [(None, None, 1), (5, "s", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_chars long")
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    got = sorted(map(str, (tuple(r) for r in assign_shards(df, "doc_id", SHARDS).select("doc_id", "source", "n_chars", "slot", "shard").collect())))
    assert got == sorted(map(str, con.sql(OP7_SQL).fetchall()))


def test_near_dedup_keeps_one_row_of_repeated_documents(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(4, text, "en", "s", 1), (4, text, "en", "s", 1), (9, text + " x", "en", "s", 1), (5, None, None, None, None), (5, None, None, None, None)]
    rows += [(6, "b c", "en", "s", 1), (6, "a", "en", "t", 2), (None, "", "en", "s", 0), (None, "", "en", "s", 0), (7, "", None, "s", 0)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id long")
    found = pipeline.near_dedup(spark, df, "")
    assert found.columns == list(pipeline.COLUMNS)
    kept = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in found.collect()), key=str)
    assert kept == sorted([(4, text), (5, None), (6, "a"), (-1, ""), (-1, ""), (7, "")], key=str)


def test_pipeline_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept int, spans string, copies int, h1 int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (None, "x y", "en", "s", 3), (3, "long " * 100_000, "en", "s", 5)]
    for rows in ([], [(*r, 0, "z", 1, 1) for r in odd]):
        df = spark.createDataFrame(rows, columns)
        for name, stage in pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
            assert name == "encode" or df.columns == list(pipeline.COLUMNS)
        assert df.count() <= len(rows) * 3
        if not rows:
            assert df.count() == 0


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(500):
        t = text(rng.randint(40, 90))
        if i % 6 == 0:
            t = " ".join(w + "$$$" for w in t.split())
        labels.append((i, 0 if i % 6 == 0 else 1, 0))
        docs.append((i, t, "en", f"src{i % 3}", len(t)))
    docs[7] = (7, docs[1][1], "en", "src1", 1)
    docs[8] = (8, docs[2][1] + " token = 24be64439e3e49cf46b2d7c90f3602a3", "en", "src2", 1)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now.collect()
        if name != "encode":
            assert now.columns == list(pipeline.COLUMNS)
    good = {i for i in range(500) if i % 6}
    kept = {r.doc_id for r in seen["quality"]}
    assert len(good - kept) <= 5 and len(kept - good) <= 3
    assert kept - {r.doc_id for r in seen["near_dedup"]} <= {7, 8} and 7 not in {r.doc_id for r in seen["near_dedup"]}
    clean = {r.doc_id: r for r in seen["secrets"]}
    assert all("24be64439e" not in r.text and r.n_chars == len(r.text) for r in clean.values())
    sizes = Counter()
    for r in seen["secrets"]:
        sizes[r.source] += len(r.text.split())
    mixed = Counter()
    for r in seen["mix"]:
        mixed[r.source] += len(r.text.split())
    targets = reshared({f"src{k}": sizes[f"src{k}"] for k in range(3)}, {"src0": 5, "src1": 2, "src2": 1})
    assert all(abs(mixed[s] - t) < 120 for s, t in targets.items())
    model = PieceModel(MODEL)
    want = Counter((r.doc_id, len(model.library.encode(r.text))) for r in seen["mix"])
    assert Counter((r.doc_id, r.n_tokens) for r in seen["encode"]) == want
    assert Counter((r.doc_id, r.n_tokens) for r in pipeline.run(spark, str(tmp_path)).collect()) == want
