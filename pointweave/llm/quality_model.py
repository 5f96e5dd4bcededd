"""Quality classifier: ordinal cumulative-link regression on graded ratings, with hashed-text weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.textkit import LOWER, U64, mix, text_slices, word_bounds, word_hashes

#: Hashed features: words, word beginnings and statistics share one table of 2**BITS weights.
BITS = 22
#: Bytes of the word beginnings that are features of their own, for inflected words.
PREFIXES = (4, 5, 6, 8)
GRADES = 3  # 0 toxic, 1 poor, 2 good


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def text_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, feature places, values) of each whole text.

    Features are the distinct lower-cased words without punctuation, their beginnings, and bins of text statistics:
    shares of symbols, capitals and digits, mean word length, share of distinct words, length. A word counts once, so one bad word weighs the same in a short and a long text.
    """
    size = U64((1 << BITS) - 1)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#*$%&|<>!{}[]@~^=+_\\/"]] = True
    one = np.ones(1, np.float32)
    for at, end, data, offsets in text_slices(column):
        low = LOWER[data]
        starts, ends, rows = word_bounds(low, offsets)
        # The bare word: punctuation and symbols at its ends go.
        bare_data = np.where(letter[low], low, np.uint8(32))
        b_starts, b_ends, b_rows = word_bounds(bare_data, offsets)
        kinds, owners = [word_hashes(bare_data, b_starts, b_ends)], [b_rows]
        for k in PREFIXES:
            long = b_ends - b_starts > k
            kinds.append(word_hashes(bare_data, b_starts[long], b_starts[long] + k) ^ U64(k))
            owners.append(b_rows[long])
        hashes, owners = (np.concatenate(kinds) & size).astype(np.int64), np.concatenate(owners)
        keyed = np.sort((owners.astype(np.int64) << BITS) | hashes)
        keyed = keyed[np.r_[True, keyed[1:] != keyed[:-1]]] if len(keyed) else keyed
        hashes, bounds = keyed & int(size), np.searchsorted(keyed, np.arange(end - at + 1, dtype=np.int64) << BITS)
        words = np.searchsorted(rows, np.arange(end - at + 1))
        tokens = word_hashes(low, starts, ends)
        cum = {k: np.r_[0, np.cumsum(v)] for k, v in {"symbol": symbol[data], "upper": (data >= 65) & (data < 91), "digit": (data >= 48) & (data < 58), "letter": letter[data]}.items()}
        for r in range(end - at):
            lo, hi = offsets[r], offsets[r + 1]
            n, m = max(hi - lo, 1), words[r + 1] - words[r]
            letters = max(cum["letter"][hi] - cum["letter"][lo], 1)
            distinct = len(np.unique(tokens[words[r] : words[r + 1]])) / max(m, 1)
            stats = [
                min(int(40 * (cum["symbol"][hi] - cum["symbol"][lo]) / n), 12),
                min(int(20 * (cum["upper"][hi] - cum["upper"][lo]) / letters), 12),
                min(int(40 * (cum["digit"][hi] - cum["digit"][lo]) / n), 12),
                min(int(2 * (ends[words[r] : words[r + 1]] - starts[words[r] : words[r + 1]]).sum() / max(m, 1)), 30),
                min(int(10 * distinct), 10) if m >= 100 else 11 + min(int(5 * distinct), 5),
                min(int(np.log2(m + 1)), 16),
            ]
            coded = (mix(np.array(stats, U64) + np.arange(1, len(stats) + 1, dtype=U64) * U64(1000003)) & size).astype(np.int64)
            own = hashes[bounds[r] : bounds[r + 1]]
            yield at + r, np.concatenate([coded, own]), np.concatenate([np.repeat(one * np.float32(4.0), len(coded)), np.repeat(one * np.float32(0.2), len(own))])


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 - _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])


def fit(places: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, epochs: int = 8, rate: float = 0.15, decay: float = 1e-4, least_rows: int = 10) -> OrdinalModel:
    """Cumulative-link regression by AdaGrad over mini-batches, in a fixed order; classes are weighted to balance.

    The thresholds start at the grades' shares and move with the weights; they are kept in order. Features of fewer
    than least_rows rows keep a weight of 0, so that rare words are not learnt by heart.
    """
    n = len(grades)
    common = np.bincount(np.concatenate(places), minlength=1 << BITS) >= least_rows
    values = [v[common[p]] for p, v in zip(places, values, strict=True)]
    used = np.flatnonzero(common)
    column = np.zeros(1 << BITS, np.int32)
    column[used] = np.arange(len(used))
    places = [column[p[common[p]]] for p in places]
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-4)
    share = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1] / (n + GRADES)
    theta, t2 = np.log(share / (1 - share)), np.full(GRADES - 1, 1e-2)
    freq = np.bincount(grades, minlength=GRADES).astype(float)
    balance = np.sqrt(n / (GRADES * np.maximum(freq, 1)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            batch = order[lo : lo + 64]
            sizes = np.array([len(places[k]) for k in batch])
            cols, vals = np.concatenate([places[k] for k in batch]), np.concatenate([values[k] for k in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            score = np.bincount(row, weights=w[cols] * vals, minlength=len(batch))
            y = grades[batch]
            upper = np.where(y < GRADES - 1, _sigmoid(np.append(theta, 40.0)[y] - score), 1.0)
            lower = np.where(y > 0, _sigmoid(np.append(-40.0, theta)[y] - score), 0.0)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper), lower * (1 - lower)
            scale = balance[y] / len(batch)
            d_score = scale * (du - dl) / p  # of the negative log-likelihood
            grad = np.bincount(cols, weights=vals * d_score[row], minlength=len(used)) + decay * w
            g2 += grad * grad
            w -= rate * grad / np.sqrt(g2)
            d_theta = np.zeros(GRADES - 1)
            np.add.at(d_theta, y[y < GRADES - 1], -(scale * du / p)[y < GRADES - 1])
            np.add.at(d_theta, y[y > 0] - 1, (scale * dl / p)[y > 0])
            t2 += d_theta * d_theta
            theta = np.sort(theta - 0.1 * d_theta / np.sqrt(t2))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, theta)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labels(doc_id, quality, toxic): 0 toxic, 1 poor, 2 good; rows without both ratings are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> OrdinalModel | None:
    """A model from at most max_rows labelled documents, taken in the order of a hash of doc_id; None without labels.

    Features are made on the executors; of a fitting row only its hashed features reach the one fitting task. Ratings of
    one doc_id count once, with its worst grade; its rows count as often as they come. Null and empty texts have the
    features of an empty one; labels without a document, and documents with a null doc_id, train nothing.
    """
    rated = graded(labels)
    total = rated.count()
    if total > max_rows:
        rated = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(rated, "doc_id").select("grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p.astype(np.int32).tobytes(), v.astype(np.float32).tobytes()) for _, p, v in text_features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["grade", "p", "v"])

    def fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["p"], r["v"], r["grade"]) for b in batches for r in b.to_pylist())
        if rows:
            model = fit([np.frombuffer(r[0], np.int32) for r in rows], [np.frombuffer(r[1], np.float32) for r in rows], np.array([r[2] for r in rows]))
            used = np.flatnonzero(model.weights).astype(np.int32)
            parts = [used, model.weights[used], model.thresholds]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["p", "w", "t"])

    rows = chosen.mapInArrow(features, "grade int, p binary, v binary").repartition(1).mapInArrow(fit_all, "p binary, w binary, t binary").collect()
    if not rows:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(rows[0]["p"], np.int32)] = np.frombuffer(rows[0]["w"], np.float32)
    return OrdinalModel(weights, np.frombuffer(rows[0]["t"], np.float64))


def score_documents(docs: DataFrame, model: OrdinalModel | None, least_toxic_free: float = 0.5, least_good: float = 0.5) -> DataFrame:
    """docs plus grade_score, expected_grade, p_not_toxic, p_good and kept.

    expected_grade is the sum of the tail probabilities. A document is kept if P(not toxic) and P(good) reach their
    least values. Without a model (no labels) the new columns are null and every document is kept. Null and empty
    texts have only the features of an empty text. Own columns replace columns of the same name.
    """
    own = {"grade_score": "double", "expected_grade": "double", "p_not_toxic": "double", "p_good": "double", "kept": "boolean"}
    docs = docs.drop(*own)
    if model is None:
        return docs.withColumns({c: F.lit(True if c == "kept" else None).cast(t) for c, t in own.items()})
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} {t}" for c, t in own.items()])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # 2**BITS floats whatever the input
    at, names = docs.columns.index("text"), [*docs.columns, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = OrdinalModel(*sent.value)
        for batch in batches:
            score = np.array([float(known.weights[p] @ v) for _, p, v in text_features(batch.column(at))])
            tails = known.tails(score) if len(score) else np.zeros((0, GRADES - 1))
            kept = (tails[:, 0] >= least_toxic_free) & (tails[:, -1] >= least_good)
            more = [score, tails.sum(1), tails[:, 0], tails[:, -1], kept]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in more)], names=names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_documents() with a model trained on the labelled documents of the same corpus."""
    return score_documents(docs, train(docs, labels))
