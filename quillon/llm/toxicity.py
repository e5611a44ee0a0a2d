"""Toxicity by non-negative positive-unlabelled learning (numpy).

A linear model over the presence of words and word beginnings is trained from confirmed toxic texts (P) and texts whose label is not looked at
(U). With the class prior p, the risk is p * R+(P) + max(0, R-(U) - p * R-(P)); when the second term of a batch falls below zero its gradient is
taken with the opposite sign, so the model cannot explain U away. Sigmoid loss, Adam, fixed seed. How telling a feature must be is chosen by folds
within the training rows; held-out rows are never read.

Training reads a bounded sample: at most `positives` confirmed texts and `unlabelled` others, the ones with the smallest hashes of their ids.
The sample is held by one task; scoring runs over all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm import _text
from quillon.runtime import materialize, ship

POSITIVES, UNLABELLED = 5_000, 12_000
BITS = 22
#: How many standard deviations more often than by chance a feature must be in P: one of these, chosen by folds. All such features are kept.
LEAST_Z, FOLDS = (3.0, 4.0, 5.0, 7.0, 10.0, 14.0), 3
#: Everything that is not an ASCII letter or digit or part of a longer character parts words.
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_STEMS = (4, 5, 6)


def features(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct feature numbers of each of consecutive texts: words and their first 4, 5 and 6 bytes (A-Z lower-cased)."""
    for a, b in _text.runs(at):
        for_text: list[np.ndarray] = []
        if b - a > 1 or at[b] - at[a] <= 2 * _text.CHUNK:
            f, doc = _features(data[at[a] : at[b]], at[a : b + 1] - at[a])
            bounds = np.searchsorted(doc, np.arange(b - a + 1))
            yield from (np.unique(f[bounds[i] : bounds[i + 1]]) for i in range(b - a))
            continue
        s, end = int(at[a]), int(at[b])
        while s < end:  # a very long text in pieces that end between words
            e = min(s + _text.CHUNK, end)
            while e < end and not _PARTS[_text.LOWER[data[e]]]:
                e += 1
            for_text.append(np.unique(_features(data[s:e], np.array([0, e - s]))[0]))
            s = e
        yield np.unique(np.concatenate(for_text))


def _features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text of each, ordered by text."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    low = _text.LOWER[data]
    parts = _PARTS[low]
    edge = np.ones(len(low) + 1, bool)
    edge[1:-1] = parts[1:] != parts[:-1]
    edge[bounds[bounds < len(low)]] = True
    edges = np.flatnonzero(edge)
    word = ~parts[edges[:-1]]
    start, end = edges[:-1][word], edges[1:][word]
    up, down = _text.powers(len(low))
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_text.TABLE[low] * up[: len(low)], out=total[1:])
    found = [_text.mix((total[end] - total[start]) * down[start])]
    for n in _STEMS:
        cut = np.minimum(start + n, end)
        found.append(_text.mix((total[cut] - total[start]) * down[start] + np.uint64(n)))
    doc = np.searchsorted(bounds, start, "right") - 1
    return (np.stack(found, 1).ravel() >> np.uint64(64 - BITS)).astype(np.int32), np.repeat(doc, len(found))


class Model:
    """score(features) = sigmoid(bias + sum of the weights of the features that the text has)."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.kept, self.weights, self.bias = kept, weights, bias

    def margin(self, found: np.ndarray) -> float:
        if not len(self.kept) or not len(found):
            return self.bias
        at = np.minimum(np.searchsorted(self.kept, found), len(self.kept) - 1)
        return self.bias + float(self.weights[at[self.kept[at] == found]].sum())

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(found), -30, 30))))


def _telling(p: list[np.ndarray], u: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of P, and how many standard deviations more often they are in P than by chance."""
    found, n_p = np.unique(np.concatenate(p), return_counts=True)
    n_u = np.zeros(1 << BITS, np.int32)
    for f in u:
        n_u[f] += 1  # distinct within a text
    rate = (n_u[found] + 0.5) / (len(u) + 1)
    return found, (n_p - len(p) * rate) / np.sqrt(len(p) * rate * (1 - rate).clip(1e-9) + 1)


class _Rows:
    """Texts as rows of a sparse 0/1 matrix over the kept features."""

    def __init__(self, texts: list[np.ndarray], kept: np.ndarray):
        found = []
        for f in texts:
            at = np.minimum(np.searchsorted(kept, f), len(kept) - 1)
            found.append(at[kept[at] == f])
        self.flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.ends = np.cumsum([0, *map(len, found)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features, and the place in `rows` of the row that has each."""
        n = self.ends[rows + 1] - self.ends[rows]
        who = np.repeat(np.arange(len(rows)), n)
        return self.flat[np.repeat(self.ends[rows] - np.cumsum(n) + n, n) + np.arange(len(who))], who


def fitted(p: list[np.ndarray], u: list[np.ndarray], prior: float, kept: np.ndarray, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0, seed: int = 7) -> Model | None:
    """The model of these texts over the kept features; none without any."""
    if not len(kept):
        return None
    k = len(kept)
    x_p, x_u = _Rows(p, kept), _Rows(u, kept)
    rng = np.random.default_rng(seed)
    theta, m, v, t = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1), 0
    theta[-1] = -1.0
    size = 512

    def scores(found: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(who, theta[found], n) + theta[-1], -30, 30)))

    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for b in range(max(1, len(u) // size)):
            rows_p, rows_u = order_p[np.arange(b * size, (b + 1) * size) % len(p)], order_u[b * size : (b + 1) * size]
            in_p, in_u = x_p.take(rows_p), x_u.take(rows_u)
            s_p, s_u = scores(*in_p, len(rows_p)), scores(*in_u, len(rows_u))
            # sigmoid loss: l(g) = sigmoid(-g) for positives, sigmoid(g) for negatives
            slope_p, slope_u = s_p * (1 - s_p) / len(s_p), s_u * (1 - s_u) / len(s_u)
            up, down = (np.append(np.bincount(found, slope[who], k), slope.sum()) for (found, who), slope in ((in_p, slope_p), (in_u, slope_u)))
            negative = s_u.mean() - prior * s_p.mean()
            g_neg = down - prior * up
            grad = g_neg - prior * up if negative >= -beta else -g_neg
            grad = grad + decay * np.append(theta[:-1], 0)
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(kept, theta[:-1], float(theta[-1]))


def chosen(p: list[np.ndarray], u: list[np.ndarray], prior: float, folds: int = FOLDS, choices: tuple[float, ...] = LEAST_Z) -> float:
    """The choice with the greatest recall ** 2 / share of texts said to be positive (what precision times recall follows without labels of U),
    over folds of P and U; of equals the strictest."""
    if min(len(p), len(u)) < 2 * folds:
        return choices[-1]
    hit, said = np.zeros(len(choices)), np.zeros(len(choices))
    for k in range(folds):
        inside = [[f for i, f in enumerate(x) if i % folds != k] for x in (p, u)]
        found, z = _telling(*inside)
        for c, least in enumerate(choices):
            model = fitted(*inside, prior, found[z >= least], epochs=15)
            if model is not None:
                hit[c] += sum(model.margin(f) >= 0 for f in p[k::folds])
                said[c] += sum(model.margin(f) >= 0 for f in u[k::folds])
    return max(zip((hit / len(p)) ** 2 / np.maximum(said, 1) * len(u), choices))[1]


def train(p: list[np.ndarray], u: list[np.ndarray], prior: float) -> Model:
    """Features of confirmed and of unlabelled texts -> model. Without both, or without any telling feature, the model says the prior."""
    model = None
    if p and u and 0 < prior < 1:
        least = chosen(p, u, prior)
        found, z = _telling(p, u)
        model = fitted(p, u, prior, found[z >= least])
    return model or Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))


def in_training(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is not 0; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic (null ignored; of several labels of an id the highest holds). Held-out ids are not read."""
    ship(docs.sparkSession)
    known = labels.where("toxic IS NOT NULL").where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = toxic / n if n else 0.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen_p = known.where("toxic = 1").select("doc_id").orderBy(*order).limit(positives).withColumn("p", F.lit(1))
    chosen_u = docs.where(in_training(F.col("doc_id"))).select("doc_id").orderBy(*order).limit(unlabelled).withColumn("p", F.lit(0))
    sample = F.broadcast(materialize(chosen_p.union(chosen_u), "sample"))  # at most positives + unlabelled ids

    @_text.frugal
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f.tobytes() for f in features(*_text.buffers(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("p"), pa.array(found, pa.binary())], ["doc_id", "p", "found"])

    @_text.frugal
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        p, u = ([np.frombuffer(f, np.int32) for _, kind, f in rows if kind == k] for k in (1, 0))
        model = train(p, u, prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.kept.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["kept", "weights", "bias"])

    texts = docs.select("doc_id", "text").join(sample, "doc_id").mapInArrow(extract, "doc_id long, p int, found binary")
    kept, weights, bias = texts.repartition(1).mapInArrow(learn, "kept binary, weights binary, bias double").first()
    return Model(np.frombuffer(kept, np.int32), np.frombuffer(weights, np.float64), bias)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name (0 to 1); null and empty texts get the score of a text without any feature."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(f) for f in features(*_text.buffers(b.column(at)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sample: int) -> DataFrame:
    """For every row: doc_id, held_out, score, predicted. Scores read nothing but the text, so equal texts have equal scores.

    A null id is scored and never learned from (held_out false). Without usable labels every score is 0.000001. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(docs, fit(docs, labels, **sample))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (with columns doc_id, text and others) without the rows that score 0.5 or more."""
    model = fit(docs.select("doc_id", "text"), labels)
    return scored(docs, model, "__score").where(F.col("__score") < 0.5).drop("__score")


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"))
