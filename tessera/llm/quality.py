"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is linear in features of its text: shares of character classes, repeats and lengths of words, and
shares of hashed words and pairs of neighbouring words. The weights are learned from preference pairs, each a
document labelled good and one labelled bad, by logistic loss on the difference of their features. The
threshold is the quantile of the training scores at the share of bad documents among them; scores are
mapped to 0..1 so that the threshold lies at THRESHOLD.

Training uses a bounded sample: of the labelled rows those whose hash falls below TRAIN_ROWS / (their count),
so about TRAIN_ROWS at any size of input. Scoring covers every whole text in one pass.

Nulls: a null text is empty; empty texts have all features 0 and a score like others. Labels that are null do not
count; labels of one doc_id that disagree are averaged. Where only one class is labelled, or none, every score
is 0.5. Rows that repeat are scored alike. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textbytes as tb
from tessera.llm.common import small_batches, table, uniform

#: Labelled rows that the weights are learned from, about.
TRAIN_ROWS = 20_000
#: Preference pairs for each document of the commoner class, and in all at most; like TRAIN_ROWS a bound of the training sample.
PAIRS_EACH, PAIRS = 16, 100_000
#: Pairs that are held at once.
STEP_PAIRS = 2048
#: Buckets of hashed words and word pairs, and the words by which short texts' shares are drawn to 0.
HASHED, SHRINK = 256, 20
RIDGE = 1e-3
#: Where on the 0..1 scale the quantile threshold lies.
THRESHOLD = 0.3
#: Documents of one in so many remainders of crc32(doc_id) are held out.
FOLDS = 5
_MARKS = b"$&%#*~^=<>@_\\/{}[]+"
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": _MARKS,
    "bar": b"|",
    "shout": b"!?",
    "stop": b".,;:",
    "line": b"\n",
}
_SURFACE = (*_CLASSES, "marked_words", "again", "distinct", "word_length", "long_words", "length")
SURFACE = len(_SURFACE)
FEATURES = (*_SURFACE, *(f"hash{k}" for k in range(HASHED)))
_PAIR = np.uint64(0xD1342543DE82EF95)


def _class_masks() -> np.ndarray:
    masks = np.zeros((len(_CLASSES), 256), bool)
    for row, members in zip(masks, _CLASSES.values(), strict=True):
        row[list(members)] = True
    return masks


_MASKS = _class_masks()


def _sums(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=docs)


def features(column: pa.Array) -> np.ndarray:
    """One row of features for each text."""
    parts = [np.zeros((0, len(FEATURES)))]
    for first, last, data, offsets in tb.chunks(column):
        docs = last - first
        out = np.zeros((docs, len(FEATURES)))
        size = np.maximum(np.diff(offsets), 1)
        for k, mask in enumerate(_MASKS):
            total = np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])
            out[:, k] = np.diff(total[offsets]) / size
        start, end, doc = tb.words(data, offsets)
        n = np.bincount(doc, minlength=docs)
        some = np.maximum(n, 1)
        if len(start):
            tail = _MASKS[list(_CLASSES).index("mark")] | _MASKS[list(_CLASSES).index("shout")] | _MASKS[list(_CLASSES).index("bar")]
            out[:, 7] = _sums(tail[data[end - 1]], doc, docs) / some
            h = tb.word_hashes(data, start, end)
            again = np.zeros(len(h))
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            out[:, 8] = _sums(again, doc, docs) / some
            _, held = tb.distinct_by_doc(h, doc, docs)
            # texts repeat words as they grow, so the share is taken at the square root's scale
            out[:, 9] = np.diff(held) / some ** 0.75
            length = (end - start).astype(float)
            out[:, 10] = _sums(length, doc, docs) / some
            out[:, 11] = _sums(length > 25, doc, docs) / some
            # words and pairs of neighbours, hashed; short texts say little, so their shares are drawn to 0
            pair = tb.mix(h[:-1] * _PAIR + h[1:])[doc[1:] == doc[:-1]]
            grams, of = np.concatenate([h, pair]), np.concatenate([doc, doc[1:][doc[1:] == doc[:-1]]])
            cell = of * HASHED + (grams >> np.uint64(40)).astype(np.int64) % HASHED
            counts = np.bincount(cell, minlength=docs * HASHED).reshape(docs, HASHED)
            out[:, SURFACE:] = counts / (n + SHRINK)[:, None]
        out[:, 12] = np.log1p(n)
        parts.append(out)
    return np.concatenate(parts)


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.center) / self.scale).clip(-8, 8) @ self.weights
        at = self.slope * (z - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-at.clip(-500, 500)))


def constant_model() -> Model:
    """Gives every text 0.5."""
    return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), float(np.log(THRESHOLD / (1 - THRESHOLD))), 1.0)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights of the least ridge-penalised logistic loss of x @ w against y in 0..1."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-500, 500)))
        gradient = x.T @ (p - y) / len(x) + ridge * w
        hessian = (x.T * (p * (1 - p))) @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def preferences(ups: np.ndarray, downs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (preferred, other) of a good and a bad document, PAIRS_EACH for each document of the commoner class."""
    rng = np.random.default_rng(7)
    n = min(PAIRS, PAIRS_EACH * max(len(ups), len(downs)))
    return ups[rng.integers(0, len(ups), n)], downs[rng.integers(0, len(downs), n)]


def ranking(z: np.ndarray, a: np.ndarray, b: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights of the least mean of log(1 + exp(-(z[a] - z[b]) @ w)) + ridge * |w|^2 / 2, pairs a few at a time."""
    k = z.shape[1]
    w = np.zeros(k)
    for _ in range(steps):
        gradient, hessian, margin = ridge * w, ridge * np.eye(k), z @ w
        for i in range(0, len(a), STEP_PAIRS):
            u, v = a[i : i + STEP_PAIRS], b[i : i + STEP_PAIRS]
            x = (z[u] - z[v]).astype(float)
            p = 1 / (1 + np.exp(-(margin[u] - margin[v]).clip(-500, 500)))
            gradient = gradient + x.T @ (p - 1) / len(a)
            hessian += (x.T * (p * (1 - p))) @ x / len(a)
        step = np.linalg.solve(hessian, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray) -> Model:
    """Learn from features and labels; the order of the rows does not matter to callers that sort them."""
    ups, downs = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(ups) or not len(downs):
        return constant_model()
    center, scale = x.mean(0, dtype=float), x.std(0, dtype=float)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = x - center.astype(x.dtype)  # a copy of its own type, which is changed in place
    z /= scale.astype(x.dtype)
    z.clip(-8, 8, out=z)
    weights = ranking(z, *preferences(ups, downs), RIDGE)
    s = z @ weights
    order, bad = np.sort(s), len(downs)
    cut = float((order[bad - 1] + order[bad]) / 2)
    slope = max(float(_newton((s - cut)[:, None], good.astype(float), RIDGE)[0]), 1e-3)
    return Model(center, scale, weights, cut, slope)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("_good"))
    share = rows / max(known.count(), 1)
    picked = known.filter(uniform(F.col("doc_id"), F.lit(8)) < share)  # about `rows` rows, so small
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "_good", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.float32)), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_good"), flat], ["doc_id", "_good", "x"])

    found = texts.mapInArrow(tb.lean(measured), "doc_id bigint, _good boolean, x array<float>").toArrow()
    if not found.num_rows:
        return constant_model()
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    good = np.array(found["_good"].to_pylist(), bool)
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))
    return fit(x[order], good[order])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with each text's score; all columns of docs stay."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            for part in tb.slices(batch, at):
                score = model.score(features(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(tb.lean(run), schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
