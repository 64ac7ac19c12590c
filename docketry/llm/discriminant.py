"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes ``len(FEATURES)`` transformed statistics of its bytes, words
and shingles.  Class means and covariances come from sums over all labelled
training rows (one small row of moments a task and class).  The covariance of a
class is shrunk towards the pooled one and that towards its mean variance, and
its Cholesky factor is kept; a text's score is the logistic of the difference
of the two log densities and log priors.

Cases: null text counts as empty; an empty text has statistics like any other.
Labels: null labels and documents with contradicting labels don't train.
Without labels every score is 0.5; with one class only, the score is that
class.  Rows that repeat a doc_id are scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, bags, by_slice
from .tables import durable, remainder

SHRINK_TO_POOLED, SHRINK_TO_SPHERE = 0.1, 0.02
FEATURES = (
    "log_words", "word_length", "word_length_spread", "marks", "upper", "digits", "beyond_ascii", "line_ends", "full_stops",
    "distinct_words", "top_word", "same_as_before", "repeated_runs", "bare_marks", "word_entropy", "exclamations",
)


def _mask(chars: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in chars]] = True
    return found


_MARKS = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])
_KINDS = {
    "marks": _MARKS,
    "upper": _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _mask("abcdefghijklmnopqrstuvwxyz"),
    "digits": _mask("0123456789"),
    "beyond": np.arange(256) >= 128,
    "ends": _mask("\n"),
    "stops": _mask("."),
    "shouts": _mask("!"),
}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of some texts given as bytes and offsets."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    n = {}
    for name, kind in _KINDS.items():
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=total[1:])
        n[name] = total[offsets[1:]] - total[offsets[:-1]]
        if name == "marks":
            marks = total
    words = Words(data, offsets)
    length = words.end - words.start
    count = np.maximum(np.bincount(words.row, minlength=rows), 1)
    mean = np.bincount(words.row, length, rows) / count
    spread = np.sqrt(np.maximum(np.bincount(words.row, length.astype(float) ** 2, rows) / count - mean**2, 0))
    keys, times = bags(words.row, words.hash)
    own = (keys >> np.uint64(48)).astype(np.int64)
    top = np.zeros(rows)
    np.maximum.at(top, own, times)
    entropy = np.log(count) - np.bincount(own, times * np.log(times), rows) / count
    distinct = np.bincount(own, minlength=rows)
    at, runs = words.shingles(5)
    keys, times = bags(words.row[at], runs)
    own = (keys >> np.uint64(48)).astype(np.int64)
    every = np.maximum(np.bincount(own, times, rows), 1)
    again = np.bincount(own, times * (times > 1), rows) / every
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    bare = marks[words.end] - marks[words.start] == length
    letters = np.maximum(n["upper"] + n["lower"], 1)
    root = np.sqrt
    return np.stack(
        [
            np.log1p(count), np.log1p(mean), np.log1p(spread), root(n["marks"] / size), root(n["upper"] / letters), root(n["digits"] / size),
            root(n["beyond"] / size), root(n["ends"] / count), root(n["stops"] / count), np.log1p(distinct) / np.log1p(count), root(top / count),
            root(np.bincount(words.row, same, rows) / count), root(again), root(np.bincount(words.row, bare, rows) / count),
            entropy / np.log1p(count), root(n["shouts"] / size),
        ],
        axis=1,
    )


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of each text; the only pass over the texts."""

    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        x = statistics(data, offsets)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return durable(texts.mapInArrow(lambda batches: by_slice(make, batches), "doc_id long, x array<double>"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Discriminant:
    """Means, Cholesky factors and log priors of the classes 0 and 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.classes = {}
        if not all(self.n.values()):
            return
        mean = {k: m[1] / m[0] for k, m in moments.items()}
        spread = {k: m[2] / m[0] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        total = sum(self.n.values())
        pooled = sum(self.n[k] * spread[k] for k in (0, 1)) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        pooled = pooled / np.outer(self.scale, self.scale)
        pooled = (1 - SHRINK_TO_SPHERE) * pooled + SHRINK_TO_SPHERE * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
        for k in (0, 1):
            own = spread[k] / np.outer(self.scale, self.scale)
            factor = np.linalg.cholesky((1 - SHRINK_TO_POOLED) * own + SHRINK_TO_POOLED * pooled + 1e-6 * np.eye(len(own)))
            self.classes[k] = (mean[k] / self.scale, np.linalg.inv(factor), np.log(self.n[k] / total) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5 if not sum(self.n.values()) else float(self.n[1] > 0))
        log = {}
        for k, (mean, whiten, rest) in self.classes.items():
            z = (x / self.scale - mean) @ whiten.T
            log[k] = rest - 0.5 * (z * z).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def trained(features: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of features(doc_id, x) and labels(doc_id, label)."""
    agreed = labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    rows = features.join(agreed.where("label = other").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")), "doc_id")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, label = _matrix(batch.column("x")), batch.column("label").to_numpy()
            for k in np.unique(label).tolist():
                own = x[label == k]
                made = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                total[k] = total[k] + made if k in total else made
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], ["label", "at", "v"])

    sums = rows.select("label", "x").mapInArrow(moments, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    d, found = len(FEATURES), {}
    for k in {r["label"] for r in sums}:
        v = np.array([r["v"] for r in sorted((r for r in sums if r["label"] == k), key=lambda r: r["at"])])
        found[k] = (v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d))
    return Discriminant(found)


def scored(features: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score): how likely label 1 is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose crc32 of the id leaves 1 by 3 are held out of training."""
    features = described(docs)
    known = labels.select("doc_id", F.col("quality").alias("label")).where(remainder("doc_id", 3) != 1)
    return scored(features, trained(features, known)).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts.  A doc_id that repeats stays if one of its texts is accepted."""
    bad = quality(docs, labels).groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0").select("doc_id")
    # each side through its alias: docs may have any other columns
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
