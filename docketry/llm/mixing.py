"""Mixing sources to target weights with soft membership.

A classifier learned from a labelled table gives each document a posterior over
domains: naive Bayes over hashed words, its log odds divided by the root of the
length and scaled by a factor fitted on labelled rows kept apart.  It is learned
from about ``SAMPLE`` labelled rows (the documented bound).  Then each document
gets a rate r >= 0 so that the expected tokens of each domain, the sum of
r * tokens * posterior, meet the targets: accelerated projected gradient on

    sum over domains of (expected - target)^2 / (2 * available)
    + RIDGE / 2 * sum over documents of tokens * (r - 1)^2

in the metric of the tokens.  There the step of a document depends on its
posterior and on one small vector for all documents, so an iteration is one
aggregate over (tokens, posterior) and the driver holds a vector of domains.

Cases: null texts are empty: no tokens, the prior as posterior.  Labels of other
domains, null ones and contradicting ones don't train.  Without labels the
posterior is even.  A domain without tokens can't meet its target; the others
still do.  Rows that repeat a doc_id get a rate each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, by_slice, lists
from .tables import durable

BUCKETS = 1 << 16
SAMPLE = 20_000
SMOOTHING = 0.5
RIDGE = 1e-3
#: The fit ends when each domain is as near to its own target as TOLERANCE of it, or after ITERATIONS.
ITERATIONS = 80
TOLERANCE = 2e-3
ROWS_PER_TASK = 100_000
#: Shares of the tokens by domain of the labels table.
TARGETS = {"good": 0.85, "low": 0.10, "toxic": 0.05}


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets)
    return words.row, (words.hash >> U(48)).astype(np.int64) % BUCKETS


class Bayes:
    """Log odds of hashed words by domain, log priors and the factor of the posterior."""

    def __init__(self, domains: list[str], counts: np.ndarray, texts: np.ndarray, factor: float = 1.0):
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
        every = (counts.sum(axis=0) + SMOOTHING) / (counts.sum() + SMOOTHING * counts.shape[1])
        self.odds = (np.log(share) - np.log(every)).T.astype(np.float32)
        self.prior = np.log((texts + 1) / (texts + 1).sum())
        self.domains, self.factor = domains, factor

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed log odds over the root of the length, words) of each text."""
        row, bucket = _words(data, offsets)
        rows = len(offsets) - 1
        n = np.bincount(row, minlength=rows)
        total = np.stack([np.bincount(row, self.odds[bucket, k], rows) for k in range(len(self.domains))], axis=1)
        return total / np.sqrt(np.maximum(n, 1))[:, None], n

    def posterior(self, evidence: np.ndarray, factor: float | None = None) -> np.ndarray:
        x = evidence * (self.factor if factor is None else factor) + self.prior
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)


def learned(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> Bayes:
    """The classifier of labelled(doc_id, domain); a fifth of its rows fits the factor."""
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
    known = known.where("domain = other").select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
    rate = min(1.0, sample / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate * 1_000_003
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = durable(texts.where(drawn).join(known.where(drawn), "doc_id").select("domain", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(domains), BUCKETS + 1))
        for batch in batches:
            of = np.array([domains.index(x) for x in batch.column("domain").to_pylist()], int)

            def add(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> int:
                own = np.array([domains.index(x) for x in part.column("domain").to_pylist()], int)
                row, bucket = _words(data, offsets)
                np.add.at(total, (own[row], bucket), 1)
                return 0

            list(by_slice(add, iter([batch])))
            np.add.at(total[:, BUCKETS], of, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    counts = np.zeros((len(domains), BUCKETS + 1))
    for r in rows.where("NOT held").select("domain", "text").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.ravel()[r["at"]] = r["n"]
    model = Bayes(domains, counts[:, :BUCKETS], counts[:, BUCKETS])
    factors = np.geomspace(0.02, 20, 31)

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(factors))
        for batch in batches:

            def add(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> int:
                own = np.array([domains.index(x) for x in part.column("domain").to_pylist()], int)
                evidence, _ = model.evidence(data, offsets)
                for k, f in enumerate(factors):
                    total[k] -= np.log(np.maximum(model.posterior(evidence, f)[np.arange(len(own)), own], 1e-12)).sum()
                return 0

            list(by_slice(add, iter([batch])))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(factors)), pa.int32()), pa.array(total)], ["k", "loss"])

    held = sorted(rows.where("held").select("domain", "text").mapInArrow(loss, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect())
    if held and any(r["loss"] for r in held):
        model.factor = float(factors[int(np.argmin([r["loss"] for r in held]))])
    return model


def memberships(docs: DataFrame, model: Bayes) -> DataFrame:
    """(doc_id, n_tokens, p) with the posterior of each row; kept, as the fit reads it again and again."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        evidence, n = shared.value.evidence(data, offsets)
        p = shared.value.posterior(evidence)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), lists(p.ravel(), np.full(len(p), p.shape[1]), pa.float64())], ["doc_id", "n_tokens", "p"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: by_slice(make, batches), "doc_id long, n_tokens long, p array<double>")
    return durable(rows)


def _replayed(p: np.ndarray, pulls: list[np.ndarray], ahead: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, extrapolated rates) of posteriors p after the iterations whose common vectors are ``pulls``."""
    rate, look = np.ones(len(p)), np.ones(len(p))
    for pull, step in zip(pulls, ahead, strict=True):
        after = np.maximum(0.0, look - (p @ pull + RIDGE * (look - 1)) / (1 + RIDGE))
        look, rate = after + step * (after - rate), after
    return rate, look


def rates(members: DataFrame, targets: np.ndarray, iterations: int = ITERATIONS) -> tuple[list[np.ndarray], list[float]]:
    """The common vector of each iteration, from which _replayed() has every document's rate.  targets: tokens by domain."""
    few = members.select("n_tokens", "p").coalesce(max(1, members.count() // ROWS_PER_TASK))

    def expected(pulls: list[np.ndarray], ahead: list[float]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(targets))
            for batch in batches:
                if len(batch):
                    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                    total += (_replayed(p, pulls, ahead)[1] * batch.column("n_tokens").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

        found = np.zeros(len(targets))
        for r in few.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            found[r["k"]] = r["v"]
        return found

    pulls: list[np.ndarray] = []
    ahead: list[float] = []
    available, momentum = None, 1.0
    for _ in range(iterations):
        now = expected(pulls, ahead)
        if available is None:
            available = np.maximum(now, 1.0)
        gap = now - targets
        if (np.abs(gap) <= TOLERANCE * np.maximum(1.0, targets)).all():
            break
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pulls.append(gap / available)
        ahead.append((momentum - 1) / after)
        momentum = after
    return pulls, ahead


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, tokens: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, one p_<domain> a domain, rate) of each row of docs(doc_id, text).

    labelled: (doc_id, domain).  targets: shares of ``tokens``, by default of all tokens there are.
    """
    targets = TARGETS if targets is None else targets
    domains = sorted(targets)
    members = memberships(docs, learned(docs, labelled, domains))
    goal = np.array([targets[d] for d in domains])
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0) if tokens is None else tokens
    pulls, ahead = rates(members, goal / goal.sum() * total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_replayed(p, pulls, ahead)[0])], ["doc_id", "n_tokens", "p", "rate"])

    out = members.mapInArrow(run, "doc_id long, n_tokens long, p array<double>, rate double")
    return out.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)], "rate")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks: toxic, else low or good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain"))
