"""Classify a corpus: documents to evidence, profiles, paths and candidates.

All keys nest in doc_id and the sentences are dealt by it once, so windows and
aggregates by (doc, signal) or (doc, profile) need no further exchange.  The
evidence and the polarities, far smaller than the texts, feed five later steps:
they are kept (spilling to disk), so the patterns run over the texts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from docketry.operators import evidence as ev
from docketry.operators import profiles as pr


@dataclass(frozen=True)
class Classified:
    """The tables of the chain; each is lazy."""

    docs: DataFrame
    evidence: DataFrame
    effective: DataFrame
    contradictions: DataFrame
    signals: DataFrame
    scores: DataFrame
    eligibility: DataFrame
    ranked: DataFrame
    paths: DataFrame
    missing: DataFrame
    candidates: DataFrame


def classify(docs: DataFrame) -> Classified:
    """docs(doc_id, text)."""
    evidence = ev.source_evidence(docs).persist(StorageLevel.MEMORY_AND_DISK)
    effective = ev.effective_polarity(evidence).persist(StorageLevel.MEMORY_AND_DISK)
    contradictions = ev.contradictory_pairs(evidence)
    signals = pr.score_signals(evidence, effective)
    scores = pr.score_profiles(signals)
    eligibility = pr.eligible_profiles(scores, effective, contradictions)
    ranked = pr.rank_profiles(docs, eligibility).persist(StorageLevel.MEMORY_AND_DISK)
    paths = pr.open_paths(ranked, effective)
    candidates = pr.propose_candidates(paths, ev.affirmed_crypto(docs))
    return Classified(docs, evidence, effective, contradictions, signals, scores, eligibility, ranked, paths, pr.missing_evidence(ranked), candidates)
