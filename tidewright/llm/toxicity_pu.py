"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the sampled text as a whole, whatever its label, is unlabelled. A linear
model over the presence of word beginnings is fitted in numpy on the class-prior-corrected risk
pi R_p(+) + max(0, R_u(-) - pi R_p(-)). Word beginnings carry over to inflected and compound forms.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, texts
from .labelled import fold, sampled, training_labels

#: What is stripped from words, and the lengths of beginnings (0: the whole word).
STRIPPED = ".,;:!?*$%&#|\"'()[]{}<>-_"
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def beginnings(word: str) -> list[str]:
    """A word's features: its beginnings, and itself marked as whole."""
    word = word.strip(STRIPPED)
    return [word[:n] for n in BEGINNINGS if len(word) > n] + [word + "$"] if word else []


def document_features(text: str) -> set[str]:
    return {f for w in set(text.lower().split()) for f in beginnings(w)}


class PositiveUnlabelled:
    def __init__(self, vocabulary: list[str], prior: float):
        self.index = {f: k for k, f in enumerate(vocabulary)}
        self.prior = prior
        self.weights, self.bias = np.zeros(len(vocabulary)), -3.0
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        """What tasks get: the model without the words that this process has met."""
        return self.__dict__ | {"seen": {}}

    def columns(self, text: str) -> list[int]:
        """The features present in a text, all of it; words met before are looked up."""
        if len(self.seen) > 150_000:
            self.seen.clear()
        found: set[int] = set()
        for w in set(text.lower().split()):
            own = self.seen.get(w)
            if own is None:
                own = self.seen[w] = tuple(self.index[f] for f in beginnings(w) if f in self.index)
            if own:
                found.update(own)
        return sorted(found)

    def matrix(self, docs: list[str]) -> np.ndarray:
        X = np.zeros((len(docs), len(self.index)), np.float32)
        for k, t in enumerate(docs):
            X[k, self.columns(t)] = 1
        return X

    def fit(self, P: np.ndarray, U: np.ndarray, steps: int = 300, rate: float = 0.07, decay: float = 2e-5) -> PositiveUnlabelled:
        """Logistic loss; where the corrected negative risk falls below zero, its gradient is turned round, so that the
        unlabelled risk can't be driven negative by over-fitting the positives."""
        theta = np.r_[self.weights, self.bias]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        for step in range(1, steps + 1):
            w = theta[:-1].astype(np.float32)
            fp, fu = P @ w + theta[-1], U @ w + theta[-1]
            grad = lambda X, d: np.r_[d.astype(np.float32) @ X, d.sum()] / max(1, len(d))
            positive = self.prior * grad(P, -sig(-fp))
            negative = grad(U, sig(fu)) - self.prior * grad(P, sig(fp))
            risk = np.logaddexp(0, fu).mean() - self.prior * np.logaddexp(0, fp).mean()
            g = (positive + negative if risk >= 0 else -negative) + decay * np.r_[theta[:-1], 0]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        self.weights, self.bias = theta[:-1], float(theta[-1])
        return self

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[self.columns(text)].sum() + self.bias, -40, 40))))


def vocabulary(positive: list[str], unlabelled: list[str], most: int = 400, least: int = 3) -> list[str]:
    """Beginnings that positives have more often than unlabelled text, by the likelihood ratio of their document counts."""
    # counted by hash first: only features that may be frequent enough are then held by name
    bins = np.zeros(1 << 22, np.int32)
    place = lambda f: crc32(f.encode()) & (len(bins) - 1)
    for t in positive:
        own = np.fromiter(map(place, document_features(t)), np.int64)
        bins[np.unique(own)] += 1
    in_p: Counter[str] = Counter()
    for t in positive:
        in_p.update(f for f in document_features(t) if bins[place(f)] >= least)
    in_p = Counter({f: n for f, n in in_p.items() if n >= least})
    in_u: Counter[str] = Counter()
    seen: dict[str, tuple[str, ...]] = {}
    for t in unlabelled:
        if len(seen) > 100_000:
            seen.clear()
        own = set()
        for w in set(t.lower().split()):
            if w not in seen:
                seen[w] = tuple(f for f in beginnings(w) if f in in_p)
            own.update(seen[w])
        in_u.update(own)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))

    def gain(f: str) -> float:
        a, b = in_p[f] / n_p, (in_u[f] + 0.5) / (n_u + 1)
        if a <= b:
            return 0.0
        return n_p * (a * np.log(a / b) + (1 - a) * np.log(max(1e-9, 1 - a) / max(1e-9, 1 - b)))

    return sorted(sorted((f for f in in_p if gain(f) > 7), key=lambda f: (-gain(f), f))[:most])


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 12000, parts: int = 3, held: int = 1) -> PositiveUnlabelled:
    """Fit on at most `positives` confirmed toxic and `unlabelled` other-or-toxic documents of the training fold. The
    class prior is the share of toxic labels in that fold. Without positives nothing is scored above the bias."""
    known = training_labels(labels, "toxic", parts, held)
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    P = [t for t, _ in sampled(docs, known.filter("y = 1"), positives)]
    U = [t for t, _ in sampled(docs, known, unlabelled)]
    model = PositiveUnlabelled(vocabulary(P, U), toxic / max(1, n))
    return model.fit(model.matrix(P), model.matrix(U)) if P and model.index else model


def score(docs: DataFrame, model: PositiveUnlabelled, threshold: float = 0.7, parts: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (score >= threshold).

    Null and empty texts have no features and get the bias. Equal texts get equal scores; rows that repeat are scored
    each; a null doc_id is not held out; an empty table gives an empty result. Only id and text are read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = np.array([model.score(t) for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = texts(docs, id_col, text_col).mapInArrow(by_slices(work, rows=256, most_bytes=4 << 20), "doc_id long, score double, predicted int")
    return out.select("doc_id", fold("doc_id", parts, held).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, model: PositiveUnlabelled, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under threshold. Null text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        return batch.filter(pa.array([model.score(t or "") < threshold for t in bodies], pa.bool_()))

    return docs.mapInArrow(by_slices(work, rows=256, most_bytes=4 << 20), docs.schema)
