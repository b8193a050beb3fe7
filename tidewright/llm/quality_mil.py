"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, consecutive blocks of words; only the bag has a label. Each passage is described by
rates of its characters and words and encoded by a tanh layer; gated attention gives it a weight within its document;
the weighted sum of the encoded passages is scored. All layers are learned together from document labels, in numpy, on a
bounded sample; scoring streams whole documents.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, texts
from .labelled import fold, sampled, training_labels

PASSAGE = 64
#: Character classes whose share of a passage is a feature.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?", b"!", b"|/\\_~^<>=+", b"*$%&#@", b"\"'()[]{}-", bytes(range(128, 256))]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _k
N_FEATURES = len(CLASSES) + 6


def passages(bodies: list[bytes], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each document). A document without words is one passage of zeros."""
    words = [b.split() for b in bodies]
    n = np.array([len(w) for w in words])
    bags = np.maximum(1, -(-n // size))
    flat = [w for ws in words for w in ws]
    first = np.r_[0, np.cumsum(bags)[:-1]]
    X = np.zeros((int(bags.sum()), N_FEATURES), np.float32)
    if not flat:
        return X, bags
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    hashes = np.fromiter(map(crc32, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    passage = first[doc] + within // size
    starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    rows = passage[starts]
    count = np.diff(np.r_[starts, len(flat)])
    classes = _CLASS[np.frombuffer(b"".join(flat), np.uint8)]
    ends = np.cumsum(lengths)
    lo, hi = (ends - lengths)[starts], ends[np.r_[starts[1:], len(flat)] - 1]
    chars = np.maximum(1, hi - lo)
    for k in range(len(CLASSES)):
        c = np.r_[0, np.cumsum(classes == k, dtype=np.int64)]
        X[rows, k] = (c[hi] - c[lo]) / chars
    repeat = np.r_[False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])]
    pairs = np.unique(passage << 32 | hashes)
    distinct = np.bincount(pairs >> 32, minlength=len(X))[rows]
    X[rows, -6] = np.add.reduceat(repeat, starts, dtype=np.int64) / count
    X[rows, -5] = distinct / count
    X[rows, -4] = np.log1p(chars / count)
    X[rows, -3] = np.add.reduceat(lengths**2, starts) / chars / 16
    X[rows, -2] = np.add.reduceat((lengths == 1).astype(np.int64), starts) / count
    X[rows, -1] = np.log1p(count) / 4
    return X, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class GatedAttention:
    """z = sum a_k h_k with h = tanh(x E), a = softmax(w . (tanh(h V) * sigmoid(h U))), p = sigmoid(z c + d)."""

    def __init__(self, n_in: int, hidden: int = 16, gate: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n_in), np.ones(n_in)
        self.p = {"E": r.normal(0, n_in**-0.5, (n_in, hidden)), "e": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, gate**-0.5, gate), "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}

    def forward(self, X: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(bags) - bags
        x = (X - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), bags))
        a = s / np.repeat(np.add.reduceat(s, starts), bags)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def gradients(self, f: dict[str, np.ndarray], bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(bags) - bags
        err = (f["y"] - y) * weight
        dz = np.repeat(err[:, None] * p["c"], bags, axis=0)
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), bags))
        dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ err, "d": err.sum(keepdims=True)}

    def fit(self, X: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> GatedAttention:
        self.mean, self.scale = X.mean(0), X.std(0) + 1e-3
        share = np.clip(y.mean(), 0.05, 0.95)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            grads = self.gradients(self.forward(X, bags), bags, y, weight)
            for k, g in grads.items():
                g = g + decay * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, parts: int = 5, held: int = 0) -> GatedAttention:
    """Fit on at most `most` labelled documents of the training fold, half of each label as far as they reach. Without
    labels the untrained model is returned, whose scores mean nothing."""
    known = training_labels(labels, "quality", parts, held)
    rows = [r for y in (0, 1) for r in sampled(docs, known.filter(F.col("y") == y), most // 2)]
    model = GatedAttention(N_FEATURES)
    if not rows:
        return model
    # in slices, as the words of all documents at once are far larger than their features
    parts = [passages([t.encode() for t, _ in rows[at : at + 64]]) for at in range(0, len(rows), 64)]
    X, bags = (np.concatenate(x) for x in zip(*parts, strict=True))
    return model.fit(X.astype(float), bags, np.array([y for _, y in rows], float))


def score(docs: DataFrame, model: GatedAttention, threshold: float = 0.3, parts: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold), n_passages, attention (the
    largest weight of a passage).

    Null and empty texts are one passage without words and get its score. Equal texts get equal scores; rows that repeat
    are scored each; a null doc_id is not held out; an empty table gives an empty result. Only id and text are read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        X, bags = passages(batch.column(1).cast(pa.binary()).to_pylist())
        f = model.forward(X.astype(float), bags)
        top = np.maximum.reduceat(f["a"], np.cumsum(bags) - bags)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(f["y"]), pa.array((f["y"] >= threshold).astype(np.int32)), pa.array(bags.astype(np.int32)), pa.array(top)], names=["doc_id", "score", "predicted", "n_passages", "attention"])

    out = texts(docs, id_col, text_col).mapInArrow(by_slices(work, rows=256, most_bytes=4 << 20), "doc_id long, score double, predicted int, n_passages int, attention double")
    return out.select("doc_id", fold("doc_id", parts, held).alias("held_out"), "score", "predicted", "n_passages", "attention")
