"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages (lines). Every passage is encoded, a gated
attention learned from the documents' labels weighs the passages, and the
weighted sum is scored. The model is small, trained on the driver from a bounded
sample of labelled documents, and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm import passages
from dispatchlake.llm.common import slices, small_batches
from dispatchlake.llm.training import SAMPLE_DOCS, Adam, held_out, labelled_lines, padded

HIDDEN = 24
GATE = 12
EPOCHS = 12
BATCH = 64
KEEP_SCORE = 0.3
SEED = 7


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """h = tanh(x E + e); a = softmax of w (tanh(h V) * sigmoid(h U)); score = sigmoid(c sum(a h) + b)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = len(mean)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "E": draw(n, HIDDEN),
            "e": np.zeros(HIDDEN, np.float32),
            "V": draw(HIDDEN, GATE),
            "U": draw(HIDDEN, GATE),
            "w": draw(GATE),
            "c": draw(HIDDEN),
            "b": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        score = np.where(mask, (t * g) @ w["w"], -1e9)
        a = np.exp(score - score.max(axis=1, keepdims=True))
        a = np.where(mask, a, 0)
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        z = np.einsum("bk,bkh->bh", a, h)
        return sigmoid(z @ w["c"] + w["b"]), (x, h, t, g, a, z)

    def gradients(self, kept: tuple, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log loss; `error` is score less label, per bag."""
        w, (x, h, t, g, a, z) = self.w, kept
        error = error / len(error)
        dz = error[:, None] * w["c"]
        da = np.einsum("bh,bkh->bk", dz, h)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        dt, dg = ds[..., None] * g * w["w"], ds[..., None] * t * w["w"]
        dt, dg = dt * (1 - t * t), dg * g * (1 - g)
        dh = a[..., None] * dz[:, None] + dt @ w["V"].T + dg @ w["U"].T
        dh = dh * (1 - h * h)
        flat = lambda v: v.reshape(-1, v.shape[-1])
        return {
            "E": flat(x).T @ flat(dh),
            "e": flat(dh).sum(axis=0),
            "V": flat(h).T @ flat(dt),
            "U": flat(h).T @ flat(dg),
            "w": np.einsum("bk,bkg->g", ds, t * g),
            "c": z.T @ error,
            "b": error.sum(keepdims=True),
        }

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """One score per text; a text without passages is one passage of zeros."""
        x, counts, _ = passages.encode(texts)
        out = np.empty(len(texts))
        rows = np.split(x, np.cumsum(counts)[:-1])
        empty = np.zeros((1, passages.N_FEATURES), np.float32)
        order = np.argsort(counts, kind="stable")
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            bags, mask = padded([rows[k] if len(rows[k]) else empty for k in part])
            out[part] = self.forward(bags, mask)[0]
        return out


def fit(sample: list[tuple[np.ndarray, int]], seed: int = SEED) -> AttentionModel:
    """Train on bags of passages with labels; either label weighs the same in sum."""
    if not sample:
        return AttentionModel(np.zeros(passages.N_FEATURES), np.ones(passages.N_FEATURES), seed)
    every = np.concatenate([x for x, _ in sample])
    model = AttentionModel(every.mean(axis=0), every.std(axis=0) + 1e-3, seed)
    labels = np.array([q for _, q in sample], np.float32)
    share = np.clip(labels.mean(), 0.02, 0.98)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    rng = np.random.default_rng(seed)
    lengths = np.array([len(x) for x, _ in sample])
    adam = Adam(model.w, 3e-3)
    for _ in range(EPOCHS):
        # bags of like length together, to pad little
        order = np.lexsort((rng.random(len(sample)), lengths // 4))
        batches = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            part = batches[k]
            x, mask = padded([sample[j][0] for j in part])
            score, kept = model.forward(x, mask)
            adam.update(model.gradients(kept, (score - labels[part]) * weight[part]))
    return model


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> AttentionModel:
    return fit(labelled_lines(docs, labels, sample_docs))


def score_documents(docs: DataFrame, model: AttentionModel, keep_score: float = KEEP_SCORE) -> DataFrame:
    """All rows and columns of `docs` with score (0 to 1) and predicted (0 or 1).

    Null and empty texts get the score of an empty passage; repeated rows the same
    score; an empty table stays empty. Columns score and predicted are replaced.
    Scores use the text alone. With no labelled document the model is untrained.
    """
    small_batches(docs)
    bound = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"text": texts.to_numpy()})
        parts = [bound.value.scores(p["text"].tolist()) for p in slices(frame, "text")]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    scored = docs.withColumn("score", score("text"))
    return scored.withColumn("predicted", (F.col("score") >= keep_score).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per document: doc_id, held_out (never learned from), score, predicted."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels, sample_docs))
    key = F.col("doc_id").cast("long")
    return scored.select(
        key.alias("doc_id"),
        F.coalesce(held_out(key), F.lit(False)).alias("held_out"),
        "score",
        "predicted",
    )
