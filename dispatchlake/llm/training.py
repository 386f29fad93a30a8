"""Bounded samples of labelled documents for the models trained here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm import passages
from dispatchlake.llm.common import small_batches

SAMPLE_DOCS = 4_000
SAMPLE_LINES = 128


def held_out(doc_id) -> F.Column:
    """Documents that no model learns from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_lines(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS
) -> list[tuple[np.ndarray, int]]:
    """Line features and quality label of at most `sample_docs` labelled documents.

    Half of the sample for either label, those with the smallest hash of their
    doc_id; never held-out ones. At most SAMPLE_LINES lines of each, spread
    evenly. Repeated labels of a document count once, as the larger, and so do rows
    that repeat a doc_id, as the text of the smallest hash. The ids are
    few enough to broadcast; features, not texts, come to the driver.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where("doc_id is not null and quality is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    small_batches(docs)
    half = sample_docs // 2
    picked = [
        known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
        for q in (0, 1)
    ]
    chosen = picked[0].unionByName(picked[1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, quality, spread in frame.itertuples(index=False):
                x, _, _ = passages.encode([text])
                if len(x) > SAMPLE_LINES:
                    x = x[np.linspace(0, len(x) - 1, SAMPLE_LINES).astype(int)]
                out.append((int(doc_id), int(quality), int(spread), x.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "quality", "spread", "lines"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = (
        own.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text", "quality", F.xxhash64("text").alias("spread"))
        .mapInPandas(run, "doc_id long, quality int, spread long, lines binary")
        .groupBy("doc_id", "quality")
        .agg(F.min_by("lines", F.struct("spread", "lines")).alias("lines"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["lines"])))
    shaped = [
        (np.frombuffer(r["lines"], "<f4").reshape(-1, passages.N_FEATURES), r["quality"])
        for r in rows
    ]
    return [(x, q) for x, q in shaped if len(x)]


def padded(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bags of rows as one array with a mask of real rows."""
    most = max(map(len, bags))
    out = np.zeros((len(bags), most, bags[0].shape[1]), np.float32)
    mask = np.zeros((len(bags), most), bool)
    for k, x in enumerate(bags):
        out[k, : len(x)], mask[k, : len(x)] = x, True
    return out, mask


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            m = self.first[k] / (1 - 0.9**self.step)
            v = self.second[k] / (1 - 0.999**self.step)
            self.weights[k] -= self.rate * m / (np.sqrt(v) + 1e-8)
