"""Line sequence labelling: a linear-chain CRF marks content and boilerplate.

Each line with a word is one position; its features are those of its surface and
of its neighbours'. Viterbi decoding labels the lines together, and a document is
kept when the lines marked as content hold enough of its characters.

There are no line labels, so they are derived from documents': lines of
low-quality documents that a line classifier tells from lines of good documents
are boilerplate, all others content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm import passages
from dispatchlake.llm.common import byte_words, slices, small_batches
from dispatchlake.llm.training import SAMPLE_DOCS, Adam, labelled_lines, padded

CONTENT_SHARE = 0.5
EPOCHS = 4
BATCH = 64
SEED = 7
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
CONTENT, BOILERPLATE = 0, 1


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Features of each line beside those of the line before and after, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        ends = np.cumsum(counts[counts > 0])
        before[ends - counts[counts > 0]] = 0
        after[ends - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1), np.float32)], axis=1)


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> list[int]:
    """Best labels of one sequence with two labels."""
    back, (a, b) = [], emissions[0].tolist()
    (aa, ab), (ba, bb) = transitions.tolist()
    for ea, eb in emissions[1:].tolist():
        from_a, from_b = (a + aa, b + ba), (a + ab, b + bb)
        back.append((from_a[1] > from_a[0], from_b[1] > from_b[0]))
        a, b = max(from_a) + ea, max(from_b) + eb
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class LineModel:
    """Weights of the CRF: two per feature, and label transitions."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        n = 3 * len(mean) + 1
        self.w = {"W": np.zeros((n, 2)), "T": np.zeros((2, 2))}

    def inputs(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return with_neighbours(((x - self.mean) / self.scale).astype(np.float32), counts)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood, by the forward-backward recursions."""
        e, t = x @ self.w["W"], self.w["T"]
        n, most = mask.shape
        lengths = mask.sum(axis=1)
        forward = np.zeros((n, most, 2))
        backward = np.zeros((n, most, 2))
        forward[:, 0] = e[:, 0]
        for k in range(1, most):
            step = log_sum(forward[:, k - 1, :, None] + t, 1) + e[:, k]
            forward[:, k] = np.where(mask[:, k, None], step, forward[:, k - 1])
        for k in range(most - 2, -1, -1):
            step = log_sum(t + (e[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
            backward[:, k] = np.where(mask[:, k + 1, None], step, 0)
        total = log_sum(forward[np.arange(n), lengths - 1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        truth = np.eye(2)[y] * mask[..., None]
        pairs = np.exp(
            forward[:, :-1, :, None]
            + t
            + (e[:, 1:] + backward[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        ) * mask[:, 1:, None, None]
        seen = np.einsum("nka,nkb->ab", truth[:, :-1], truth[:, 1:])
        return {
            "W": np.einsum("nkf,nka->fa", x, single - truth) / n + 1e-3 * self.w["W"],
            "T": (pairs.sum(axis=(0, 1)) - seen) / n + 1e-3 * self.w["T"],
        }

    def label(self, texts: list[str | None]) -> list[tuple[list[int], np.ndarray]]:
        """Labels and characters of the lines of each text."""
        x, counts, chars = passages.encode(texts)
        e = self.inputs(x, counts) @ self.w["W"]
        ends = np.cumsum(counts)
        out = []
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            own = slice(end - n, end)
            out.append((viterbi(e[own], self.w["T"]) if n else [], chars[own]))
        return out


def line_targets(x: np.ndarray, quality: np.ndarray, steps: int = 300) -> np.ndarray:
    """Boilerplate (1) for lines of low-quality documents that look it.

    A logistic classifier learns which lines come from low-quality documents;
    lines of good documents stay content whatever it says.
    """
    y = (quality == 0).astype(np.float64)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    w = {"w": np.zeros(x.shape[1])}
    adam = Adam(w, 0.05)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w["w"], -40, 40)))
        adam.update({"w": x.T @ ((p - y) * weight) / len(y) + 1e-4 * w["w"]})
    p = 1 / (1 + np.exp(-np.clip(x @ w["w"], -40, 40)))
    return ((p >= 0.5) & (y > 0)).astype(int)


def fit(sample: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> LineModel:
    """Train the CRF; with no labelled document, every line is content."""
    if not sample:
        model = LineModel(np.zeros(passages.N_FEATURES), np.ones(passages.N_FEATURES))
        model.w["W"][-1, CONTENT] = 1.0
        return model
    every = np.concatenate([x for x, _ in sample])
    counts = np.array([len(x) for x, _ in sample])
    model = LineModel(every.mean(axis=0), every.std(axis=0) + 1e-3)
    inputs = model.inputs(every, counts)
    n = passages.N_FEATURES
    own = np.concatenate([inputs[:, :n], inputs[:, -1:]], axis=1)
    targets = line_targets(own, np.repeat([q for _, q in sample], counts))
    rows, truth = np.split(inputs, np.cumsum(counts)[:-1]), np.split(targets, np.cumsum(counts)[:-1])
    rng = np.random.default_rng(SEED)
    adam = Adam(model.w, 0.03)
    for _ in range(epochs):
        # documents of like length together, to pad little
        order = np.lexsort((rng.random(len(rows)), counts))
        for at in rng.permutation(range(0, len(order), BATCH)):
            part = order[at : at + BATCH]
            x, mask = padded([rows[k] for k in part])
            y = np.zeros(mask.shape, int)
            y[mask] = np.concatenate([truth[k] for k in part])
            adam.update(model.gradients(x, mask, y))
    return model


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not isinstance(text, str) or not text:
        return 0, 0, 0, 0, 0
    words = byte_words(text)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeats = 0
    if len(words) >= 4:
        codes: dict[bytes, int] = {}
        ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
        n = np.int64(len(codes))
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        _, inverse, times = np.unique(
            pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True
        )
        often = times[inverse] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : len(words) - 2 + k] |= often
        repeats = int(covered.sum())
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeats


def judge(
    docs: DataFrame,
    model: LineModel,
    content_share: float = CONTENT_SHARE,
    min_words: int = MIN_WORDS,
    repeat_percent: int = REPEAT_PERCENT,
) -> DataFrame:
    """Counts and verdict per row of `docs` (doc_id, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, content_share (of the characters of lines with a word; 0 without
    any), n_boilerplate_lines, kept. Null and empty texts have no words and fail;
    repeated rows are judged alike; an empty table gives no rows; other columns
    are ignored.
    """
    small_batches(docs)
    bound = docs.sparkSession.sparkContext.broadcast(model)  # some hundred numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in slices(frame, "text"):
                texts, out = part["text"].tolist(), []
                labelled = bound.value.label(texts)
                for doc_id, text, (labels, chars) in zip(
                    part["doc_id"], texts, labelled, strict=True
                ):
                    counts = counts_of(text)
                    failed = (
                        counts[0] < min_words or 100 * counts[4] > repeat_percent * counts[0]
                    )
                    content = np.array(labels) == CONTENT
                    share = float(chars[content].sum() / chars.sum()) if len(labels) else 0.0
                    known = None if pd.isna(doc_id) else int(doc_id)
                    kept = not failed and share >= content_share
                    lines = len(labels) - int(content.sum())
                    out.append((known, *counts, failed, share, lines, kept))
                names = [c.split(" ")[0] for c in VERDICT.split(", ")]
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return picked.mapInPandas(run, VERDICT)


VERDICT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, content_share double,"
    " n_boilerplate_lines long, kept boolean"
)


def label_lines(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Train on a bounded sample of `labels` (doc_id, quality) and judge all of `docs`."""
    return judge(docs, fit(labelled_lines(docs, labels, sample_docs)))
