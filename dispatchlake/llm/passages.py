"""Surface features of lines, shared by the two quality operators."""

from __future__ import annotations

import numpy as np

LONGEST = 600  # characters; longer lines are several passages


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte."""
    groups = [
        b"abcdefghijklmnopqrstuvwxyz",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b" \t",
        b"#*$%&",
        b"|<>",
        b"!?",
        b".,",
        b":;-_'\"()[]{}/\\@=+~^`",
        bytes(range(0xC2, 0xC4)),
        bytes(range(0x80, 0xA0)),
        bytes(range(0xA0, 0xC0)),
    ]
    table = np.full(256, len(groups), np.uint8)
    for k, group in enumerate(groups):
        table[list(group)] = k
    return table


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES + 5


def lines_of(text: str | None, longest: int = LONGEST) -> list[str]:
    """Lines with a word, in order; long ones in pieces of `longest` characters."""
    if not isinstance(text, str):
        return []
    out = []
    for line in text.split("\n"):
        if len(line) <= longest:
            if line.strip(" \t\r\x0b\x0c"):
                out.append(line)
        else:
            cut = (line[k : k + longest] for k in range(0, len(line), longest))
            out.extend(c for c in cut if c.strip(" \t\r\x0b\x0c"))
    return out


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, lines per text, and characters per line."""
    per_text = [lines_of(t) for t in texts]
    counts = np.array([len(x) for x in per_text], np.int64)
    lines, repeated, words = [], [], []
    for own in per_text:
        seen: set[str] = set()
        for line in own:
            split = line.split()
            words.append((len(split), len(set(split)), max(map(len, split), default=0)))
            repeated.append(line in seen)
            seen.add(line)
        lines += own
    if not lines:
        return np.zeros((0, N_FEATURES), np.float32), counts, np.zeros(0, np.int64)
    raw = [x.encode() for x in lines]
    sizes = np.array([len(x) for x in raw], np.int64)
    kinds = CLASSES[np.frombuffer(b"".join(raw), np.uint8)]
    cell = np.repeat(np.arange(len(raw), dtype=np.int64) * N_CLASSES, sizes) + kinds
    shares = np.bincount(cell, minlength=len(raw) * N_CLASSES).reshape(len(raw), N_CLASSES)
    n, distinct, longest = np.array(words, np.float64).T
    columns = [
        np.sqrt(shares / sizes[:, None]),
        np.log1p(sizes)[:, None],
        (n / sizes)[:, None],
        (distinct / np.maximum(n, 1))[:, None],
        np.log1p(longest)[:, None],
        np.array(repeated, np.float64)[:, None],
    ]
    chars = np.array([len(x) for x in lines], np.int64)
    return np.concatenate(columns, axis=1).astype(np.float32), counts, chars
