"""What merging needs of a SentencePiece BPE model file: pieces, ranks, splits.

The file is a protocol buffer; four of its fields are read here, so that no
protobuf package is needed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

NORMAL, UNKNOWN, BYTE = 1, 2, 6
SPACE = "▁"
NEVER = np.int64(1) << 40


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class PieceModel:
    """Pieces of a BPE model, and all pairs of pieces that make another one."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    dummy_prefix: bool

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as file:
            raw = file.read()
        pieces, kinds, scores, settings = [], [], [], {}
        for number, value in _fields(raw):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
                kinds.append(one.get(3, NORMAL))
            elif number == 3:
                settings = dict(_fields(value))
            elif number == 2:
                trained = dict(_fields(value))
                if trained.get(3, 1) != 2 or not trained.get(35, 0) or trained.get(24, 0):
                    raise ValueError("not a BPE model with byte fallback and leading spaces")
        if settings.get(2) or settings.get(4, 1) or not settings.get(5, 1):
            raise ValueError("the model rewrites texts before it splits them")
        if set(kinds) - {NORMAL, UNKNOWN, BYTE, 3}:
            raise ValueError("the model has user-defined or unused pieces")
        return cls(pieces, kinds, scores, bool(settings.get(3, 1)))

    def __post_init__(self):
        ids = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] == NORMAL}
        self.single = {ord(p): k for p, k in ids.items() if len(p) == 1}
        self.byte = np.zeros(256, np.int32)
        for k, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte[int(self.pieces[k][3:5], 16)] = k
        # rank 0 is the highest score; equal scores have equal ranks
        order = {s: r for r, s in enumerate(sorted(set(self.scores), reverse=True))}
        found = {}
        for piece, k in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * len(self.pieces) + right] = (order[self.scores[k]], k)
        self.pairs = np.array(sorted(found), np.int64)
        both = np.array([found[p] for p in self.pairs.tolist()], np.int64).reshape(-1, 2)
        # a sentinel at the end, so that a search for a larger pair stays inside
        self.pairs = np.append(self.pairs, np.iinfo(np.int64).max)
        self.ranks = np.append(both[:, 0], NEVER)
        self.merged = np.append(both[:, 1], 0).astype(np.int32)
        # a blank after another character is where a text may be cut into words
        self.cuts_at_spaces = not any(
            b == SPACE != a for p in ids for a, b in zip(p, p[1:], strict=False)
        )

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; `NEVER` if they make no piece.

        Negative symbols are characters without a piece.
        """
        key = left.astype(np.int64) * len(self.pieces) + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER), self.merged[at]
