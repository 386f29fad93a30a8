"""SentencePiece BPE by vectorised merge rounds over flat symbol arrays.

The library takes, again and again, the adjacent pair with the best score (the
leftmost of equals) and merges it. Here all distinct words of a batch lie in one
flat array of symbols. A round finds the least pair rank of every word by a
segmented minimum, merges that pair wherever it stands in the word, from the
left and without overlap, and compacts the array; words without a pair leave.

Merging all places at once is the library's order as long as no merge makes a
pair of the same or a better rank beside it. Where one does, the word keeps the
merges up to there and drops the later ones of the round; they come again.

A text is cut into words before every blank that follows another character: no
piece of the model goes over such a place (checked when the model is read).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import keep_only, small_batches
from dispatchlake.llm.piece_model import NEVER, SPACE, PieceModel

VOCABULARY = "piece_bpe_32k.model"
# ids of words that a Python worker keeps: entries, and the longest word among them
CACHE_WORDS = 300_000
CACHE_LENGTH = 48
# characters whose words merge in the same rounds, and a text's share of a slice
SLICE_CHARS = 1 << 20
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _first_of_runs(chosen: np.ndarray) -> np.ndarray:
    """Keep the first, third, fifth ... of neighbouring true places."""
    places = np.nonzero(chosen)[0]
    if not len(places):
        return places
    new = np.ones(len(places), bool)
    new[1:] = np.diff(places) > 1
    start = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    return places[(np.arange(len(places)) - start) % 2 == 0]


def merge_rounds(
    model: PieceModel, symbols: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words in a row, and how many each word has.

    `symbols` are the words' characters in a row, `counts` how many each has.
    """
    ended_words, ended_sizes, ended_symbols = [], [], []
    word = np.repeat(np.arange(len(counts)), counts)
    symbols = symbols.astype(np.int32)
    rank = np.full(len(symbols), NEVER)  # of the pair that begins at a symbol
    piece = np.zeros(len(symbols), np.int32)
    inner = np.nonzero(word[1:] == word[:-1])[0]
    rank[inner], piece[inner] = model.look_up(symbols[inner], symbols[inner + 1])
    while len(symbols):
        begin = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
        least = np.minimum.reduceat(rank, begin)
        sizes = np.diff(np.append(begin, len(word)))
        ended = least == NEVER
        if ended.any():
            on = np.repeat(~ended, sizes)
            ended_words.append(word[begin[ended]])
            ended_sizes.append(sizes[ended])
            ended_symbols.append(symbols[~on])
            symbols, word, rank, piece = symbols[on], word[on], rank[on], piece[on]
            least, sizes = least[~ended], sizes[~ended]
            if not len(symbols):
                break
        of_word = np.repeat(least, sizes)
        at = _first_of_runs(rank == of_word)
        at = _in_order(model, symbols, word, piece, of_word, at)
        # merge and compact: the right symbol of each merged pair goes
        symbols[at] = piece[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        symbols, word, rank, piece = symbols[stay], word[stay], rank[stay], piece[stay]
        at = place[at]
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        changed[at[at > 0] - 1] = True
        touched = np.nonzero(changed)[0]
        rank[touched] = NEVER
        touched = touched[touched + 1 < len(word)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched], piece[touched] = model.look_up(symbols[touched], symbols[touched + 1])
    final = np.zeros(len(counts), np.int64)
    for words, sizes in zip(ended_words, ended_sizes, strict=True):
        final[words] = sizes
    starts = np.cumsum(final) - final
    out = np.zeros(int(final.sum()), np.int32)
    for words, sizes, own in zip(ended_words, ended_sizes, ended_symbols, strict=True):
        first = np.cumsum(sizes) - sizes
        out[np.repeat(starts[words] - first, sizes) + np.arange(len(own))] = own
    return out, final


def _in_order(model, symbols, word, piece, least, at) -> np.ndarray:
    """The merges at `at` that come before a pair as good or better that one of them makes."""
    made, last = piece[at], len(symbols) - 1
    after = np.minimum(at + 2, last)
    right, _ = model.look_up(made, symbols[after])
    right[(at + 2 > last) | (word[after] != word[at])] = NEVER
    before = np.maximum(at - 1, 0)
    neighbour = symbols[before].copy()
    joined = np.zeros(len(at), bool)  # the left neighbour is itself merged in this round
    joined[1:] = at[1:] - at[:-1] == 2
    neighbour[joined] = made[np.nonzero(joined)[0] - 1]
    left, _ = model.look_up(neighbour, made)
    left[(at == 0) | (word[before] != word[at])] = NEVER
    breaks = np.minimum(left, right) <= least[at]
    if not breaks.any():
        return at
    begin = np.append(True, word[at[1:]] != word[at[:-1]])
    so_far = np.cumsum(breaks) - breaks
    of_word = np.maximum.accumulate(np.where(begin, so_far, 0))
    return at[so_far == of_word]


class RoundsEncoder:
    """Encodes as the library does, without begin and end ids, and decodes with it."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.model = PieceModel.read(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache_words = cache_words
        self.known: dict[str, list[int]] = {}
        # one int object per id, shared by all cached words
        self.numbers = np.array(range(len(self.model.pieces)), dtype=object)
        self.longest_run = self._longest_run()

    def _longest_run(self) -> int:
        """Blanks in the longest piece of blanks, if long runs are that piece again
        and again with a rest; 0 if they are not."""
        runs = [len(p) for p in self.model.pieces if p and not p.strip(SPACE)]
        most = max(runs, default=0)
        if most < 2:
            return 0
        tries = [SPACE * k for k in range(1, 4 * most)]
        ids = dict(zip(map(len, tries), self._merge(tries), strict=True))
        whole = ids[most]
        periodic = all(ids[k] == whole + ids[k - most] for k in range(most + 1, 4 * most))
        return most if periodic and len(whole) == 1 else 0

    def _merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all words in the same rounds."""
        if not words:
            return []
        single = self.model.single
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        chars, back = np.unique(codes, return_inverse=True)
        # a character without a piece is -1 - its code point
        symbols = np.array([single.get(c, -1 - c) for c in chars.tolist()], np.int32)
        ids, sizes = merge_rounds(self.model, symbols[back], counts)
        ends = np.cumsum(sizes)
        unknown = ids < 0
        if unknown.any():
            code = -1 - ids[unknown]
            widths = np.ones(len(ids), np.int64)
            widths[unknown] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            raw = code.astype("<u4").tobytes().decode("utf-32-le").encode()
            as_bytes = np.repeat(unknown, widths)
            ends = np.cumsum(widths)[ends - 1]
            ids = np.repeat(ids, widths)
            ids[as_bytes] = self.model.byte[np.frombuffer(raw, np.uint8)]
        flat, ends = self.numbers[ids].tolist(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _cut(self, text: str) -> list[str]:
        """Words of a text. Blanks before a word that make more than four of the
        longest piece of blanks are cut to a rest, and the pieces come as words."""
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        if not self.model.cuts_at_spaces:
            return [text]
        words = WORDS.findall(text)
        most = self.longest_run
        if most and SPACE * 4 * most in text:
            runs = []
            for word in words:
                blanks = len(word) - len(word.lstrip(SPACE))
                whole = blanks // most - 2
                if whole > 1:
                    runs += [SPACE * most] * whole
                    word = word[whole * most :]
                runs.append(word)
            words = runs
        return words

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [self._cut(t) if t else [] for t in texts]
        if len(self.known) > self.cache_words:
            # frequent words are seen first
            self.known = dict(islice(self.known.items(), self.cache_words // 2))
        known = self.known
        new = list(set(chain.from_iterable(cut)).difference(known))
        found = dict(zip(new, self._merge(new), strict=True)) if new else {}
        known.update((w, ids) for w, ids in found.items() if len(w) <= CACHE_LENGTH)
        long = {w: ids for w, ids in found.items() if len(w) > CACHE_LENGTH}
        if long:
            def of(word: str) -> list[int]:
                return known[word] if word in known else long[word]
        else:
            of = known.__getitem__
        return [list(chain.from_iterable(map(of, words))) for words in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(one) if one else "" for one in ids]


_encoders: dict[str, RoundsEncoder] = {}


def encoder(path: str) -> RoundsEncoder:
    """The worker's encoder; its bounded cache outlives a task."""
    if path not in _encoders:
        keep_only("pieces", _encoders.clear)
        _encoders[path] = RoundsEncoder(path)
    return _encoders[path]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Neighbouring texts of about `SLICE_CHARS` characters, or one longer text."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, ids, decoded.

    `ids` are those of the library's encode, `decoded` its decode of them. Null
    and empty texts have no ids and decode to the empty text. Rows are encoded
    one by one: repeated rows and ids, also null ids, stay. A text of any length
    is encoded whole. An empty table gives no rows; other columns are ignored.
    `path` is a BPE model with byte fallback that leaves texts as they are,
    readable on every executor.
    """
    small_batches(docs)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path)
        for batch in batches:
            begin = 0
            for texts in _slices(batch.column(1).to_pylist()):
                ids = worker.encode(texts)
                own = batch.column(0).slice(begin, len(texts))
                begin += len(texts)
                columns = [own, pa.array(ids, pa.list_(pa.int32())), worker.decode(ids)]
                yield pa.RecordBatch.from_arrays(
                    [*columns[:2], pa.array(columns[2], pa.string())], ["doc_id", "ids", "decoded"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    The digests are taken where the ids are made, so no ids leave the Python
    worker. Odd rows are as in `encode_documents`.
    """
    small_batches(docs)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for texts in _slices(batch.column(1).to_pylist()):
                ids = worker.encode(texts)
                counts += map(len, ids)
                of_ids += [_sha(",".join(map(str, one))) for one in ids]
                of_text += map(_sha, worker.decode(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, out)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
