"""Token ids of whole texts, with a bounded cache of words.

The vocabulary of `word_bpe_49k.json` treats runs between ASCII blanks apart
from each other: its normaliser works by character, and no pre-token holds a
blank. Equal runs therefore have equal ids, and each needs encoding once.
"""

from __future__ import annotations

import os
import string
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dispatchlake.llm.common import keep_only

VOCABULARY = "word_bpe_49k.json"
# cached words and cached letter runs per Python worker; a full cache keeps its older
# half, as frequent words are seen first
CACHE_WORDS = 400_000
CACHE_CORES = 400_000
# characters of the cached words together, and of the longest cached letter run
CACHE_CHARS = 8_000_000
CORE_LENGTH = 64


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Codes(dict):
    """Numbers words in order of first sight and remembers the new ones."""

    def __init__(self):
        self.new = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Encodes texts as the tokenizers library does without special tokens."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache_words = cache_words
        self.cores: dict[str, bytes] = {}
        self.codes = _Codes()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.filled = 0
        self.chars = 0

    def forget(self) -> None:
        """Keep the older half of the words; codes are in order of first sight."""
        kept, chars = _Codes(), 0
        for word, number in islice(self.codes.items(), self.cache_words // 2):
            chars += len(word)
            if chars > CACHE_CHARS // 2:
                break
            kept[word] = number
        self.codes, self.filled = kept, int(self.starts[len(kept)])
        self.chars = sum(map(len, kept))

    def _core(self, core: str) -> bytes:
        """Ids of a run of Latin-1 letters: one pre-token, so the merges alone decide."""
        core = core.lower()
        found = self.cores.get(core)
        if found is None:
            if len(self.cores) >= CACHE_CORES:
                self.cores = dict(islice(self.cores.items(), CACHE_CORES // 2))
            mapped = core if core.isascii() else self.bytes.pre_tokenize_str(core)[0][0]
            found = as_bytes([t.id for t in self.tokenizer.model.tokenize(mapped)])
            if len(core) <= CORE_LENGTH:
                self.cores[core] = found
        return found

    def _learn(self, words: list[str]) -> None:
        ids: list = [None] * len(words)
        slow = []
        for k, word in enumerate(words):
            core = word.rstrip(string.punctuation)
            if core and core.isalpha() and (core.isascii() or max(core) < "Ā"):
                tail = word[len(core) :]
                if not tail:
                    ids[k] = self._core(core)
                    continue
                ends = self.cores.get(tail)
                if ends is None:
                    ends = as_bytes(self.tokenizer.encode(tail, add_special_tokens=False).ids)
                    self.cores[tail] = ends
                ids[k] = self._core(core) + ends
            else:
                slow.append((k, word))
        for at in range(0, len(slow), 1000):
            part = slow[at : at + 1000]
            found = self.tokenizer.encode_batch([w for _, w in part], add_special_tokens=False)
            for (k, _), one in zip(part, found, strict=True):
                ids[k] = as_bytes(one.ids)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = len(self.codes) - len(words)
        total = int(lengths.sum())
        while len(self.ids) < self.filled + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < len(self.codes) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.filled : self.filled + total] = np.frombuffer(b"".join(ids), np.uint32)
        self.starts[first + 1 : len(self.codes) + 1] = self.filled + np.cumsum(lengths)
        self.filled += total

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text; null and empty texts have none."""
        if len(self.codes) > self.cache_words or self.chars > CACHE_CHARS:
            self.forget()
        # Arrow cuts at the six ASCII blanks and numbers the distinct words; an empty
        # word, before or after blanks, has no ids
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()).fill_null(""))
        words = pc.list_flatten(lists).dictionary_encode()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = words.dictionary.to_pylist()
        known = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        codes = known[words.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        if self.codes.new:
            new, self.codes.new = self.codes.new, []
            self.chars += sum(map(len, new))
            self._learn(new)
        begin = self.starts[codes]
        lengths = self.starts[codes + 1] - begin
        ends = np.cumsum(lengths)
        flat = self.ids[np.repeat(begin - (ends - lengths), lengths) + np.arange(lengths.sum())]
        cuts = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(flat, cuts[:-1]) if len(texts) else []


_encoders: dict[str, WordEncoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; its cache outlives a task."""
    if path not in _encoders:
        keep_only("tokens", _encoders.clear)
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
