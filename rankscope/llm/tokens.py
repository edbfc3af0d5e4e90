"""Token ids of logs by a public tokenizer whose tokens never cross white space."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from rankscope.llm import words as W

CACHED = 1_500_000  # words whose ids a worker remembers, about 30 bytes each
JOINED = 1_000      # words encoded in one call


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Where the tokenizer's file lies on this machine; asked for by the task that reads it."""
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Encodes many logs at once; each different word of a block goes through the tokenizer at most once.

    For tokenizers that drop white space and never join across it, like ``word_bpe_49k.json``: the ids of a
    text are then those of its words in turn.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self._forget()

    def _forget(self) -> None:
        self.prints = np.empty(0, np.uint64)  # of known words, sorted
        self.known = np.empty(0, np.int32)    # their places in begins
        self.ids = np.empty(1 << 16, np.uint32)
        self.begins = np.zeros(1 << 16, np.int64)  # of the ids of each known word, one more at the end

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of words, entered behind those of the known ones; the words are joined by blanks and encoded many at a time."""
        sizes = ends - starts
        places = np.concatenate([[0], np.cumsum(sizes + 1)])
        joined = np.full(places[-1], 0x20, np.uint8)
        within = np.arange(places[-1] - len(starts)) - np.repeat(places[:-1] - np.arange(len(starts)), sizes)
        joined[np.repeat(places[:-1], sizes) + within] = data[np.repeat(starts, sizes) + within]
        letters = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])  # characters before each byte
        count = len(self.known)
        self.begins = _room(self.begins, count + len(starts) + 1)
        for at in range(0, len(starts), JOINED):
            n = min(JOINED, len(starts) - at)
            coded = self.tokenizer.encode(joined[places[at]:places[at + n]].tobytes().decode(), add_special_tokens=False)
            firsts = letters[places[at:at + n]] - letters[places[at]]
            word = np.searchsorted(firsts, np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded)), "right") - 1
            used = int(self.begins[count + at])
            self.ids = _room(self.ids, used + len(word))
            self.ids[used:used + len(word)] = coded.ids
            self.begins[count + at:count + at + n + 1] = used + np.searchsorted(word, np.arange(n + 1))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the place where each row begins (one more at the end)."""
        data, offsets = W.texts(column)
        starts, ends, first = W.spans(data, offsets, W.SPACES)
        prints, at, which = np.unique(W.fingerprints(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED:
            self._forget()
        place = np.searchsorted(self.prints, prints)
        met = np.zeros(len(prints), bool)
        if len(self.prints):
            met = self.prints[np.minimum(place, len(self.prints) - 1)] == prints
        new = np.flatnonzero(~met)
        self._learn(data, starts[at[new]], ends[at[new]])
        known = np.empty(len(prints), np.int64)
        known[met] = self.known[place[met]]
        known[new] = len(self.known) + np.arange(len(new))
        self.prints = np.insert(self.prints, place[new], prints[new])
        self.known = np.insert(self.known, place[new], known[new].astype(np.int32))
        begin, lengths = self.begins[known], self.begins[known + 1] - self.begins[known]
        per_word = lengths[which]
        until = np.concatenate([[0], np.cumsum(per_word)])
        ids = self.ids[np.repeat(begin[which] - until[:-1], per_word) + np.arange(until[-1])]
        return ids, until[first]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer copy with room for ``size`` values."""
    if size <= len(array):
        return array
    longer = np.zeros(max(size, 2 * len(array)), array.dtype)
    longer[:len(array)] = array
    return longer


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    """The encoder of this worker process, which later tasks find with its words."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(tokenizer_file(name))
