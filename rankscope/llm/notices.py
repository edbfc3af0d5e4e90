"""Licence notices in logs, found through their rarest words and checked phrase by phrase."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankscope.llm import words as W
from rankscope.llm.stage import carried

# Phrases and labels that the result must name.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices as their authors word them, in lower case words, and the phrase without which a notice does not count.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "redistribution and use in source and binary forms"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software",
            "permission is hereby granted free of charge"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    "lgpl": ("gnu lesser general public license", "lesser general public license"),
    "agpl": ("gnu affero general public license", "affero general public license"),
    "cc-by-sa": ("licensed under cc by sa", "cc by sa"),
    "cc-by-nc": ("licensed under cc by nc", "cc by nc"),
    "cc-by-nd": ("licensed under cc by nd", "cc by nd"),
    "cc0": ("licensed under cc0 1 0 universal", "cc0 1 0"),
    "public-domain": ("released into the public domain", "public domain"),
}
LOOKED_UP = 2  # words of a notice's mandatory phrase whose places are intersected

RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _print(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(W.fingerprints(data, np.array([0]), np.array([len(data)]))[0])


class Notices:
    """Postings of the words of every notice's mandatory phrase, and the weight of each word, by the logs it stands in.

    A notice is a label, its words, and where its mandatory phrase begins and ends among them.
    """

    def __init__(self, n_logs: int, logs_with: dict[int, int]):
        notices = [(label, phrase, phrase) for phrase, label in BASE.items()]
        notices += [(label, text, phrase) for label, (text, phrase) in TEMPLATES.items()]
        self.idf = {w: float(np.log((1 + n_logs) / (1 + n))) + 1e-6 for w, n in logs_with.items()}
        self.labels, self.words, self.must, self.weights = [], [], [], []
        self.places_of: list[dict[int, int]] = []  # of each notice: word of the mandatory phrase, its place among the notice's words
        for label, text, phrase in notices:
            words, inner = [_print(w) for w in text.split()], [_print(w) for w in phrase.split()]
            begin = next(i for i in range(len(words)) if words[i:i + len(inner)] == inner)
            self.labels.append(label)
            self.words.append(words)
            self.must.append((begin, begin + len(inner)))
            self.weights.append([self.idf[w] for w in words])
            self.places_of.append({w: begin + i for i, w in reversed(list(enumerate(inner)))})
        self.vocabulary = np.array(sorted({w for places in self.places_of for w in places}), np.uint64)

    def starts(self, at: np.ndarray, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each notice, where it may begin in a log that has the vocabulary's ``words`` at the places ``at``.

        The log's own rarest words go first: from the highest weight on, a word is looked up while a notice whose whole mandatory phrase
        is among the log's words still lacks words. A notice's lists of places, each shifted by its word's place in the notice, are intersected.
        """
        kinds, first = np.unique(words, return_inverse=True)
        own = {int(w): at[first == i] for i, w in enumerate(kinds)}
        lacking = {n: min(LOOKED_UP, len(places)) for n, places in enumerate(self.places_of) if places.keys() <= own.keys()}
        found: dict[int, np.ndarray] = {}
        for word in sorted(own, key=lambda w: (-self.idf[w], w)):
            for n in [n for n, left in lacking.items() if left and word in self.places_of[n]]:
                begins = own[word] - self.places_of[n][word]
                found[n] = begins if n not in found else np.intersect1d(found[n], begins)
                lacking[n] -= 1
            if not any(lacking.values()):
                break
        return found

    def places(self, prints: list[int], at: np.ndarray, words: np.ndarray) -> dict[int, dict[int, float]]:
        """For each notice, the starts of its mandatory phrase in the log and the share of the notice found there, by weight."""
        found: dict[int, dict[int, float]] = defaultdict(dict)
        for number, starts in self.starts(at, words).items():
            low, high = self.must[number]
            words_of, weights = self.words[number], self.weights[number]
            for start in starts.tolist():
                if start + low < 0 or prints[start + low:start + high] != words_of[low:high]:
                    continue
                met = sum(weights[i] for i in range(len(words_of)) if 0 <= start + i < len(prints) and prints[start + i] == words_of[i])
                found[number][start + low] = met / sum(weights)
        return found


def _logs_with(logs: DataFrame) -> tuple[int, dict[int, int]]:
    """The number of logs, and for every word of a notice the number of logs with it."""
    own = np.array(sorted({_print(w) for text, _ in TEMPLATES.values() for w in text.split()} | {_print(w) for p in BASE for w in p.split()}), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own) + 1, np.int64)
        for batch in W.blocks(batches, "log"):
            prints, first = _words(batch)
            at = np.flatnonzero(np.isin(prints, own))
            rows = np.searchsorted(first, at, "right") - 1
            pairs = np.unique(rows * len(own) + np.searchsorted(own, prints[at]))
            total[:-1] += np.bincount(pairs % len(own), minlength=len(own))
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    counts = {i: n for i, n in logs.select("log").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()}
    return counts.get(len(own), 0), {int(w): counts.get(i, 0) for i, w in enumerate(own)}


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.texts(batch.column("log"))
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.PUNCTUATION)
    return W.fingerprints(data, starts, ends), first


def scan_notices(logs: DataFrame) -> DataFrame:
    """Find licence notices that programs print into their logs.

    ``logs`` has ``log`` string. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case; null is empty. One pass counts the logs that each word
    of the notices stands in. Of each log its own rarest notice words are looked up, as many as the notices need that it can hold; their places, shifted by the
    words' places in a notice, are intersected, and at each common start the mandatory phrase must stand word for word.

    Returns the columns of ``logs`` with ``n_words``; ``n_base`` (places of ``BASE`` phrases), ``first_word`` and ``last_word`` (smallest and largest start of one, null without),
    ``base_labels`` and ``labels`` (with those of ``TEMPLATES``; distinct, sorted, joined by commas), and ``score`` (largest share of a notice found, by
    weight of its words; 0 without). Every row is judged on its own. No rows give no rows. Columns named like a result are replaced.
    """
    kept = carried(logs, RESULTS)
    index = Notices(*_logs_with(logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.blocks(batches, "log"):
            prints, first = _words(batch)
            at = np.flatnonzero(np.isin(prints, index.vocabulary))
            bounds = np.searchsorted(at, first)
            out: dict[str, list] = {c: [] for c in RESULTS}
            for i in range(batch.num_rows):
                a, z = first[i], first[i + 1]
                own = at[bounds[i]:bounds[i + 1]]
                found = index.places(prints[a:z].tolist(), own - a, prints[own]) if len(own) else {}
                base = sorted(start for number in found if number < len(BASE) for start in found[number])
                for column, value in zip(out.values(), (
                        int(z - a), len(base), base[0] if base else None, base[-1] if base else None,
                        ",".join(sorted({index.labels[n] for n in found if n < len(BASE)})), ",".join(sorted({index.labels[n] for n in found})),
                        max((share for places in found.values() for share in places.values()), default=0.0))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], [*kept, *RESULTS])

    schema = T.StructType([*[logs.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in RESULTS[:4]],
                           *[T.StructField(c, T.StringType()) for c in RESULTS[4:6]], T.StructField("score", T.DoubleType())])
    return logs.select(*dict.fromkeys([*kept, "log"])).mapInArrow(run, schema)
