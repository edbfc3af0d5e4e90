"""Phrases of call logs whose words come together more often than apart, counted by prefix-free parsing.

A run's logs are parsed into overlapping chunks that begin and end where the text itself says so: at pairs of words with a certain
fingerprint. Equal stretches give equal chunks wherever they stand, so the dictionary of distinct chunks with their numbers of
occurrences holds a repeated stretch once. N-grams are counted inside distinct chunks, weighted by the chunk's number. Two chunks
share the words of the trigger between them; an n-gram that begins there counts for the later chunk only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankscope.llm import words as W
from rankscope.llm.stage import written

TRIGGER = 16           # one place in so many ends a chunk
FARTHEST = 256         # words after which a chunk ends without a trigger, so that no text makes a chunk without bound
FILTER_BITS = 1 << 27  # of the table of frequent phrases that tasks hold: 16 MB whatever the input
PHRASES = 50_000       # that a task makes strings of at once
PIECE = 1 << 16        # bits of that table that one row carries

# Characters that end a piece of text, and blanks between its words; A-Z are lower-cased.
ENDS = [*b".,;:!?", *range(0x0A, 0x0E)]
BREAK, BLANK = 0x0A, 0x20
_FOLDED = W.LOWER.copy()
_FOLDED[ENDS] = BREAK
_FOLDED[0x09] = BLANK
_GAPS = np.zeros(256, bool)
_GAPS[[BREAK, BLANK]] = True
_BLANKS = np.zeros(256, bool)
_BLANKS[BLANK] = True


def _joined(data: np.ndarray, offsets: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as tokens with one blank behind each: words, one break between pieces, ``overlap`` breaks at the end of a row.

    Returns the bytes, first byte and end of every token, and the number of the first token of every row (one more at the end).
    """
    data = _FOLDED[data]
    starts, ends, first = W.spans(data, offsets, _GAPS)
    n = len(starts)
    breaks = np.concatenate([[0], np.cumsum(data == BREAK)])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    led = np.zeros(n, np.int64)  # breaks before each word
    if n:
        led[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) & (row[1:] == row[:-1])
    counts = led + 1
    place = np.cumsum(counts) - 1 + overlap * row  # of each word among all tokens
    total = int(counts.sum()) + overlap * (len(offsets) - 1)
    lengths = np.ones(total, np.int64)
    lengths[place] = ends - starts
    until = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(until[-1], BLANK, np.uint8)
    token_starts, token_ends = until[:-1], until[1:] - 1
    is_break = np.ones(total, bool)
    is_break[place] = False
    out[token_starts[is_break]] = BREAK
    sizes = ends - starts
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(token_starts[place], sizes) + within] = data[np.repeat(starts, sizes) + within]
    per_row = np.concatenate([[0], np.cumsum(np.bincount(row, weights=counts, minlength=len(offsets) - 1).astype(np.int64) + overlap)])
    return out, token_starts, token_ends, per_row


def _chunk_bounds(prints: np.ndarray, per_row: np.ndarray, overlap: int, trigger: int, farthest: int) -> tuple[np.ndarray, np.ndarray]:
    """First token of every chunk, and the token where the next chunk of the row begins; a row without words has none."""
    grams = W.grams(prints, overlap)
    cut = np.zeros(len(prints) + 1, bool)
    cut[:len(grams)] = grams % np.uint64(trigger) == 0
    for k in range(overlap):  # not among the breaks that end a row
        cut[per_row[1:] - 1 - k] = False
    begins, ends = per_row[:-1], per_row[1:] - overlap
    begins, ends = begins[begins < ends], ends[begins < ends]
    cut[begins] = True
    cut[ends] = True  # no chunk begins here; it closes the row's last one
    places = np.flatnonzero(cut)
    wide = np.diff(places) > farthest
    if wide.any():
        more = [np.arange(places[i] + farthest, places[i + 1], farthest) for i in np.flatnonzero(wide)]
        cut[np.concatenate(more)] = True
        places = np.flatnonzero(cut)
    closing = np.zeros(len(prints) + 1, bool)
    closing[ends] = True
    opens = ~closing[places]
    return places[opens], places[np.flatnonzero(opens) + 1]


def parse_chunks(logs: DataFrame, longest: int = 3, unknown: str = "und", trigger: int = TRIGGER, farthest: int = FARTHEST) -> DataFrame:
    """The dictionary of the parse: ``(run_id, chunk, times)``, distinct chunks of each run with their numbers of occurrences.

    A chunk's words are joined by one blank, a line break stands between pieces. The last ``longest - 1`` tokens belong to the next chunk.
    """
    overlap = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.blocks(batches, "log", W.BLOCK // 4):
            data, offsets = W.texts(batch.column("log"))
            out, starts, ends, per_row = _joined(data, offsets, overlap)
            first, following = _chunk_bounds(W.fingerprints(out, starts, ends), per_row, overlap, trigger, farthest)
            text = out.tobytes()
            chunks = [text[a:b].decode() for a, b in zip(starts[first].tolist(), ends[following + overlap - 1].tolist())]
            row = np.searchsorted(per_row, first, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("run_id").take(pa.array(row)), pa.array(chunks, pa.string())], ["run_id", "chunk"])

    named = logs.select(F.coalesce(F.col("run_id").cast("string"), F.lit(unknown)).alias("run_id"), "log")
    return named.mapInArrow(run, "run_id string, chunk string").groupBy("run_id", "chunk").agg(F.count(F.lit(1)).alias("times"))


def _owned(column: pa.Array, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of chunks: bytes, first byte, end, row, which are words, and which begin n-grams that count here."""
    data, offsets = W.texts(column)
    starts, ends, first = W.spans(data, offsets, _BLANKS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    word = data[starts] != BREAK
    return data, starts, ends, row, word, word & (np.arange(len(starts)) < first[1:][row] - overlap)


def _run_marks(names: pa.Array) -> np.ndarray:
    """A fingerprint of each row's run."""
    data, offsets = W.texts(names)
    return W.fingerprints(data, offsets[:-1], offsets[1:])


def _keyed(grams: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return W.mix(grams ^ (marks * np.uint64(0x9E3779B97F4A7C15)))


def _gathered(batches: Iterator[pa.RecordBatch], size: int = W.BLOCK // 2) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about ``size`` bytes of chunks."""
    held, until = [], 0
    for batch in W.blocks(batches, "chunk", size):
        held.append(batch)
        until += len(W.texts(batch.column("chunk"))[0])
        if until >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, until = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def count_phrases(chunks: DataFrame, sizes: list[int], longest: int, within: DataFrame | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``(run_id, words, phrase, n)``: occurrences of all phrases of ``sizes`` words in the dictionary ``chunks``.

    Size 0 gives the number of words of a run under the empty phrase. With ``within``, a table ``(run_id, phrase)``, only phrases are
    counted whose first and last parts of one word less are in it; they are looked up in a table of ``filter_bits`` bits, which may let
    others through but misses none.
    """
    overlap = longest - 1
    held = chunks.sparkSession.sparkContext.broadcast(_bits(within, filter_bits)) if within is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8) if held is not None else None
        for batch in _gathered(batches):
            data, starts, ends, row, word, own = _owned(batch.column("chunk"), overlap)
            if not len(starts):
                continue
            times, text = batch.column("times").to_numpy(), data.tobytes()
            marks = _run_marks(batch.column("run_id"))[row]
            prints = W.fingerprints(data, starts, ends)
            runs = batch.column("run_id")
            for size in sizes:
                if size == 0:
                    n = np.bincount(row[own], minlength=len(times)) * times
                    yield pa.RecordBatch.from_arrays([runs, pa.array([""] * len(n), pa.string()), pa.array(n, pa.int64())], ["run_id", "phrase", "n"])
                    continue
                last = len(starts) - size + 1
                if last <= 0:
                    continue
                real = own[:last].copy()
                for k in range(1, size):
                    real &= word[k:last + k]  # no break inside; the shared words at a chunk's end complete what begins before them
                at = np.flatnonzero(real)
                if bits is not None:
                    shorter = _keyed(W.grams(prints, size - 1), marks[:len(starts) - size + 2])
                    at = at[_held(bits, shorter[at]) & _held(bits, shorter[at + 1])]
                keys, one, which = np.unique(_keyed(W.grams(prints, size)[at], marks[at]), return_index=True, return_inverse=True)
                n = np.zeros(len(keys), np.int64)
                np.add.at(n, which, times[row[at]])
                one = at[one]
                for k in range(0, len(one), PHRASES):  # strings of so many phrases at once
                    few = one[k:k + PHRASES]
                    phrases = pa.array([text[a:b] for a, b in zip(starts[few].tolist(), ends[few + size - 1].tolist())], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([runs.take(pa.array(row[few])), phrases, pa.array(n[k:k + PHRASES])], ["run_id", "phrase", "n"])

    counted = chunks.mapInArrow(run, "run_id string, phrase string, n long").groupBy("run_id", "phrase").agg(F.sum("n").alias("n"))
    return counted.withColumn("words", n_words_of(F.col("phrase")))


def n_words_of(phrase: Column) -> Column:
    return F.when(phrase == "", 0).otherwise(F.char_length(phrase) - F.char_length(F.translate(phrase, " ", "")) + 1)


def _held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % np.uint64(8 * len(bits))
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def _bits(phrases: DataFrame, filter_bits: int) -> bytes:
    """Bits set at the fingerprints of ``(run_id, phrase)``. Tasks make the pieces of the table; the driver puts them together, by default 16 MB."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.texts(batch.column("phrase"))
            starts, ends, first = W.spans(data, offsets, _BLANKS)
            if not len(starts):
                continue
            n = np.diff(first)
            at = np.empty(batch.num_rows, np.uint64)
            prints, marks = W.fingerprints(data, starts, ends), _run_marks(batch.column("run_id"))
            for size in np.unique(n):
                of = np.flatnonzero(n == size)
                at[of] = _keyed(W.grams(prints, int(size))[first[:-1][of]], marks[of]) % np.uint64(filter_bits)
            at = np.unique(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PIECE), pa.array((at % PIECE).astype(np.int32))], ["piece", "bit"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for bits in batch.column("bits"):
                piece = np.zeros(PIECE, np.uint8)
                piece[bits.values.to_numpy()] = 1
                made.append(np.packbits(piece, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(made, pa.binary())], ["piece", "bits"])

    pieces = (phrases.select("run_id", "phrase").mapInArrow(place, "piece long, bit int")
              .groupBy("piece").agg(F.collect_set("bit").alias("bits")).mapInArrow(gather, "piece long, bits binary"))
    out = bytearray(filter_bits // 8)
    for row in pieces.toLocalIterator():  # at most filter_bits / PIECE rows of 8 KB
        out[row["piece"] * PIECE // 8:(row["piece"] + 1) * PIECE // 8] = row["bits"]
    return bytes(out)


def _part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def call_phrases(logs: DataFrame, longest: int = 3, at_least: int = 10, share: int = 50, best: int = 2000, unknown: str = "und",
                 trigger: int = TRIGGER, farthest: int = FARTHEST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The phrases of each run whose words stand together more often than their parts suggest.

    ``logs`` has ``run_id`` string and ``log`` string (``records.rank_logs`` makes such rows); other columns are ignored. A-Z are lower-cased, logs are cut into
    pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. Phrases have 2 to ``longest`` words and occur ``at_least`` times, overlaps
    included. A phrase's score is 1,000,000 times the square of its count over the product of its two parts' counts, rounded down, at the
    cut where that is least (ties: the earliest cut). A phrase is dropped if a longer one of the list holds it and occurs
    at least ``share`` percent as often.

    Returns each run's ``best`` by score, count (larger first) and phrase (bytes): ``run_id``, ``rank`` from 1, ``phrase``, ``n_phrase``, ``n_first``, ``n_rest``, ``n_words`` (all of
    the run), ``score``. Counts are exact. Null and empty logs have no words; a null ``run_id`` is the run ``unknown``; equal rows count as often as they
    stand; no rows give no rows. ``trigger`` and ``farthest`` shape the
    chunks and change no result. Shorter phrases are counted first; longer ones only where their parts are frequent. The bits that say
    so are 16 MB at every size: on a corpus that fills them, more rare phrases are counted and then dropped, nothing is lost.
    """
    chunks = written(parse_chunks(logs, longest, unknown, trigger, farthest), "chunks")
    frequent = written(count_phrases(chunks, [0, 1, 2], longest).filter((F.col("words") == 0) | (F.col("n") >= at_least)), "phrases")
    for size in range(3, longest + 1):
        shorter = frequent.filter(F.col("words") == size - 1)
        longer = count_phrases(chunks, [size], longest, shorter, filter_bits).filter(F.col("n") >= at_least)
        frequent = frequent.unionByName(written(longer, "phrases"))
    candidates = frequent.filter("words > 1").withColumn("split", F.split("phrase", " "))
    known = frequent.filter("words > 0").select("run_id", "phrase", "n")

    cuts = candidates.select("run_id", "phrase", F.col("n").alias("n_phrase"), "split", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("run_id", "phrase", "n_phrase", "cut", _part(F.col("split"), F.lit(1), F.col("cut")).alias("left"),
                       _part(F.col("split"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    sides = (cuts.join(known.select("run_id", F.col("phrase").alias("left"), F.col("n").alias("n_first")), ["run_id", "left"])
             .join(known.select("run_id", F.col("phrase").alias("right"), F.col("n").alias("n_rest")), ["run_id", "right"]))
    whole = {c: F.col(c).cast("decimal(18,0)") for c in ("n_phrase", "n_first", "n_rest")}
    scored = (sides.withColumn("over", whole["n_phrase"] * whole["n_phrase"] * F.lit(1_000_000))
              .withColumn("under", whole["n_first"] * whole["n_rest"]).withColumn("score", F.expr("over div under")))
    lowest = scored.groupBy("run_id", "phrase", "n_phrase").agg(F.min(F.struct("score", "cut", "n_first", "n_rest")).alias("low"))

    inner = (candidates.filter("words > 2").select("run_id", "n", "split", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
             .select("run_id", "n", "split", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
             .select("run_id", _part(F.col("split"), F.col("at"), F.col("size")).alias("phrase"), "n")
             .groupBy("run_id", "phrase").agg(F.max("n").alias("n_longer")))
    left = lowest.join(inner, ["run_id", "phrase"], "left").filter(F.coalesce(100 * F.col("n_longer") < share * F.col("n_phrase"), F.lit(True)))
    order = Window.partitionBy("run_id").orderBy(F.col("low.score").desc(), F.col("n_phrase").desc(), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    totals = frequent.filter("words = 0").select("run_id", F.col("n").alias("n_words"))
    return ranked.join(totals, "run_id").select(
        "run_id", F.col("rank").cast("long").alias("rank"), "phrase", "n_phrase", F.col("low.n_first").alias("n_first"), F.col("low.n_rest").alias("n_rest"),
        "n_words", F.col("low.score").cast("long").alias("score"))
