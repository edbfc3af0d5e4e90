"""Log probabilities of logs by n-gram counts in a log-frequency Bloom filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankscope.llm import words as W
from rankscope.llm.stage import carried, written

SLICE_BITS = 1 << 22    # of a part of the filter (512 KiB), made by one task
SLICES = 64             # parts of the smallest filter; they double until every n-gram has its bits
SHARED_SLICES = 256     # parts up to which all workers hold the filter (128 MiB); more are joined with what is looked up in them
PROBES = 5
BITS_PER_ENTRY = 10     # with 5 probes one membership test in a hundred is wrong
HEAD = 1 << 20          # most frequent tokens whose exact counts every worker holds (16 MiB)
BIGRAM_SHARE = 0.3      # weight of the bigram in the smoothed probability
END = np.uint64(0x5EED0F7E5C0DEEAD)       # fingerprint of the end of a log
_SALT = {1: np.uint64(0x1B873593CC9E2D51), 2: np.uint64(0x52DCE729A0761D64)}

RESULTS = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def learned_from(log_id: Column) -> Column:
    """True for logs that counts come from; the others are held out. A log without number is held out."""
    return F.coalesce(F.crc32(log_id.cast("string")) % 7 != 2, F.lit(False))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all tokens, each log's words and one end, and the first token of every log."""
    data, offsets = W.texts(batch.column("log"))
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    return np.insert(W.fingerprints(data, starts, ends), first[1:], END), first + np.arange(len(first))


def _pairs(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each token with the one before it, and which tokens have one before them."""
    grams = np.zeros(len(tokens), np.uint64)
    grams[1:] = W.grams(tokens, 2)
    has = np.ones(len(tokens), bool)
    has[first[:-1]] = False
    return grams, has


def ngram_counts(logs: DataFrame) -> DataFrame:
    """``(n, gram, times)`` of the tokens and pairs of tokens of all ``logs``; blocks are counted before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.blocks(batches, "log"):
            tokens, first = _tokens(batch)
            grams, has = _pairs(tokens, first)
            for n, items in ((1, tokens), (2, grams[has])):
                items, times = np.unique(items, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), n, np.int32)), pa.array(items.view(np.int64)), pa.array(times, pa.int64())],
                                                 ["n", "gram", "times"])
    return logs.select("log").mapInArrow(run, "n int, gram long, times long").repartition("gram").groupBy("n", "gram").agg(F.sum("times").alias("times"))


class CountFilter:
    """Quantised counts of n-grams: one with count c is entered ``1 + floor(log2 c)`` times, each time with its level.

    A count is read by probing level after level until one is missing. Errors only raise a count, each level less likely.
    """

    def __init__(self, slices: np.ndarray):
        self.bits = slices  # a row of bytes per slice

    @staticmethod
    def _keys(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the first probe of each n-gram goes at a level, and how far each later one is from the one before."""
        key = W.mix(grams + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        return key, (key >> np.uint64(32)) | np.uint64(1)

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(SLICE_BITS - 1)).astype(np.int64)

    @staticmethod
    def salted(grams: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        return W.mix(grams ^ np.where(np.asarray(n) == 1, _SALT[1], _SALT[2]))

    @staticmethod
    def slice_of(salted: np.ndarray, slices: int) -> np.ndarray:
        """Slice of each salted n-gram, by its first bits; ``slices`` is a power of two."""
        return (salted >> np.uint64(32) >> np.uint64(33 - slices.bit_length())).astype(np.int64)

    def levels(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Level of the count of each n-gram, 0 for none."""
        salted = self.salted(grams, n)
        return self.levels_at(self.slice_of(salted, len(self.bits)), salted)

    def levels_at(self, rows: np.ndarray, salted: np.ndarray) -> np.ndarray:
        """The same for salted n-grams whose slices are in these rows."""
        out = np.zeros(len(salted), np.int64)
        left = np.arange(len(salted))
        for level in range(1, 64):
            key, step = self._keys(salted[left], level)
            for _ in range(PROBES):  # most absent ones are gone after the first probe
                place = self._place(key)
                met = self.bits[rows[left], place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                left, key, step = left[met], key[met], step[met]
                key = key + step
            out[left] = level
            if not len(left):
                break
        return out

    def counts(self, grams: np.ndarray, n: int) -> np.ndarray:
        return _middle(self.levels(grams, n))


def _middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of each level."""
    return np.where(level > 0, 1.5 * 2.0 ** (level - 1) - 0.5, 0.0)


def filter_slices(counts: DataFrame) -> tuple[int, DataFrame]:
    """Number of slices of the filter of ``counts(n, gram, times)``, and ``(slice, bits)`` of those that hold something.

    All n-grams are entered. There are as many slices as give each entry ``BITS_PER_ENTRY``, so errors are as rare at every size.
    """
    level = F.floor(F.log2("times")).cast("int") + 1
    held, slices = counts.agg(F.sum(level)).first()[0] or 0, SLICES
    while held * BITS_PER_ENTRY > slices * SLICE_BITS:
        slices *= 2

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salted = CountFilter.salted(batch.column("gram").to_numpy().view(np.uint64), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(CountFilter.slice_of(salted, slices), pa.int64()), pa.array(salted.view(np.int64)), batch.column("level")],
                                             ["slice", "gram", "level"])

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(SLICE_BITS, bool)
        grams, levels = table.column("gram").to_numpy().view(np.uint64), table.column("level").to_numpy()
        for level in range(1, int(levels.max(initial=0)) + 1):
            key, step = CountFilter._keys(grams[levels >= level], level)
            for _ in range(PROBES):
                bits[CountFilter._place(key)] = True
                key = key + step
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    entries = counts.select("n", "gram", level.alias("level"))
    return slices, entries.mapInArrow(keyed, "slice long, gram long, level int").groupBy("slice").applyInArrow(fill, "slice long, bits binary")


def _held(slices: int, parts: DataFrame) -> CountFilter:
    bits = np.zeros((slices, SLICE_BITS // 8), np.uint8)
    for at, data in written(parts, "slices").toLocalIterator():  # made by all tasks at once, then fetched a few at a time
        bits[at] = np.frombuffer(data, np.uint8)
    return CountFilter(bits)


def count_filter(counts: DataFrame) -> CountFilter:
    """The whole filter of ``counts(n, gram, times)`` in one place."""
    return _held(*filter_slices(counts))


def _smoothed(tokens: np.ndarray, first: np.ndarray, total: int, counts: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Log10 of the smoothed share of every token, with ``counts`` of n-grams as the filter has them."""
    kinds, which = np.unique(tokens, return_inverse=True)
    pairs, has = _pairs(tokens, first)
    single = counts(kinds, 1)[which]
    pair = np.zeros(len(tokens))
    pair[has] = counts(pairs[has], 2)
    before = np.concatenate([[1.0], np.maximum(single[:-1], 1.0)])
    share = np.where(has, BIGRAM_SHARE, 0.0)
    return np.log10((1 - share) * (single + 1) / total + share * np.minimum(pair / np.maximum(before, pair), 1.0))


def _scores_by_slices(blocks: DataFrame, total: int, slices: int, parts: DataFrame) -> DataFrame:
    """``(row, score)`` of ``blocks(block, row, log)`` by a filter that no worker holds whole.

    The different n-grams of a block go to their slices, and the levels found there back to the block. A block asks for an n-gram once,
    so frequent ones load no slice, and slices grow in number with the filter.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                tokens, first = _tokens(batch.slice(a, z - a))
                pairs, has = _pairs(tokens, first)
                for n, grams in ((1, np.unique(tokens)), (2, np.unique(pairs[has]))):
                    at = CountFilter.slice_of(CountFilter.salted(grams, n), slices)
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.full(len(grams), block[a])), pa.array(np.full(len(grams), n, np.int32)),
                                                      pa.array(grams.view(np.int64))], ["slice", "block", "n", "gram"])

    def look(asked: pa.Table, part: pa.Table) -> pa.Table:
        asked = asked.select(["block", "n", "gram"])
        level = np.zeros(asked.num_rows, np.int64)
        if part.num_rows and asked.num_rows:
            own = CountFilter(np.frombuffer(part.column("bits")[0].as_py(), np.uint8)[None])
            salted = CountFilter.salted(asked.column("gram").to_numpy().view(np.uint64), asked.column("n").to_numpy())
            level = own.levels_at(np.zeros(len(salted), np.int64), salted)
        return asked.append_column("level", pa.array(level, pa.int64())).filter(pa.array(level > 0))

    def rate(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        n = found.column("n").to_numpy()
        grams, level = found.column("gram").to_numpy().view(np.uint64), found.column("level").to_numpy()
        known = {}
        for k in (1, 2):
            own, at = np.unique(grams[n == k], return_index=True)
            known[k] = own, level[n == k][at]

        def counts(asked: np.ndarray, k: int) -> np.ndarray:
            own, own_level = known[k]
            if not len(own):
                return np.zeros(len(asked))
            at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            return _middle(np.where(own[at] == asked, own_level[at], 0))

        tokens, first = _tokens(pa.RecordBatch.from_arrays([block.column("log").combine_chunks()], ["log"]))
        smooth = _smoothed(tokens, first, total, counts)
        return pa.table({"row": block.column("row"), "score": pa.array(np.add.reduceat(smooth, first[:-1]))})

    asked = blocks.select("block", "log").mapInArrow(ask, "slice long, block long, n int, gram long")
    found = asked.groupBy("slice").cogroup(parts.groupBy("slice")).applyInArrow(look, "block long, n int, gram long, level long")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(rate, "row long, score double")


def score_likelihood(logs: DataFrame, keep_log: bool = True) -> DataFrame:
    """Log10 probability of every log, by a model of the logs of ``learned_from``.

    ``logs`` has ``log_id`` and ``log`` string; null is empty. Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case and one end.

    ``base_score`` is exact: the sum of log10 of (c + 1) / (N + V + 1) with the token's count c, all tokens N and different tokens V. Workers hold the
    exact counts of the ``HEAD`` most frequent tokens; the rest of a log's tokens are joined with the table of counts. ``score`` uses only the filter: with counts
    read from it, each token has (1 - ``BIGRAM_SHARE``) of its smoothed share and ``BIGRAM_SHARE`` of its share after the token before it. The filter holds every
    n-gram and grows with them. Above ``SHARED_SLICES`` its slices stay where they are and lookups are joined with them; what is read is the same.

    Returns the columns of ``logs`` (without ``log`` unless ``keep_log``) with ``held_out``, ``n_tokens``, ``n_known`` (c > 0), ``train_tokens`` (N), ``base_score`` and ``score``. Every row is scored on its own; repeated
    rows count as often as they stand there. Nothing to learn from gives N = V = 0 and all shares 1. No rows give no rows. Columns named like a result are replaced.
    """
    spark = logs.sparkSession
    counts = written(ngram_counts(logs.filter(learned_from(F.col("log_id")))), "counts")
    words = counts.filter("n = 1")
    # Tokens by range of their counts, 16 to a doubling: about a thousand rows whatever the input.
    sizes = words.groupBy(F.floor(F.log2("times") * 16).alias("range")).agg(
        F.min("times").alias("least"), F.count(F.lit(1)).alias("v"), F.sum("times").alias("total")).collect()
    n_all, v_all = sum(r["total"] for r in sizes), sum(r["v"] for r in sizes)
    least, held = (1 << 63) - 1, 0  # with more than HEAD tokens in the highest range, workers hold none
    for r in sorted(sizes, key=lambda r: -r["least"]):
        held += r["v"]
        if held > HEAD:
            break
        least = r["least"]
    head = words.filter(F.col("times") >= least).select("gram", "times").toArrow()
    order = np.argsort(head.column("gram").to_numpy().view(np.uint64))
    frequent = head.column("gram").to_numpy().view(np.uint64)[order], head.column("times").to_numpy()[order]
    slices, parts = filter_slices(counts)
    split = slices > SHARED_SLICES
    shared = spark.sparkContext.broadcast((*frequent, None if split else _held(slices, parts)))
    total = n_all + v_all + 1
    kept = [c for c in carried(logs, [*RESULTS, "row", "block", "rest"]) if keep_log or c != "log"]
    stored = list(dict.fromkeys([*kept, "log"])) if split else kept  # slices are looked up with the texts at hand

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        grams, times, model = shared.value
        for batch in W.blocks(batches, "log"):
            tokens, first = _tokens(batch)
            kinds, which = np.unique(tokens, return_inverse=True)
            c = np.zeros(len(kinds), np.int64)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, kinds), len(grams) - 1)
                c = np.where(grams[at] == kinds, times[at], 0)
            c = c[which]
            rest = tokens[c == 0].view(np.int64)
            bounds = np.concatenate([[0], np.cumsum(c == 0)])[first]
            score = pa.nulls(batch.num_rows, pa.float64()) if model is None else \
                pa.array(np.add.reduceat(_smoothed(tokens, first, total, model.counts), first[:-1]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in stored], pa.array(row + np.arange(batch.num_rows)), pa.array(np.full(batch.num_rows, row)), pa.array(np.diff(first), pa.int64()),
                 pa.array(np.add.reduceat(c > 0, first[:-1], dtype=np.int64)), pa.array(np.add.reduceat(np.log10(c + 1.0), first[:-1])),
                 score, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rest, pa.int64()))],
                [*stored, "row", "block", "n_tokens", "known", "part", "score", "rest"])
            row += batch.num_rows

    fields = [("row", T.LongType()), ("block", T.LongType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("part", T.DoubleType()), ("score", T.DoubleType()),
              ("rest", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[logs.schema[k] for k in stored], *[T.StructField(k, t) for k, t in fields]])
    scored = written(logs.select(*dict.fromkeys([*kept, "log"])).mapInArrow(run, schema), "scored")
    own = scored.drop("rest", "block")
    if split:
        own = own.drop("score").join(_scores_by_slices(scored.select("block", "row", "log"), total, slices, written(parts, "slices")), "row")
    tail = (scored.select("row", F.explode("rest").alias("gram")).join(words.filter(F.col("times") < least).select("gram", "times"), "gram")
            .groupBy("row").agg(F.count(F.lit(1)).alias("met"), F.sum(F.log10(F.col("times") + 1)).alias("more")))
    return (own.join(tail, "row", "left")
            .select(*kept, (~learned_from(F.col("log_id"))).alias("held_out"), "n_tokens",
                    (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                    (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total))).alias("base_score"), "score"))
