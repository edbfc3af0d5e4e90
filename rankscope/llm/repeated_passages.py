"""Passages that several logs share: discovered by seeds, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankscope.llm import words as W
from rankscope.llm.stage import carried, written

WINDOW = 13            # words of the shortest passage
SEED = 5               # words of a seed and of an automaton's phrase
STRIDE = WINDOW - SEED + 1
SHARD_BYTES = 2 << 20  # bytes of text that one automaton is built for

RESULTS = ["log", "n_words", "n_removed"]


def repeated_passages(logs: DataFrame) -> DataFrame:
    """Every place where a log repeats ``WINDOW`` or more words of a log with a smaller ``log_id``.

    ``logs`` has ``log_id`` long and ``log`` string; words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

    Logs that copy a whole earlier log are told by hashes of the text and searched no further. For the others:

    1. Seeds: each window names the ``SEED``-word gram of the smallest fingerprint in it, so equal windows name the same
       seed. About a fifth of all places are seeds, and only seeds that two logs hold lead further.
    2. Passages: windows around such seeds are compared by fingerprint. Windows that two logs hold are merged into passages,
       each cut from the first log that holds it.
    3. Automata: logs are dealt into shards of bounded size. Each shard compiles an Aho-Corasick automaton of
       one phrase in every ``STRIDE`` words of the passages that its logs need, streams its logs through it and extends each
       phrase found as far as the words are equal. This confirms the passage word by word.

    Returns ``log_id``, ``text_key`` (``xxhash64`` of the log), ``first_word``, ``end_word`` and ``source_log``. Stretches overlap where they have different sources.
    Rows that share a ``log_id`` are one log in several pieces. Null logs have no words; rows without ``log_id`` take no part.
    """
    whole = logs.filter("log_id is not null").select(F.col("log_id").cast("long").alias("log_id"), "log",
                                                     F.xxhash64("log").alias("text_key"))
    copies = written(_copies(whole), "copies")
    seeds = (whole.select("log_id", "log").mapInArrow(_seeds, "item long, log_id long")
             .repartition("item").sortWithinPartitions("item", "log_id").mapInArrow(_shared, "item long, log_id long, first_log long"))
    skipped = copies.groupBy("log_id").agg(F.collect_set("text_key").alias("skipped"))
    wanted = seeds.groupBy("log_id").agg(F.collect_list("item").alias("seeds")).join(skipped, "log_id", "left") \
                  .withColumnRenamed("log_id", "of_log")
    regions = written(whole.join(wanted, F.col("log_id") == F.col("of_log"))
                      .mapInArrow(_regions, "log_id long, text_key long, first_word long, words string"), "regions")
    shared = written(regions.select("log_id", "words").mapInArrow(_windows, "item long, log_id long")
                     .repartition("item").sortWithinPartitions("item", "log_id")
                     .mapInArrow(_shared, "item long, log_id long, first_log long"), "shared")
    sources = shared.filter("log_id = first_log").groupBy("first_log").agg(F.collect_set("item").alias("windows"))
    passages = written(regions.select("log_id", "words").join(sources, F.col("log_id") == F.col("first_log"))
                       .mapInArrow(_passages, "first_log long, passage string"), "passages")

    size = regions.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    shard = F.pmod(F.xxhash64("log_id"), F.lit(shards)).cast("int").alias("shard")
    needed = shared.filter("log_id > first_log").select(shard, "first_log").distinct()
    patterns = needed.join(passages, "first_log").select("shard", "first_log", "passage")
    located = (patterns.groupBy("shard").cogroup(regions.select(shard, "*").groupBy("shard"))
               .applyInArrow(_locate, "log_id long, text_key long, first_word long, end_word long, source_log long"))
    return located.unionByName(copies.select("log_id", "text_key", F.lit(0).cast("long").alias("first_word"),
                                             F.col("n_words").alias("end_word"), F.col("first_log").alias("source_log")))


def _copies(whole: DataFrame) -> DataFrame:
    """Logs whose whole text a log with a smaller number has, by two hashes of it; they need no search."""
    keys = whole.select("log_id", "text_key", F.xxhash64(F.lit(WINDOW), "log").alias("second_key"),
                        F.regexp_count("log", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    firsts = keys.groupBy("text_key", "second_key").agg(F.min("log_id").alias("first_log"), F.max("log_id").alias("last_log"))
    return (keys.join(firsts.filter("first_log < last_log").drop("last_log"), ["text_key", "second_key"])
            .filter(f"log_id > first_log and n_words >= {WINDOW}").drop("second_key").distinct())


def strip_repeated_passages(logs: DataFrame) -> DataFrame:
    """Remove every word that ``repeated_passages`` covers.

    Returns the columns of ``logs`` with the kept words joined by one space as ``log``, and ``n_words`` (before)
    and ``n_removed``. All places are judged on the input. A log shorter than a passage stays whole, a null
    log gives an empty one, a row without ``log_id`` keeps all words. No rows give no rows. Columns named like a result are replaced.
    """
    spans = (repeated_passages(logs).groupBy(F.col("log_id").alias("of_log"), F.col("text_key").alias("of_text"))
             .agg(F.collect_set(F.struct("first_word", "end_word")).alias("gone_words")))
    kept = carried(logs, [*RESULTS, "gone_words", "of_log", "of_text"])
    rows = (logs.select(*[F.col(c) for c in kept], "log")
            .join(spans, (F.col("log_id") == F.col("of_log")) & (F.xxhash64("log") == F.col("of_text")), "left").drop("of_log", "of_text"))
    schema = T.StructType([*[logs.schema[c] for c in kept], T.StructField("log", T.StringType()),
                           T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(_without(kept), schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _word_rows(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of ``n`` words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.empty(0, np.int64)


def _window_seeds(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window that lies in one row, and the window's seed."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = W.grams(words, SEED)
    n, width = len(words) - WINDOW + 1, 1
    while 2 * width <= STRIDE:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:n], least[STRIDE - width:STRIDE - width + n])
    at = np.flatnonzero(rows[:n] == rows[WINDOW - 1:])
    return at, least[at]


def _distinct(rows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and items without repeated pairs."""
    order = np.lexsort((items, rows))
    rows, items = rows[order], items[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])
    return rows[new], items[new]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.blocks(batches, "log"):
        data, offsets = W.texts(batch.column("log"))
        starts, ends, first = W.spans(data, offsets, W.SPACES)
        rows = _word_rows(first, len(starts))
        at, seeds = _window_seeds(W.fingerprints(data, starts, ends), rows)
        rows = rows[at]
        new = np.ones(len(at), bool)  # neighbours mostly name the same seed
        new[1:] = (rows[1:] != rows[:-1]) | (seeds[1:] != seeds[:-1])
        rows, seeds = _distinct(rows[new], seeds[new])
        ids = batch.column("log_id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([_signed(seeds), pa.array(ids[rows], pa.int64())], ["item", "log_id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by item and log, those whose item stands in two logs."""
    last, first, open_ = None, None, False  # item at hand, its smallest log, and whether that row is still held back
    for batch in batches:
        items = batch.column("item").to_numpy(zero_copy_only=False)
        logs = batch.column("log_id").to_numpy(zero_copy_only=False)
        if not len(items):
            continue
        head = np.ones(len(items), bool)
        head[1:] = items[1:] != items[:-1]
        head[0] = items[0] != last
        group = np.cumsum(head)  # 0: goes on from the batch before
        firsts = np.concatenate([[first if first is not None else 0], logs[head]])[group]
        differs = logs != firsts
        met = np.zeros(group[-1] + 1, bool)
        met[group[differs]] = True
        out = met[group] & (differs | head)
        extra = open_ and met[0]
        if extra:
            items_out = np.concatenate([[last], items[out]])
            logs_out, firsts_out = np.concatenate([[first], logs[out]]), np.concatenate([[first], firsts[out]])
        else:
            items_out, logs_out, firsts_out = items[out], logs[out], firsts[out]
        yield pa.RecordBatch.from_arrays([pa.array(items_out, pa.int64()), pa.array(logs_out, pa.int64()), pa.array(firsts_out, pa.int64())],
                                         ["item", "log_id", "first_log"])
        if group[-1] == 0:
            open_ = open_ and not met[0]
        else:
            open_ = not met[-1]
        last, first = items[-1], firsts[-1]


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a log in which every window has a shared seed, as words between single spaces."""
    for batch in W.blocks(batches, "log"):
        data, offsets = W.texts(batch.column("log"))
        starts, ends, first = W.spans(data, offsets, W.SPACES)
        at, seeds = _window_seeds(W.fingerprints(data, starts, ends), _word_rows(first, len(starts)))
        out: dict[str, list] = {"log_id": [], "text_key": [], "first_word": [], "words": []}
        for i, (wanted, skipped) in enumerate(zip(batch.column("seeds"), batch.column("skipped"))):
            if skipped.is_valid and batch.column("text_key")[i].as_py() in skipped.as_py():
                continue
            a, z = np.searchsorted(at, first[i]), np.searchsorted(at, first[i + 1])
            hit = at[a:z][np.isin(seeds[a:z].view(np.int64), wanted.values.to_numpy())]
            for low, high in _runs(hit):
                out["log_id"].append(batch.column("log_id")[i].as_py())
                out["text_key"].append(batch.column("text_key")[i].as_py())
                out["first_word"].append(int(low - first[i]))
                words = bytes(data[starts[low]:ends[high + WINDOW - 1]]).split()  # bytes.split() cuts at the same white space
                out["words"].append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out["log_id"], pa.int64()), pa.array(out["text_key"], pa.int64()),
                                          pa.array(out["first_word"], pa.int64()), pa.array(out["words"], pa.string())], list(out))


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive places."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist()))


def _region_windows(batch: pa.RecordBatch):
    data, offsets = W.texts(batch.column("words"))
    starts, ends, first = W.spans(data, offsets, W.SPACES)
    grams = W.grams(W.fingerprints(data, starts, ends), WINDOW)
    rows = _word_rows(first, len(starts))
    at = np.flatnonzero(rows[:len(grams)] == rows[WINDOW - 1:]) if len(grams) else np.empty(0, np.int64)
    return data, starts, ends, first, at, grams, rows


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.blocks(batches, "words"):
        *_, at, grams, rows = _region_windows(batch)
        owners, items = _distinct(rows[at], grams[at])
        ids = batch.column("log_id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([_signed(items), pa.array(ids[owners], pa.int64())], ["item", "log_id"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages a log is the first to hold; of a window that stands there twice only the first place."""
    for batch in W.blocks(batches, "words"):
        data, starts, ends, first, at, grams, _ = _region_windows(batch)
        logs, out = [], []
        for i, wanted in enumerate(batch.column("windows")):
            a, z = np.searchsorted(at, first[i]), np.searchsorted(at, first[i + 1])
            places = at[a:z][np.isin(grams[at[a:z]].view(np.int64), wanted.values.to_numpy())]
            _, once = np.unique(grams[places], return_index=True)
            for low, high in _runs(np.sort(places[once])):
                logs.append(batch.column("first_log")[i].as_py())
                out.append(bytes(data[starts[low]:ends[high + WINDOW - 1]]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(logs, pa.int64()), pa.array(out, pa.string())], ["first_log", "passage"])


def _locate(patterns: pa.Table, regions: pa.Table) -> pa.Table:
    """Stretches of the regions that repeat a passage of a log with a smaller number."""
    sources = patterns.column("first_log").to_pylist()
    passages = [p.split(" ") for p in patterns.column("passage").to_pylist()]
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for p, words in enumerate(passages):
        for at in range(0, len(words) - SEED + 1, STRIDE):
            places[f" {' '.join(words[at:at + SEED])} "].append((p, at))
    out: dict[str, list[int]] = {c: [] for c in ("log_id", "text_key", "first_word", "end_word", "source_log")}
    if places and regions.num_rows:
        automaton = ahocorasick.Automaton()
        for phrase, where in places.items():
            automaton.add_word(phrase, (len(phrase), where))
        automaton.make_automaton()
        for log, key, offset, text in zip(*[regions.column(c).to_pylist() for c in ("log_id", "text_key", "first_word", "words")]):
            text = f" {text} "
            words = text[1:-1].split(" ")
            begins = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            reached: dict[tuple[int, int], int] = {}
            for end, (length, where) in automaton.iter(text):
                at = int(np.searchsorted(begins, end - length + 1))
                for p, place in where:
                    if sources[p] >= log or reached.get((p, at - place), -1) > at:
                        continue
                    low, high = _extend(words, passages[p], at, place)
                    reached[p, at - place] = high
                    if high - low >= WINDOW:
                        for column, value in zip(out.values(), (log, key, offset + low, offset + high, sources[p])):
                            column.append(value)
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def _extend(words: list[str], passage: list[str], at: int, place: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which ``words`` equals the passage aligned there."""
    low, high, shift = at, at + SEED, place - at
    while low > 0 and low + shift > 0 and words[low - 1] == passage[low - 1 + shift]:
        low -= 1
    while high < len(words) and high + shift < len(passage) and words[high] == passage[high + shift]:
        high += 1
    return low, high


def _without(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.blocks(batches, "log"):
            data, offsets = W.texts(batch.column("log"))
            starts, ends, first = W.spans(data, offsets, W.SPACES)
            texts, n_words, n_removed = [], [], []
            for i, spans in enumerate(batch.column("gone_words")):
                a, z = int(first[i]), int(first[i + 1])
                words = bytes(data[offsets[i]:offsets[i + 1]]).split()
                removed = 0
                if spans.is_valid:
                    gone = np.zeros(z - a + 1, np.int64)
                    for span in spans.as_py():
                        gone[span["first_word"]] += 1
                        gone[span["end_word"]] -= 1
                    keep = np.cumsum(gone)[:-1] == 0
                    removed = int((~keep).sum())
                    words = [words[k] for k in np.flatnonzero(keep)]
                texts.append(b" ".join(words).decode())
                n_words.append(z - a)
                n_removed.append(removed)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                [*kept, *RESULTS])
    return run
