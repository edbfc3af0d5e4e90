"""How the filters of a corpus of call logs overlap, for every order in which they may run: contractions of contingency tensors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# White space between words; characters of which a log may hold none.
BLANKS = r"[\x20\x09-\x0D]+"
STRIPPED = " \t\n\x0b\x0c\r"
MARKS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

REPEATED = "E"
RESULTS = "run_id string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, healthy_lost long, suspect_lost long, shapley long"


def log_failures(logs: DataFrame) -> DataFrame:
    """``logs`` with a boolean for every filter that looks at one log alone: ``A`` to ``D``, true where the log fails.

    A: under 200 words; B: less than half of the words differ (case counts); C: over 3 in 100 code points are A-Z; D: holds one
    of ``#$%&*|``. Words end at white space. A null log counts as empty: it fails A only.
    """
    trimmed = F.btrim("log", F.lit(STRIPPED))
    n_points = F.char_length("log")
    rows = (logs.withColumn("log", F.coalesce("log", F.lit("")))
            .withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS, -1))))
    return rows.select(*[c for c in logs.columns], *[
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * (n_points - F.char_length(F.translate("log", UPPER, ""))).cast("long") > 3 * n_points.cast("long")).alias("C"),
        F.col("log").rlike(MARKS).alias("D")])


def contingency(failures: DataFrame, verdicts: DataFrame, alone: str = "ABCD") -> DataFrame:
    """``(run_id, cell, n, healthy, suspect)``: logs of a run by the set of filters they fail; bit ``i`` of ``cell`` is filter ``i``.

    The last filter, ``E``, fails where a log with a smaller ``log_id`` has the same text, in whatever run. All copies of a text agree
    on the other filters, so a text comes down to one row per run and verdict before anything is compared, however
    many copies it has; no two copies meet.
    """
    marked = (verdicts.filter(F.col("log_id").isNotNull()).groupBy(F.col("log_id").cast("long").alias("of_log"))
              .agg(F.max(F.coalesce(F.col("healthy") == 1, F.lit(False))).cast("int").alias("healthy"),
                   F.max(F.coalesce(F.col("suspect") == 1, F.lit(False))).cast("int").alias("suspect")))
    cell = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(alone)), F.lit(0))
    rows = (failures.select(F.col("log_id").cast("long").alias("log_id"), F.coalesce(F.col("run_id").cast("string"), F.lit("")).alias("run_id"),
                            F.unhex(F.sha2(F.coalesce("log", F.lit("")), 256)).alias("text_key"), cell.alias("cell"))
            .join(marked, F.col("log_id") == F.col("of_log"), "left").drop("of_log").fillna(0, ["healthy", "suspect"]))
    kind = ["text_key", "run_id", "cell", "healthy", "suspect"]
    # Rows that share a log number are one log in several rows; rows without one have no smaller log and are none's.
    numbered = rows.groupBy(*kind, "log_id").agg(F.count(F.lit(1)).alias("n"))
    texts = numbered.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("log_id").isNull(), F.col("n"))), F.lit(0)).alias("unnumbered"),
                                        F.min("log_id").alias("least"), F.min_by("n", "log_id").alias("n_least"))
    first = F.min("least").over(Window.partitionBy("text_key"))
    passing = F.col("unnumbered") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    halves = texts.withColumn("first", first).select("run_id", "healthy", "suspect", F.explode(F.array(
        F.struct(F.col("cell").alias("cell"), passing.cast("long").alias("n")),
        F.struct((F.col("cell") + (1 << len(alone))).alias("cell"), (F.col("n") - passing).cast("long").alias("n")))).alias("half"))
    n = F.col("half.n")
    return (halves.groupBy("run_id", F.col("half.cell").alias("cell"))
            .agg(F.sum(n).alias("n"), F.sum(n * F.col("healthy")).alias("healthy"), F.sum(n * F.col("suspect")).alias("suspect"))
            .filter("n > 0"))


def order_statistics(tensor: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """Counts for every order of the filters and every step, by contraction.

    ``tensor`` is ``[run, measure, 2, ..., 2]``: measures are logs, healthy and suspect ones; an axis of a filter has pass at 0 and fail
    at 1. A step picks pass, fail or all along each axis. Returns arrays ``[run, order, step]``; orders are in alphabetical order.
    """
    k = len(names)
    letters = "abcdefghij"[:k]
    contract = f"xm{letters}," + ",".join(f"r{c}" for c in letters) + "->xmr"
    passed, failed, either = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    orders = list(permutations(range(k)))

    def counts(pick) -> np.ndarray:
        rows = np.array([[pick(f, order, step) for f in range(k)] for order in orders for step in range(k)], np.int64)
        out = np.einsum(contract, tensor, *[rows[:, f] for f in range(k)], optimize=True)
        return out.reshape(*out.shape[:2], len(orders), k)

    def place(f, order):
        return order.index(f)

    kept = counts(lambda f, o, s: passed if place(f, o) <= s else either)
    removed = counts(lambda f, o, s: passed if place(f, o) < s else failed if place(f, o) == s else either)
    failing = counts(lambda f, o, s: failed if place(f, o) == s else either)
    alone = counts(lambda f, o, s: failed if place(f, o) == s else passed)
    by_filter = np.zeros((len(tensor), k), np.int64)
    for n, order in enumerate(orders):
        by_filter[:, list(order)] += removed[:, 0, n, :]
    return {"kept": kept[:, 0], "removed": removed[:, 0], "redundant": (failing - removed)[:, 0], "unique_fails": alone[:, 0],
            "healthy_lost": removed[:, 1], "suspect_lost": removed[:, 2],
            "shapley": np.stack([by_filter[:, list(order)] for order in orders], axis=1)}


def audit_filters(logs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What every filter does at every step of every order: five filters, 120 orders, counted per run.

    ``logs`` has ``log_id`` long, ``run_id`` string and ``log`` string, as ``records.rank_logs`` makes them; other columns are ignored, whatever
    their names. ``verdicts`` has ``log_id``, ``healthy`` and ``suspect`` (1 or not; several rows of a log count as one, the larger value
    wins). Filters are those of ``log_failures`` and ``E``, a text that a smaller ``log_id`` also has. Null and empty texts are equal, a null
    ``run_id`` is the run with the empty name, a row without ``log_id`` neither fails ``E`` nor makes others fail it.

    Returns 600 rows per run, zeros included: ``run_id``, ``filter_order`` (the letters as applied), ``step`` (1 to 5), and long counts
    of logs: ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed earlier), ``unique_fails`` (fail its filter
    only), ``healthy_lost`` and ``suspect_lost`` (removed by it), ``shapley`` (removed by its filter, summed over all orders). No rows
    give no rows. Logs are counted in Spark down to 32 cells a run; tasks contract the cells of as many runs as a batch holds.
    """
    names = "ABCD" + REPEATED
    cells = contingency(log_failures(logs.select("log_id", "run_id", "log")), verdicts)
    runs = cells.groupBy("run_id").agg(F.collect_list(F.struct("cell", "n", "healthy", "suspect")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = ["".join(o) for o in permutations(names)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = np.zeros((part.num_rows, 3, 1 << len(names)), np.int64)
                for x, of_run in enumerate(part.column("cells").to_pylist()):
                    for c in of_run:
                        flat[x, :, c["cell"]] = c["n"], c["healthy"], c["suspect"]
                # Bit 0 of a cell is the last axis of the reshaped tensor.
                tensor = flat.reshape(part.num_rows, 3, *[2] * len(names)).transpose(0, 1, *range(len(names) + 1, 1, -1))
                made = order_statistics(tensor, names)
                n, rows = len(orders) * len(names), part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(part.column("run_id").to_pylist(), object), n), pa.string()),
                     pa.array(np.tile(np.repeat(np.array(orders, object), len(names)), rows), pa.string()),
                     pa.array(np.tile(np.arange(1, len(names) + 1), rows * len(orders)), pa.int32()),
                     *[pa.array(v.reshape(-1), pa.int64()) for v in made.values()]],
                    ["run_id", "filter_order", "step", *made])

    return runs.mapInArrow(run, RESULTS)
