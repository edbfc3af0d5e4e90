"""Lines that an earlier log already holds, found with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rankscope.llm import words as W
from rankscope.llm.stage import carried, written

# White space stripped from both ends of a line, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)

RESULTS = ["log", "n_lines", "n_dropped"]


class LineRuns:
    """Runs ``(key, first_log)``, each sorted by key; no key stands in two runs.

    A new run starts at level 0. ``fanout`` runs of one level are merged into one of the next, so after
    ``n`` batches there are at most ``fanout * log(n)`` runs and each key was rewritten ``log(n)`` times.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.runs = spark, fanout, []

    def all(self) -> DataFrame | None:
        out = None
        for _, run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def add(self, batch: DataFrame) -> None:
        """Add the keys of ``batch(key, log_id)`` that no run holds, each with its smallest log."""
        first = batch.groupBy("key").agg(F.min("log_id").alias("first_log"))
        held = self.all()
        fresh = first if held is None else first.join(held.select("key"), "key", "left_anti")
        self.runs.append((0, self._sorted(fresh)))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level <= max(at for at, _ in self.runs):
            same = [run for at, run in self.runs if at == level]
            if len(same) >= self.fanout:
                merged = same[0]
                for run in same[1:]:
                    merged = merged.unionByName(run)
                self.runs = [(at, run) for at, run in self.runs if at != level]
                self.runs.append((level + 1, self._sorted(merged)))
            level += 1

    def _sorted(self, df: DataFrame) -> DataFrame:
        return written(df.repartition("key").sortWithinPartitions("key"), "run")


def folded(line: Column) -> Column:
    """A line as it is compared: without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def drop_repeated_calls(logs: DataFrame, batches: int = 4, fanout: int = 2, min_length: int = 10) -> DataFrame:
    """Drop every line of a log that also stands in a log with a smaller ``log_id``.

    ``logs`` has ``log_id`` long and ``log`` string, one call per line as ``records.rank_logs`` makes them.
    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    ``min_length`` code points that two or more logs hold lose all lines but those of the smallest ``log_id``.
    Logs are taken in ``batches`` ranges of ``log_id``, smaller ids first; each range is anti-joined with the
    sorted runs of the ranges before it and adds a run of its own (``LineRuns``). A daily load would add one batch.

    Returns the columns of ``logs`` with the kept ``log``, and ``n_lines`` (before dropping) and ``n_dropped``.
    Null and empty logs have one empty line. Rows that share a ``log_id`` count as one log in several
    pieces. A row without ``log_id`` keeps all lines and marks none. No rows give no rows. Columns named like a result are replaced.
    """
    text = F.coalesce("log", F.lit(""))
    key = folded(F.col("line"))
    keys = written(logs.filter(F.col("log_id").isNotNull())
                   .select(F.col("log_id").cast("long").alias("log_id"), F.explode(F.split(text, "\n", -1)).alias("line"))
                   .filter(F.char_length(key) >= min_length)
                   .select("log_id", F.unhex(F.md5(key)).alias("key")), "line-keys")
    shares = [i / batches for i in range(1, batches)]
    cuts = keys.agg(F.percentile_approx("log_id", F.array(*map(F.lit, shares)), 1000)).first()[0] if shares else None
    edges = [None, *sorted(set(cuts or [])), None]
    runs = LineRuns(logs.sparkSession, fanout)
    for low, high in zip(edges, edges[1:]):
        batch = keys if low is None else keys.filter(F.col("log_id") > low)
        runs.add(batch if high is None else batch.filter(F.col("log_id") <= high))
    dropped = (keys.join(runs.all(), "key").filter("first_log < log_id")
               .groupBy(F.col("log_id").alias("of_log")).agg(F.collect_set("key").alias("dropped_keys")))
    kept = carried(logs, [*RESULTS, "dropped_keys", "of_log"])
    rows = (logs.select(*[F.col(c) for c in kept], text.alias("log"))
            .join(dropped, F.col("log_id") == F.col("of_log"), "left").drop("of_log"))
    schema = T.StructType([*[logs.schema[c] for c in kept], T.StructField("log", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.mapInArrow(_without(kept), schema)


def _without(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.blocks(batches, "log"):
            out, lines, gone = [], [], []
            for log, keys in zip(batch.column("log"), batch.column("dropped_keys")):
                all_lines = log.as_py().split("\n")
                drop = set(keys.as_py() or ())
                left = [x for x in all_lines if _key(x) not in drop] if drop else all_lines
                out.append("\n".join(left))
                lines.append(len(all_lines))
                gone.append(len(all_lines) - len(left))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())],
                [*kept, *RESULTS])
    return run


def _key(line: str) -> bytes:
    return hashlib.md5(line.strip(STRIPPED).translate(_FOLD).encode()).digest()
