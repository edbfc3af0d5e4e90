"""Exact histogram of encoded log lengths; suffix sums answer totals, quantiles and cut totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankscope.llm import words as W
from rankscope.llm.stage import written
from rankscope.llm.tokens import encoder

SPAN = 1024  # lengths whose running sums one window task makes


def log_length_histogram(logs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Logs by number of tokens, with sums for every context limit.

    ``logs`` has ``log`` string; null has no tokens. Tasks count lengths before the shuffle, so what moves is as large as the
    number of different lengths. One row per length that occurs: ``length``, ``n_logs``, ``n_tokens`` (theirs together), ``logs_from`` and
    ``tokens_from`` (of logs at least so long), and ``cut_tokens`` (all tokens if every log is cut at ``length``). No rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in W.blocks(batches, "log"):
            _, begins = coder.encode(batch.column("log"))
            lengths, n = np.unique(np.diff(begins), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(n, pa.int64())], ["length", "n"])

    counted = written(logs.select("log").mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_logs")), "lengths")
    counts = (counted.withColumn("n_tokens", F.col("length") * F.col("n_logs")).withColumn("span", F.expr(f"length div {SPAN}")))
    later = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per SPAN lengths
    spans = (counts.groupBy("span").agg(F.sum("n_logs").alias("l"), F.sum("n_tokens").alias("t"))
             .select("span", F.coalesce(F.sum("l").over(later), F.lit(0)).alias("logs_after"),
                     F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
                     F.sum("t").over(Window.partitionBy()).alias("all_tokens")))
    up = Window.partitionBy("span").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (counts.join(spans, "span")
            .withColumn("logs_from", F.sum("n_logs").over(up) + F.col("logs_after"))
            .withColumn("tokens_from", F.sum("n_tokens").over(up) + F.col("tokens_after"))
            .select("length", "n_logs", "n_tokens", "logs_from", "tokens_from",
                    (F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("logs_from")).alias("cut_tokens")))


def cut_total(histogram: DataFrame, limit: int) -> int:
    """All tokens if every log is cut at ``limit``."""
    row = histogram.agg(F.sum(F.least("length", F.lit(limit)) * F.col("n_logs"))).first()
    return row[0] or 0


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length that at least ``share`` of the logs do not exceed; null for no logs."""
    total = histogram.agg(F.sum("n_logs")).first()[0]
    if total is None:
        return None
    need = share * total
    return histogram.filter(total - F.col("logs_from") + F.col("n_logs") >= need).agg(F.min("length")).first()[0]
