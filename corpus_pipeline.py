"""A corpus of documents made ready for training: five operators over call logs, applied to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankscope.llm import benchmark_calls, log_quality, near_logs, pack_logs, repeated_calls
from rankscope.llm.queries import as_benchmarks, as_logs, as_verdicts, table
from rankscope.llm.stage import written


def _as_logs(docs: DataFrame) -> DataFrame:
    """Documents as call logs; further columns get names that no operator gives or takes."""
    others = [F.col(c).alias(f"_column{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select(F.col("doc_id").alias("log_id"), F.col("text").alias("log"), *others)


def _as_documents(logs: DataFrame, columns: list[str]) -> DataFrame:
    """Logs as documents with ``columns``, in the order in which ``_as_logs`` met them."""
    names = {"doc_id": "log_id", "text": "log"}
    return logs.select(*[F.col(names.get(c, f"_column{i}")).alias(c) for i, c in enumerate(columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    scored = log_quality.score_logs(_as_logs(docs), as_verdicts(table(spark, sf_dir, "labels")))
    return _as_documents(scored.filter(F.col("score") >= log_quality.CUT_SCORE), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of earlier documents; ``n_chars`` follows the text."""
    kept = _as_documents(repeated_calls.drop_repeated_calls(_as_logs(docs)), docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles and a similarity of 0.8."""
    groups = near_logs.near_duplicate_logs(as_logs(docs))
    gone = groups.filter("not kept").select(F.col("log_id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    marked = benchmark_calls.mark_benchmark_calls(_as_logs(docs), as_benchmarks(table(spark, sf_dir, "benchmark")))
    return _as_documents(marked.filter("n_hit = 0"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences."""
    return pack_logs.pack_logs(as_logs(docs)).withColumnsRenamed({"log_id": "doc_id", "log_tokens": "doc_tokens"})


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

# Learning, MinHash and tokenization are beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
