"""The numbered queries: the given tables mapped to call logs and profiles, and results mapped back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankscope.llm import benchmark_calls, byte_tokens, call_phrases, filter_audit, log_lengths, log_likelihood, log_quality, near_logs, notices, pack_logs, repeated_calls, \
    repeated_passages, similar_profiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_logs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("log_id"), F.col("text").alias("log"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(table(spark, sf_dir, "documents"))


def as_benchmarks(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("benchmark_id"), F.col("text").alias("log"))


def as_verdicts(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").alias("log_id"), F.col("quality").alias("healthy"))


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lengths.log_length_histogram(_logs(spark, sf_dir))


def op2_similar_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("profile"))
    found = similar_profiles.similar_profiles(profiles, F.col("profile_id") % 20 == 0, k=20, scale=64)
    return found.withColumnRenamed("profile_id", "vec_id")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = repeated_passages.strip_repeated_passages(_logs(spark, sf_dir))
    return stripped.select(F.col("log_id").alias("doc_id"), "n_words", "n_removed", F.sha2("log", 256).alias("kept_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_logs.near_duplicate_logs(_logs(spark, sf_dir), shingle=2, percent=80).withColumnRenamed("log_id", "doc_id")


def op5_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan_notices(_logs(spark, sf_dir)).drop("log").withColumnRenamed("log_id", "doc_id")


def op6_benchmark_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = benchmark_calls.mark_benchmark_calls(_logs(spark, sf_dir), as_benchmarks(table(spark, sf_dir, "benchmark")))
    names = F.array_sort(F.transform("benchmark_ids", lambda i: i.cast("string")))
    return marked.select(F.col("log_id").alias("doc_id"), "n_words", "n_hit", F.size("benchmark_ids").cast("long").alias("n_items"),
                         F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_logs.pack_logs(_logs(spark, sf_dir))
    return packed.select(F.col("log_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
                         F.col("log_tokens").alias("doc_tokens"), "sequence_id", "offset")


def op8_repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeated_calls.drop_repeated_calls(_logs(spark, sf_dir))
    return kept.select(F.col("log_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("log", 256).alias("kept_sha256"))


def op9_log_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = log_quality.score_logs(_logs(spark, sf_dir), as_verdicts(table(spark, sf_dir, "labels")))
    return scored.select(F.col("log_id").alias("doc_id"), "held_out", "score", (F.col("score") >= log_quality.CUT_SCORE).cast("int").alias("predicted"))


def op10_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_likelihood.score_likelihood(_logs(spark, sf_dir), keep_log=False).withColumnRenamed("log_id", "doc_id")


def op11_call_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("lang").alias("run_id"), F.col("text").alias("log"))
    return call_phrases.call_phrases(logs).withColumnsRenamed(
        {"run_id": "lang", "n_phrase": "a", "n_first": "l", "n_rest": "r", "n_words": "n"})


def op12_byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_tokens.encode_logs(_logs(spark, sf_dir))
    decoded = byte_tokens.decode_logs(encoded.withColumn("ids_sha256", F.sha2("ids", 256)))
    return decoded.select(F.col("log_id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("log", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("log_id"), F.col("lang").alias("run_id"), F.col("text").alias("log"))
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("log_id"), F.col("quality").alias("healthy"), F.col("toxic").alias("suspect"))
    return filter_audit.audit_filters(logs, verdicts).withColumnsRenamed(
        {"run_id": "part", "healthy_lost": "good_lost", "suspect_lost": "toxic_lost"})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_length_histogram, op2_similar_profiles, op3_repeated_passages, op4_near_duplicates, op5_notices, op6_benchmark_calls, op7_packing,
    op8_repeated_calls, op9_log_quality, op10_log_likelihood, op11_call_phrases, op12_byte_tokens, op13_filter_audit, pipeline)}
