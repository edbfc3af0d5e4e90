"""Call logs and traffic profiles: the records of a trace that these operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankscope import schema as S


def rank_logs(events: DataFrame, seconds: float = 60.0) -> DataFrame:
    """The calls of every rank as text, one log per rank and ``seconds`` of its run.

    A line is a call with its communicator, tag, partner and bytes, in timeline order. Cutting by time bounds the length of a
    log, however long the run. Returns ``log_id`` (long, from the other three), ``run_id``, ``rank_recording``, ``slice`` and ``log``.
    """
    line = F.concat_ws(" ", "call", "comm", "tag", "sender", "receiver", "bytes")
    rows = events.withColumn("slice", F.floor(F.col("time") / seconds).cast("long"))
    return (rows.groupBy("run_id", "rank_recording", "slice")
            .agg(F.sort_array(F.collect_list(F.struct(S.order_key().alias("place"), line.alias("line")))).alias("calls"))
            .select(F.xxhash64("run_id", "rank_recording", "slice").alias("log_id"), "run_id", "rank_recording", "slice",
                    F.array_join(F.col("calls.line"), "\n").alias("log")))


def traffic_profiles(links: DataFrame, width: int = 64) -> DataFrame:
    """What each rank sends, as a vector: share of its bytes by partner number modulo ``width``.

    ``links`` has ``run_id``, ``sender``, ``receiver`` and ``bytes``. Returns ``profile_id``, ``run_id``, ``rank`` and ``profile``, an array of ``width`` doubles.
    """
    sent = links.groupBy("run_id", F.col("sender").alias("rank"), F.pmod("receiver", F.lit(width)).alias("at")).agg(F.sum("bytes").alias("bytes"))
    return (sent.groupBy("run_id", "rank").agg(F.map_from_entries(F.collect_list(F.struct("at", "bytes"))).alias("by"), F.sum("bytes").alias("total"))
            .select(F.xxhash64("run_id", "rank").alias("profile_id"), "run_id", "rank",
                    F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                lambda i: F.coalesce(F.try_divide(F.element_at("by", i), F.col("total")), F.lit(0.0))).alias("profile")))
