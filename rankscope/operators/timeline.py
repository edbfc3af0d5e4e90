"""Building, aligning, ordering and chunking the event timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators.ordinal import number_keys

CHUNK_ROWS = 500_000


def _as_event(df: DataFrame, rec_kind: int) -> DataFrame:
    empty = (F.col("cnt") <= 0) & (F.col("bytes") <= 0) if rec_kind else F.lit(False)
    return df.select(
        "run_id", "rank_recording", "section_pos", F.lit(rec_kind).alias("rec_kind"), "rec_pos",
        "part", "event_id", "call_code", fx.call_name().alias("call"), "comm", "tag", "sender",
        "receiver", "cnt", "bytes", fx.category().alias("category"),
        empty.alias("synthetic_empty"), "local_time",
        F.lit(None).cast("long").alias("epoch_ns"), F.col("local_time").alias("time"))


def small_to_events(small: DataFrame) -> DataFrame:
    """One event per small record."""
    return _as_event(small.withColumn("part", F.lit(0)), 0)


def large_to_events(large: DataFrame) -> DataFrame:
    """Two events per large record, one per direction."""
    return _as_event(large.select("*", F.inline("parts")).drop("parts"), 1)


def build_timeline(small: DataFrame, large: DataFrame) -> DataFrame:
    return small_to_events(small).unionByName(large_to_events(large))


def with_call_name(df: DataFrame, code: str = "call_code") -> DataFrame:
    return df.withColumn("call", fx.call_name(code))


def usable_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.filter(F.col("unix_time_zero_ns") > 0)


def register_time(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """Put every rank on one clock whose zero is the earliest anchor of the run.

    Rows of ranks without a usable anchor keep their local time and have no epoch.
    """
    usable = usable_anchors(anchors)
    origin = usable.groupBy("run_id").agg(F.min("unix_time_zero_ns").alias("origin_ns"))
    zero = usable.join(origin, "run_id").select(
        "run_id", F.col("rank").alias("rank_recording"), "unix_time_zero_ns", "origin_ns")
    epoch = F.col("unix_time_zero_ns") + F.rint(F.col("local_time") * 1.0e9).cast("long")
    joined = events.drop("epoch_ns", "time").join(
        zero, ["run_id", "rank_recording"], "left")
    out = joined.withColumn("epoch_ns", epoch).withColumn(
        "time", F.coalesce((F.col("epoch_ns") - F.col("origin_ns")) / F.lit(1.0e9),
                           F.col("local_time")))
    return out.select(*events.columns)


def timeline_metadata(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Which clock a run's timeline uses and where its zero lies."""
    origin = usable_anchors(anchors).groupBy("run_id") \
        .agg(F.min("unix_time_zero_ns").alias("timeline_origin_unix_ns"))
    known = F.col("timeline_origin_unix_ns").isNotNull()
    kept = [c for c in ["time_registration"] if c in runs.columns]
    return runs.join(origin, "run_id", "left").select(
        "run_id", *kept,
        F.when(known, "global-epoch-registered").otherwise("local-relative").alias("timeline_clock"),
        F.when(known, "minimum-rank-anchor").otherwise("as-recorded").alias("timeline_origin"),
        "timeline_origin_unix_ns")


def register_time_live(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """Epoch of a live event: negative offsets count as zero, halves round up."""
    ns = F.floor(F.greatest(F.col("local_time"), F.lit(0.0)) * 1e9 + 0.5).cast("long")
    zero = anchors.select("run_id", F.col("rank").alias("rank_recording"), "unix_time_zero_ns")
    return (events.drop("epoch_ns")
            .join(zero, ["run_id", "rank_recording"])
            .withColumn("epoch_ns", F.col("unix_time_zero_ns") + ns)
            .drop("unix_time_zero_ns"))


def sort_timeline(events: DataFrame) -> DataFrame:
    return events.orderBy("run_id", *S.timeline_order())


def with_chunk_id(events: DataFrame, chunk_rows: int = CHUNK_ROWS, order: list[Column] | None = None) -> DataFrame:
    """Number of the fixed-size chunk that holds each row of the run's timeline. ``order`` may replace the timeline order."""
    return number_keys(events, ["run_id"], order) \
        .withColumn("chunk_id", F.expr(f"ordinal div {int(chunk_rows)}"))


def chunk_index(chunked: DataFrame) -> DataFrame:
    """Time of the first and last row and the row count of every chunk."""
    return chunked.groupBy("run_id", "chunk_id").agg(
        F.min_by("time", "ordinal").alias("t_start"),
        F.max_by("time", "ordinal").alias("t_end"),
        F.count(F.lit(1)).alias("n_events"))
