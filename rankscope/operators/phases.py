"""Equal-width run phases and the lookup of events around a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankscope import functions as fx
from rankscope.operators import topk, traffic

PHASE_COUNTS = ["events", "canonical_events", "canonical_bytes", "completion_events",
                "barrier_events", "collective_events"]


def window_count(runtime: Column, rows: Column) -> Column:
    """One window without runtime, else 10 and one more per 50000 rows up to 40."""
    many = F.least(F.lit(40).cast("long"), F.floor(rows / F.lit(50000)).cast("long") + 10)
    return F.when(runtime <= 0, F.lit(1).cast("long")).otherwise(many)


def phase_bounds(events: DataFrame) -> DataFrame:
    """Start, signed runtime and window count of every run."""
    t = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"),
                                     traffic.first_time().alias("start"),
                                     traffic.last_time().alias("end"))
    span = F.col("end") - F.col("start")
    return t.select("run_id", "start", span.alias("span"),
                    window_count(F.greatest(F.lit(0.0), span), F.col("rows")).alias("w"))


def phases(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Event counts per phase; empty phases are kept.

    A last row that lies before the first gives one phase that ends before it starts.
    """
    bounds = phase_bounds(events)
    w, start, span = F.col("w"), F.col("start"), F.col("span")
    at = ((F.col("time") - start) / span * w).cast("long")
    index = F.when(span <= 0, F.lit(0).cast("long")) \
             .otherwise(F.least(w - 1, F.greatest(F.lit(0).cast("long"), at)))
    canonical = fx.is_canonical_transfer()
    # One row a run, so the events stay where they lie: a shuffle by run would give a run's events to one task.
    filled = (events.join(F.broadcast(bounds), "run_id")
              .groupBy("run_id", index.alias("phase"))
              .agg(F.count(F.lit(1)).alias("events"), F.count_if(canonical).alias("canonical_events"),
                   traffic.sum_if(canonical, F.col("bytes")).alias("canonical_bytes"),
                   F.count_if(fx.is_completion()).alias("completion_events"),
                   F.count_if(fx.is_barrier()).alias("barrier_events"),
                   F.count_if(fx.is_collective()).alias("collective_events")))
    grid = bounds.withColumn("phase", F.explode(F.sequence(F.lit(0).cast("long"), w - 1)))
    i = F.col("phase")
    return (grid.join(filled, ["run_id", "phase"], "left").fillna(0, PHASE_COUNTS)
            .select("run_id", "phase", (start + span * i / w).alias("t_start"),
                    (start + span * (i + 1) / w).alias("t_end"), *PHASE_COUNTS))


def phase_shares(phase_table: DataFrame) -> DataFrame:
    """Bytes of a phase relative to the busiest one."""
    busiest = F.greatest(F.max("canonical_bytes").over(Window.partitionBy("run_id")),
                         F.lit(1).cast("long"))
    return phase_table.withColumn("share", fx.safe_div("canonical_bytes", busiest))


def maximum_share(table: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Each value relative to the largest of its run."""
    top = F.max(value).over(Window.partitionBy(*(keys or ["run_id"])))
    return table.withColumn("share", fx.safe_div(value, top))


def phase_at(phase_table: DataFrame, t: float) -> DataFrame:
    """Phases that contain a moment: two of them on a boundary."""
    return phase_table.filter((F.col("t_start") <= t) & (F.col("t_end") >= t))


def phases_at(phase_table: DataFrame, moments: DataFrame) -> DataFrame:
    """Phases that contain the moments ``t`` of their run; a run has at most 40 phases."""
    return phase_table.join(moments.select("run_id", "t"), "run_id") \
        .filter(F.col("t").between(F.col("t_start"), F.col("t_end")))


def chunks_for_time(chunks: DataFrame, t: float) -> DataFrame:
    """Chunk ids to read for a moment: the first chunk ending at or after it, and the one before."""
    target = F.coalesce(F.min(F.when(F.col("t_end") >= t, F.col("chunk_id"))), F.max("chunk_id"))
    return (chunks.groupBy("run_id").agg(target.alias("last"))
            .select("run_id", F.explode(F.sequence(F.greatest(F.col("last") - 1, F.lit(0).cast("long")),
                                                   F.col("last"))).alias("chunk_id")))


def active_window(speed: float = 0.0) -> tuple[float, float]:
    """Seconds looked back for ordinary and for lingering calls."""
    window = min(0.2, 0.05 * 10.0 ** speed)
    return window, max(window * 8.0, 0.5)


def _active(events: DataFrame, t: float, short: float, long: float) -> DataFrame:
    time = F.col("time")
    return events.filter((time <= t) & (time >= t - long)
                         & ((time >= t - short) | fx.lingers()))


def active_events(events: DataFrame, t: float, speed: float = 0.0, k: int | None = None) -> DataFrame:
    """Events shown at a moment of the playback: all of the two time windows, or their newest ``k``."""
    found = _active(events, t, *active_window(speed))
    return found if k is None else topk.newest_active(found, k)


def active_events_live(events: DataFrame, t: float) -> DataFrame:
    """Events shown at a moment of the live view, without a cap."""
    return _active(events, t, 0.05, 0.5)
