"""Ordered reports: the largest links, ranks, roots and spreads of every run.

Limits are per run and use a filtered row number, which Spark evaluates as a group limit: each
task keeps only its own first k rows before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import traffic

LINKS, RANKS, WORST_BARRIERS, ACTIVE_EVENTS = 20, 10, 8, 800
REPORT_LINKS, REPORT_RANKS, REPORT_ROOTS = 10, 10, 8


def first_rows(df: DataFrame, order: list[Column], k: int | None, keys: list[str] | None = None,
               position: str = "position") -> DataFrame:
    """The first k rows per run in the given order, numbered from 1."""
    w = Window.partitionBy(*(keys or ["run_id"])).orderBy(*order)
    out = df.withColumn(position, F.row_number().over(w))
    return out if k is None else out.filter(F.col(position) <= k)


def top_items(df: DataFrame, value: str, n: int, descending: bool = True,
              ties: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Top n rows of a key/value table."""
    lead = F.col(value).desc() if descending else F.col(value).asc()
    return first_rows(df, [lead, *[F.col(c) for c in ties or []]], n, keys)


def _seen_order() -> list[Column]:
    return [F.col("bytes").desc(), F.col("first_epoch").asc_nulls_last(), F.col("seen_time"),
            F.col("first_seen")]


def top_links(events: DataFrame, runs: DataFrame, k: int = LINKS,
              link_table: DataFrame | None = None) -> DataFrame:
    """Links with most bytes; equal ones in order of first appearance."""
    table = traffic.links(events) if link_table is None else link_table
    canonical = events.filter(fx.is_canonical_transfer())
    seen = traffic.with_first_seen(table, canonical, ["comm", "sender", "receiver"], runs, k)
    return first_rows(seen, _seen_order(), k).select(
        "run_id", "position", "comm", "sender", "receiver", "messages", "bytes", "calls",
        "first_time", "last_time")


def ordered_roots(events: DataFrame, runs: DataFrame, k: int | None = None,
                  roots: DataFrame | None = None) -> DataFrame:
    """Collective roots by bytes; equal ones in order of first appearance."""
    table = traffic.collective_roots(events) if roots is None else roots
    rooted = events.filter(fx.is_canonical_transfer() & fx.is_rooted()) \
                   .withColumn("root", fx.collective_root())
    seen = traffic.with_first_seen(table, rooted, ["root"], runs, k)
    return first_rows(seen, _seen_order(), k).select(
        "run_id", "position", "root", "events", "bytes", "calls")


def top_ranks(ranks: DataFrame, value: str, k: int = RANKS,
              messages: str | None = None) -> DataFrame:
    """Ranks with the largest ``value``; equal ones by rank, idle ones included."""
    extra = [F.col(messages).alias("messages")] if messages else []
    return first_rows(ranks, [F.col(value).desc(), F.col("rank")], k).select(
        "run_id", "position", "rank", F.col(value).alias("bytes"), *extra)


def top_ranks_by_out(ranks: DataFrame, k: int = RANKS) -> DataFrame:
    return top_ranks(ranks, "canonical_bytes_out", k, "canonical_messages_out")


def top_ranks_by_in(ranks: DataFrame, k: int = RANKS) -> DataFrame:
    return top_ranks(ranks, "canonical_bytes_in", k, "canonical_messages_in")


def top_ranks_by_touch(ranks: DataFrame, k: int = RANKS) -> DataFrame:
    return top_ranks(ranks, "touch_bytes", k)


def worst_barriers(spreads: DataFrame, k: int = WORST_BARRIERS) -> DataFrame:
    return first_rows(spreads, [F.col("spread").desc(), F.col("barrier_index")], k)


def newest_active(active: DataFrame, k: int = ACTIVE_EVENTS) -> DataFrame:
    """The newest k rows of an active set, numbered in ascending order of time."""
    newest = [F.col("time").desc(), *S.timeline_order(descending=True)]
    kept = first_rows(active, newest, k, position="age")
    w = Window.partitionBy("run_id").orderBy(F.col("age").desc())
    return kept.withColumn("position", F.row_number().over(w)).drop("age")
