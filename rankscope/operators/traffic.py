"""Histograms, per-rank activity, links, collective roots and run-level totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankscope import functions as fx
from rankscope import schema as S

BIN_COLUMNS = ["b0", "b1", "b2", "b3", "b4", "b5"]
CANONICAL_CALLS = sorted(S.CALLS[c] for c in S.SEND_LIKE + [S.SENDRECV] + S.ROOTED)


def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def sum_if(cond: Column, value) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0).cast("long"))


# --- message-size histogram ---------------------------------------------------

def message_histogram(events: DataFrame) -> DataFrame:
    """Rows per call and size bin, one row per call; placeholders open a row but add nothing."""
    counted = ~F.col("synthetic_empty")
    return (events.groupBy("run_id", "call_code")
            .agg(*[n_if(counted & fx.in_bin("bytes", i)).alias(c) for i, c in enumerate(BIN_COLUMNS)])
            .withColumn("call", fx.call_name())
            .select("run_id", "call", "call_code", *BIN_COLUMNS))


def histogram_long(wide: DataFrame) -> DataFrame:
    """The histogram as (call, bin, n) rows."""
    cells = F.array(*[F.struct(F.lit(label).alias("bin"), F.col(c).alias("n"))
                      for label, c in zip(S.BINS, BIN_COLUMNS)])
    return wide.select("run_id", "call", F.inline(cells))


def histogram_totals(wide: DataFrame, runs: DataFrame) -> DataFrame:
    total = sum((F.col(c) for c in BIN_COLUMNS[1:]), F.col(BIN_COLUMNS[0]))
    return (wide.withColumn("total", total).join(runs.select("run_id", "total_ranks"), "run_id")
            .withColumn("per_rank_avg", F.when(F.col("total_ranks") > 0,
                                               fx.safe_div("total", "total_ranks")).otherwise(0.0))
            .drop("total_ranks"))


# --- totals -------------------------------------------------------------------

def first_time() -> Column:
    """Time of the first row in timeline order: aligned rows precede the others."""
    aligned = F.col("epoch_ns").isNotNull()
    return F.coalesce(F.min(F.when(aligned, F.col("time"))), F.min("time"))


def last_time() -> Column:
    aligned = F.col("epoch_ns").isNotNull()
    return F.coalesce(F.max(F.when(~aligned, F.col("time"))), F.max("time"))


def trace_totals(events: DataFrame) -> DataFrame:
    """Everything that needs one pass over a run and no grouping finer than the run."""
    canonical = fx.is_canonical_transfer()
    out = events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        n_if(canonical).alias("canonical_events"),
        sum_if(canonical, F.col("bytes")).alias("canonical_bytes"),
        n_if(fx.is_completion()).alias("completion_events"),
        n_if(fx.is_barrier()).alias("barrier_events"),
        n_if(fx.is_collective()).alias("collective_events"),
        n_if(fx.is_global()).alias("global_collective_events"),
        n_if(canonical & (F.col("bytes") < 128)).alias("small128_events"),
        n_if(canonical & (F.col("bytes") < 1024)).alias("small1k_events"),
        first_time().alias("start_time"), last_time().alias("end_time"))
    return out.withColumn("runtime", F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time")))


def runtime(events: DataFrame) -> DataFrame:
    return trace_totals(events).select("run_id", "start_time", "end_time", "runtime")


def small_messages_by_call(events: DataFrame) -> DataFrame:
    """Canonical rows per call, with those below 128 and 1024 bytes."""
    return (events.filter(fx.is_canonical_transfer()).groupBy("run_id", "call_code")
            .agg(F.count(F.lit(1)).alias("events"), n_if(F.col("bytes") < 128).alias("lt_128"),
                 n_if(F.col("bytes") < 1024).alias("lt_1024"))
            .withColumn("call", fx.call_name()))


def small_message_ratio(totals: DataFrame) -> DataFrame:
    return totals.select("run_id", "small128_events", "small1k_events",
                         fx.safe_div("small1k_events", "canonical_events").alias("small1k_ratio"))


def completion_ratio(totals: DataFrame) -> DataFrame:
    return totals.select("run_id", "completion_events",
                         fx.safe_div("completion_events", "canonical_events").alias("completion_ratio"))


def barrier_fraction(totals: DataFrame) -> DataFrame:
    return totals.select("run_id", "barrier_events",
                         fx.safe_div("barrier_events", "total_events").alias("barrier_fraction"))


# --- ranks --------------------------------------------------------------------

def rank_spine(runs: DataFrame) -> DataFrame:
    """Every rank of every run."""
    return runs.filter(F.col("total_ranks") > 0).select(
        "run_id", F.explode(F.sequence(F.lit(0), F.col("total_ranks") - 1)).alias("rank"))


def _on_spine(runs: DataFrame, *parts: DataFrame) -> DataFrame:
    out = rank_spine(runs)
    for part in parts:
        out = out.join(part, ["run_id", "rank"], "left")
    return out.fillna(0)


def _activity(events: DataFrame) -> DataFrame:
    completion = fx.is_completion()
    return events.groupBy("run_id", F.col("rank_recording").alias("rank")).agg(
        F.count(F.lit(1)).alias("events"),
        n_if(completion).alias("completion_events"),
        n_if(fx.is_barrier()).alias("barrier_events"),
        n_if(fx.is_collective()).alias("collective_events"),
        n_if(fx.is_global()).alias("global_collective_events"),
        n_if(fx.is_rooted()).alias("rooted_collective_events"),
        sum_if(completion & (F.col("cnt") > 0), F.col("cnt")).alias("completion_request_count"))


def rank_activity(events: DataFrame, runs: DataFrame) -> DataFrame:
    return _on_spine(runs, _activity(events))


def rank_pairs(events: DataFrame) -> DataFrame:
    """Canonical traffic per directed pair of ranks; all per-rank traffic derives from it."""
    return (events.filter(fx.is_canonical_transfer()).groupBy("run_id", "sender", "receiver")
            .agg(F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes")))


def _side(pairs: DataFrame, end: str, suffix: str) -> DataFrame:
    """Traffic of one end; a pair occurs once, so counting rows counts distinct peers."""
    return pairs.groupBy("run_id", F.col(end).alias("rank")).agg(
        F.sum("bytes").alias(f"canonical_bytes_{suffix}"),
        F.sum("messages").alias(f"canonical_messages_{suffix}"),
        F.count(F.lit(1)).alias(f"distinct_{suffix}_peers"))


def rank_traffic_out(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    return _on_spine(runs, _side(pairs, "sender", "out")).drop("distinct_out_peers")


def rank_traffic_in(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    return _on_spine(runs, _side(pairs, "receiver", "in")).drop("distinct_in_peers")


def rank_traffic(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    return _on_spine(runs, _side(pairs, "sender", "out"), _side(pairs, "receiver", "in")) \
        .withColumn("touch_bytes", F.col("canonical_bytes_out") + F.col("canonical_bytes_in"))


def distinct_peers(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    return rank_traffic(pairs, runs).select("run_id", "rank", "distinct_out_peers", "distinct_in_peers")


def per_rank(events: DataFrame, runs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    pairs = rank_pairs(events) if pairs is None else pairs
    return rank_activity(events, runs).join(rank_traffic(pairs, runs), ["run_id", "rank"])


def rank_balance(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean peers and the variation of touched bytes over all ranks, idle ones included."""
    return rank_traffic(pairs, runs).groupBy("run_id").agg(
        fx.mean("distinct_out_peers").alias("avg_out_peers"),
        fx.mean("distinct_in_peers").alias("avg_in_peers"),
        fx.cv("touch_bytes").alias("touch_cv"))


# --- links and roots ----------------------------------------------------------

def _call_map() -> Column:
    """Non-zero per-call counters as a map in name order."""
    entries = ", ".join(f"struct('{c}' as key, {c} as value)" for c in CANONICAL_CALLS)
    return F.expr(f"map_from_entries(filter(array({entries}), e -> e.value > 0))")


def _call_counters() -> list[Column]:
    return [F.expr(f"count_if(call_code = {S.CODE[c]}) as {c}") for c in CANONICAL_CALLS]


def links(events: DataFrame) -> DataFrame:
    """Canonical traffic per (comm, sender, receiver) in a single hash aggregation.

    Per-call counts are plain counters folded into a map afterwards. ``first_epoch`` and
    ``seen_time`` order links by first appearance.
    """
    return (events.filter(fx.is_canonical_transfer())
            .groupBy("run_id", "comm", "sender", "receiver")
            .agg(F.count(F.lit(1)).alias("messages"), F.sum("bytes").alias("bytes"),
                 *_call_counters(),
                 F.min("time").alias("first_time"), F.max("time").alias("last_time"),
                 F.min("epoch_ns").alias("first_epoch"), first_time().alias("seen_time"))
            .withColumn("calls", _call_map())
            .select("run_id", "comm", "sender", "receiver", "messages", "bytes", "calls",
                    "first_time", "last_time", "first_epoch", "seen_time"))


def edge_calls(events: DataFrame) -> DataFrame:
    """Canonical traffic per link and call: the one small table links and roots both follow from."""
    return (events.filter(fx.is_canonical_transfer())
            .groupBy("run_id", "comm", "sender", "receiver", "call_code")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
                 F.min("time").alias("first_time"), F.max("time").alias("last_time"),
                 F.min("epoch_ns").alias("first_epoch"), first_time().alias("seen_time")))


def _fold(edges: DataFrame, keys: list[str], count: str, *extra: Column) -> DataFrame:
    """Edge rows of a key added up, with the per-call counts as a map."""
    counters = [F.expr(f"sum(if(call_code = {S.CODE[c]}, n, 0)) as {c}") for c in CANONICAL_CALLS]
    seen = F.expr("coalesce(min(if(first_epoch is not null, seen_time, null)), min(seen_time)) as seen_time")
    return (edges.groupBy("run_id", *keys)
            .agg(F.sum("n").alias(count), F.sum("bytes").alias("bytes"), *counters, *extra,
                 F.min("first_epoch").alias("first_epoch"), seen)
            .withColumn("calls", _call_map()).drop(*CANONICAL_CALLS))


def links_of_edges(edges: DataFrame) -> DataFrame:
    """The link table from the edge table."""
    return _fold(edges, ["comm", "sender", "receiver"], "messages",
                 F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))


def roots_of_edges(edges: DataFrame) -> DataFrame:
    """The collective-root table from the edge table."""
    rooted = edges.filter(fx.is_rooted()).withColumn("root", fx.collective_root())
    return _fold(rooted, ["root"], "events")


def pairs_of_links(link_table: DataFrame) -> DataFrame:
    """Rank pairs from the link table, without another pass over the events."""
    return link_table.groupBy("run_id", "sender", "receiver").agg(
        F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"))


def collective_roots(events: DataFrame) -> DataFrame:
    """Canonical rooted-collective traffic per root over all communicators."""
    return (events.filter(fx.is_canonical_transfer() & fx.is_rooted())
            .withColumn("root", fx.collective_root())
            .groupBy("run_id", "root")
            .agg(F.count(F.lit(1)).alias("events"), F.sum("bytes").alias("bytes"),
                 *_call_counters(), F.min("epoch_ns").alias("first_epoch"),
                 first_time().alias("seen_time"))
            .withColumn("calls", _call_map())
            .select("run_id", "root", "events", "bytes", "calls", "first_epoch", "seen_time"))


def link_shape(link_table: DataFrame) -> DataFrame:
    return link_table.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pairs_observed"), F.max("bytes").alias("top_link_bytes"))


def pair_density(link_table: DataFrame, runs: DataFrame) -> DataFrame:
    n = F.col("total_ranks").cast("long")
    return (runs.join(link_shape(link_table), "run_id", "left").fillna(0, ["pairs_observed"])
            .select("run_id", "pairs_observed",
                    fx.safe_div(F.col("pairs_observed"), n * F.greatest(n - 1, F.lit(0)))
                    .alias("pair_density")))


def top_link_share(link_table: DataFrame) -> DataFrame:
    """Share of the largest link; link bytes sum to the canonical bytes of the run."""
    return link_table.groupBy("run_id").agg(
        F.max("bytes").alias("top_link_bytes"), F.sum("bytes").alias("canonical_bytes"),
        fx.safe_div(F.max("bytes"), F.sum("bytes")).alias("top_link_share"))


def top_root_share(roots: DataFrame) -> DataFrame:
    return roots.groupBy("run_id").agg(
        F.max("bytes").alias("top_root_bytes"), F.sum("bytes").alias("root_bytes"),
        fx.safe_div(F.max("bytes"), F.sum("bytes")).alias("top_root_share"))


def with_first_seen(table: DataFrame, events: DataFrame, keys: list[str],
                    runs: DataFrame, places: int | None = None) -> DataFrame:
    """Add ``first_seen``, which orders rows still tied on bytes and first time.

    Bytes, first epoch and first time come from the aggregation itself; only rows that tie on
    all three look up the rest of their first event. One row per run tells which runs have
    ties and in which time range, and gates the second pass over ``events``: it is broadcast, so
    without ties (the usual case) adaptive execution drops that pass before it starts. ``places`` keeps the rows
    that can still reach the first ``places`` positions.
    """
    order = [F.col("bytes").desc(), F.col("first_epoch").asc_nulls_last(), F.col("seen_time")]
    if places is not None:
        best = Window.partitionBy("run_id").orderBy(*order)
        table = table.withColumn("place", F.rank().over(best)) \
                     .filter(F.col("place") <= places).drop("place")
    same = Window.partitionBy("run_id", "bytes", "first_epoch", "seen_time")
    tied = (table.withColumn("twins", F.count(F.lit(1)).over(same)).filter(F.col("twins") > 1)
            .select("run_id", *keys, "first_epoch", "seen_time"))
    gate = tied.groupBy("run_id").agg(
        F.min("first_epoch").alias("e0"), F.max("first_epoch").alias("e1"),
        F.bool_or(F.col("first_epoch").isNull()).alias("unaligned"))
    inside = F.col("epoch_ns").between(F.col("e0"), F.col("e1")) \
        | (F.col("epoch_ns").isNull() & F.col("unaligned"))
    tail = ["event_id", "rank_recording", "section_pos", "rec_kind", "rec_pos", "part"]
    near = (events.join(F.broadcast(gate), "run_id").filter(inside)
            .select("run_id", *keys, "epoch_ns", "time", *tail))
    heads = (near.join(tied, ["run_id", *keys])
             .filter(F.col("epoch_ns").eqNullSafe(F.col("first_epoch"))
                     & (F.col("time") == F.col("seen_time")))
             .groupBy("run_id", *keys).agg(F.min(F.struct(*tail)).alias("first_seen")))
    return table.join(heads, ["run_id", *keys], "left")
