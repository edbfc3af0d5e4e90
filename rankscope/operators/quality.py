"""Trace quality checks. Each returns the rows that violate it; empty means the trace passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import pairing
from rankscope.operators.traffic import rank_spine


def rank_coverage(rows: DataFrame, runs: DataFrame, rank: str = "rank") -> DataFrame:
    """Ranks without a row, with several rows, or outside the run."""
    n = rows.groupBy("run_id", F.col(rank).alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    spine = rank_spine(runs).withColumn("expected", F.lit(True))
    problem = (F.when(F.col("expected").isNull(), "out of range")
                .when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate"))
    return (spine.join(n, ["run_id", "rank"], "full").withColumn("problem", problem)
            .filter(F.col("problem").isNotNull()).select("run_id", "rank", "problem"))


def bad_anchors(anchors: DataFrame, runs: DataFrame) -> DataFrame:
    """Anchors of version 2 traces that are not finite or not positive."""
    zero = F.col("mpi_time_zero")
    finite = zero.isNotNull() & ~F.isnan(zero) & (F.abs(zero) != float("inf"))
    v2 = runs.filter(F.col("file_format_version") >= 2).select("run_id")
    return anchors.join(v2, "run_id", "left_semi") \
        .filter(~finite | ~F.coalesce(F.col("unix_time_zero_ns") > 0, F.lit(False)))


def first_last(events: DataFrame) -> DataFrame:
    """Call of each rank's first and last small record in record order."""
    at = F.struct("section_pos", "rec_pos")
    return events.filter(F.col("rec_kind") == 0).groupBy("run_id", "rank_recording").agg(
        F.min_by("call_code", at).alias("first_code"), F.max_by("call_code", at).alias("last_code"))


def broken_bookends(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Ranks that do not start with Init and end with Finalize."""
    ends = first_last(events).withColumnRenamed("rank_recording", "rank")
    good = F.coalesce((F.col("first_code") == S.INIT) & (F.col("last_code") == S.FINALIZE),
                      F.lit(False))
    return rank_spine(runs).join(ends, ["run_id", "rank"], "left").filter(~good)


def expect_rows(events: DataFrame, expectations: list[dict]) -> DataFrame:
    """Expectations whose number of matching rows differs, per run.

    Each expectation has ``n``, an optional ``label`` and the column values a row must have.
    All are counted in one pass.
    """
    def matches(expected: dict) -> Column:
        cond = F.lit(True)
        for name, value in expected.items():
            if name not in ("n", "label"):
                cond = cond & F.col(name).eqNullSafe(F.lit(value))
        return cond

    counts = [F.count_if(matches(e)).alias(f"found{i}") for i, e in enumerate(expectations)]
    rows = [F.struct(F.lit(e.get("label", str(i))).alias("label"), F.lit(e["n"]).cast("long").alias("n"),
                     F.col(f"found{i}").alias("found")) for i, e in enumerate(expectations)]
    return events.groupBy("run_id").agg(*counts).select("run_id", F.inline(F.array(*rows))) \
                 .filter(F.col("found") != F.col("n"))


def tag_mismatch(sends: DataFrame, receives: DataFrame, keys: list[str]) -> DataFrame:
    """Tags of a pair that do not occur equally often on both sides."""
    s = sends.select(*keys, "tag", F.lit(1).alias("balance"))
    r = receives.select(*keys, "tag", F.lit(-1).alias("balance"))
    return (s.unionByName(r).groupBy(*keys, "tag").agg(F.sum("balance").alias("balance"))
            .filter(F.col("balance") != 0))


def mixed_comm(events: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose rows do not share one communicator."""
    return (events.groupBy(*keys).agg(F.min("comm").alias("low"), F.max("comm").alias("high"))
            .filter(F.col("low") != F.col("high")))


def stray_control(events: DataFrame) -> DataFrame:
    """Waits and tests whose tag or communicator is neither 0 nor used by that rank's requests."""
    own = ["run_id", "rank_recording"]
    control = events.filter(fx.is_completion())
    transfers = events.filter(fx.is_send_like() | fx.is_recv_like())
    bad = None
    for field in ("tag", "comm"):
        used = transfers.select(*own, field).distinct()
        rows = control.filter(F.col(field) != 0).join(used, own + [field], "left_anti") \
            .select(*own, "event_id", F.lit(field).alias("field"), F.col(field).cast("long").alias("value"))
        bad = rows if bad is None else bad.unionByName(rows)
    return bad


def tagged_collectives(events: DataFrame) -> DataFrame:
    """Collective and barrier rows with a tag."""
    return events.filter((fx.is_collective() | fx.is_barrier()) & (F.col("tag") != 0))


def pair_disagreement(events: DataFrame) -> DataFrame:
    """Matched pairs whose two sides differ in count or bytes; the key makes the rest agree."""
    pairs = pairing.pair_p2p(events, payload=True)
    return pairs.filter((F.col("send_cnt") != F.col("recv_cnt"))
                        | (F.col("send_bytes") != F.col("recv_bytes")))


def unmirrored_sendrecv(events: DataFrame) -> DataFrame:
    """Exchanges whose tags do not occur, swapped, equally often on the partner's side.

    Each exchange is reduced to (own rank, peer, out tag, in tag); its mirror must have the
    same count, so one signed sum per unordered exchange replaces a self join.
    """
    key = ["run_id", "rank_recording", "event_id", "section_pos", "rec_pos"]
    part = F.col("part")
    both = (events.filter(F.col("call_code") == S.SENDRECV).groupBy(*key).agg(
        F.max(F.when(part == 1, F.col("sender"))).alias("a"),
        F.max(F.when(part == 1, F.col("receiver"))).alias("b"),
        F.max(F.when(part == 1, F.col("tag"))).alias("out_tag"),
        F.max(F.when(part == 2, F.col("tag"))).alias("in_tag")))
    low = F.col("a") < F.col("b")
    ordered = both.filter(F.col("a") != F.col("b")).select(
        "run_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"),
        F.when(low, F.col("out_tag")).otherwise(F.col("in_tag")).alias("tag_up"),
        F.when(low, F.col("in_tag")).otherwise(F.col("out_tag")).alias("tag_down"),
        F.when(low, 1).otherwise(-1).alias("balance"))
    return (ordered.groupBy("run_id", "low", "high", "tag_up", "tag_down")
            .agg(F.sum("balance").alias("balance")).filter(F.col("balance") != 0))


def aggregate_mismatch(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Gather, Scatter and Allgather records whose aggregate part has the wrong size.

    The aggregate is n times the member part at the root (everywhere for Allgather) and 0 at
    the other ranks of a world-sized communicator.
    """
    code, part = F.col("call_code"), F.col("part")
    member = F.when(code == S.SCATTER, part == 2).otherwise(part == 1)
    key = ["run_id", "rank_recording", "event_id", "section_pos", "rec_pos", "call_code"]

    def pick(cond: Column, value: str) -> Column:
        return F.max(F.when(cond, F.col(value)))

    rec = events.filter(code.isin(S.GATHER, S.SCATTER, S.ALLGATHER)).groupBy(*key).agg(
        pick(member, "cnt").alias("member_cnt"), pick(~member, "cnt").alias("total_cnt"),
        pick(member, "bytes").alias("member_bytes"), pick(~member, "bytes").alias("total_bytes"),
        pick(~member, "sender").alias("root"))
    n = F.when((code == S.ALLGATHER) | (F.col("root") == F.col("rank_recording")),
               F.col("total_ranks")).otherwise(0)
    return rec.join(runs.select("run_id", "total_ranks"), "run_id").filter(
        (F.col("total_cnt") != F.col("member_cnt") * n)
        | (F.col("total_bytes") != F.col("member_bytes") * n)).drop("total_ranks")


def cancelled_leftovers(events: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Cancelled requests that left a transfer row, or whose wait left no row.

    ``cancelled`` has run_id, rank, call_code, sender, receiver, tag and wait_id (event id).
    """
    as_event = cancelled.withColumnRenamed("rank", "rank_recording")
    on = ["run_id", "rank_recording", "call_code", "sender", "receiver", "tag"]
    left_over = as_event.join(events.select(*on).distinct(), on, "left_semi") \
        .withColumn("problem", F.lit("transfer row present"))
    waits = events.filter(fx.is_completion()).select(
        "run_id", "rank_recording", F.col("event_id").alias("wait_id")).distinct()
    no_wait = as_event.join(waits, ["run_id", "rank_recording", "wait_id"], "left_anti") \
        .withColumn("problem", F.lit("wait row missing"))
    return left_over.unionByName(no_wait)
