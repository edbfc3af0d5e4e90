"""The whole analysis of a trace: every report, its summary tables and the nested document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import phases, rules, topk, traffic
from rankscope.plans.metrics import GROUPS, Trace

SECTIONS = ["summary", "per_rank", "top_ranks_by_out_bytes", "top_ranks_by_in_bytes",
            "top_ranks_by_touch_bytes", "top_links", "collective_roots", "barrier_spreads",
            "patterns", "issues", "time_windows"]

LINK_FIELDS = ["comm", "sender", "receiver", "messages", "bytes", "calls", "first_time", "last_time"]


def with_rule_tables(trace: Trace, metrics: DataFrame, names=("top_link", "top_ranks_by_touch")) -> DataFrame:
    """Attach the largest link and the five busiest ranks, which some rules report."""
    out = metrics
    if "top_link" in names:
        first = topk.top_links(trace.events, trace.runs, 1, trace.links)
        out = out.join(first.select("run_id", F.struct(*LINK_FIELDS).alias("top_link")),
                       "run_id", "left")
    if "top_ranks_by_touch" in names:
        five = topk.top_ranks_by_touch(trace.ranks, 5).groupBy("run_id").agg(
            F.array_sort(F.collect_list(F.struct("position", "rank", "bytes"))).alias("ranked"))
        listed = F.transform("ranked", lambda r: F.struct(r["rank"].alias("rank"), r["bytes"].alias("bytes")))
        out = out.join(five.select("run_id", listed.alias("top_ranks_by_touch")), "run_id", "left")
    return out


def rule_outcome(trace: Trace, kind: str) -> DataFrame:
    """One rule evaluated from just the metric groups it reads."""
    r = rules.rule(kind)
    return rules.evaluate(with_rule_tables(trace, trace.metrics(r.groups), r.tables), r)


def report_metrics(trace: Trace) -> DataFrame:
    """The full metrics row that patterns, issues and summaries share."""
    return trace.kept("report", lambda: with_rule_tables(trace, trace.metrics(GROUPS)))


def patterns(trace: Trace) -> DataFrame:
    return rules.patterns(with_rule_tables(trace, trace.metrics(
        ("totals", "links", "touch", "roots")), ("top_link",)))


def issues(trace: Trace) -> DataFrame:
    return rules.issues(report_metrics(trace))


def analyse(trace: Trace) -> dict[str, DataFrame]:
    """All sections of the analysis.

    The events are read once each for totals, edges, rank activity, phases, barriers and the three
    kinds of matching, so they should be a stored timeline, and the trace one that shares tables.
    """
    events, runs = trace.events, trace.runs
    metrics = report_metrics(trace)
    return {
        "summary": metrics.select(
            "run_id", "total_events", F.col("canonical_events").alias("canonical_transfer_events"),
            F.col("canonical_bytes").alias("canonical_transfer_bytes"), "completion_events",
            "barrier_events", "collective_events", F.col("runtime").alias("estimated_runtime"),
            "pair_density", "avg_out_peers", "avg_in_peers"),
        "per_rank": traffic.rank_activity(events, runs).join(trace.ranks, ["run_id", "rank"]),
        "top_ranks_by_out_bytes": topk.top_ranks_by_out(trace.ranks),
        "top_ranks_by_in_bytes": topk.top_ranks_by_in(trace.ranks),
        "top_ranks_by_touch_bytes": topk.top_ranks_by_touch(trace.ranks),
        "top_links": topk.top_links(events, runs, link_table=trace.links),
        "collective_roots": trace.roots,
        "barrier_spreads": trace.spreads,
        "patterns": rules.patterns(metrics),
        "issues": rules.issues(metrics),
        "time_windows": phases.phases(events, runs),
    }


# What numbers the rows of a section; where nothing does, a run has one row.
SECTION_ORDER = {"per_rank": "rank", "barrier_spreads": "barrier_index", "time_windows": "phase", "topology": "rank", "time_anchors": "rank",
                 "statistics": "call_code", "chunks": "chunk_id"}


def _lines(member: str, df: DataFrame) -> DataFrame:
    """One line per element of a member, with its place in it."""
    name = member.split(".")[-1]
    key = SECTION_ORDER.get(name, "position")
    fields = [c for c in df.columns if c not in ("run_id", "position")]
    position = F.col(key).cast("long") if key in df.columns else F.lit(0).cast("long")
    return df.select("run_id", F.lit(member).alias("section"), position.alias("position"),
                     F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def analysis_document(sections: dict[str, DataFrame], runs: DataFrame, topology: DataFrame, anchors: DataFrame, statistics: DataFrame,
                      chunks: DataFrame) -> DataFrame:
    """The whole document, one line per element: ``run_id``, ``section``, ``position`` and ``json``, sorted by these.

    Sections are metadata, topology, time_anchors, statistics, hardware_blueprint, the parts of the analysis as ``analysis.*``, and chunks. No run is
    collected into one value. The blueprint is the text of the run's map, null without one; an empty section has no lines.
    """
    blueprint = F.col("hardware_blueprint") if "hardware_blueprint" in runs.columns else F.lit(None).cast("string")
    members = {"metadata": runs.drop("hardware_blueprint"), "topology": topology, "time_anchors": anchors, "statistics": statistics,
               "hardware_blueprint": runs.select("run_id", blueprint.alias("hardware_blueprint")),
               **{f"analysis.{name}": sections[name] for name in SECTIONS}, "chunks": chunks}
    lines = None
    for name, df in members.items():
        own = _lines(name, df)
        lines = own if lines is None else lines.unionByName(own)
    return lines.orderBy("run_id", "section", "position")


# --- printed summaries --------------------------------------------------------

def summary_table(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Histogram with totals, ordered by call code with unknown calls last."""
    wide = traffic.histogram_totals(traffic.message_histogram(events), runs)
    known = F.when(F.col("call_code").isin(list(S.CALLS)), F.col("call_code")).otherwise(9999)
    return wide.select("run_id", known.alias("call_order"), fx.short_call("call").alias("call"),
                       *traffic.BIN_COLUMNS, "total",
                       fx.fixed("per_rank_avg", 1).alias("per_rank_avg"))


def _per_rank(value: str) -> Column:
    average = f"coalesce(try_divide(cast({value} as double), total_ranks), 0D)"
    return F.concat(F.lit("(Avg per rank: "), fx.fixed(average, 1), F.lit(")"))


def analysis_summary_table(trace: Trace) -> DataFrame:
    """The printed summary as (line, label, value, note) rows."""
    m = report_metrics(trace)
    none = F.lit(None).cast("string")
    # The labels of the printed summary.
    counts = [("Total events", "total_events", True),
              ("Canonical transfers", "canonical_events", True),
              ("Canonical transfer bytes", "canonical_bytes", False),
              ("Completion events", "completion_events", True),
              ("Barrier events", "barrier_events", True)]
    rows = [F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"),
                     F.col(value).cast("string").alias("value"),
                     (_per_rank(value) if averaged else none).alias("note"))
            for i, (label, value, averaged) in enumerate(counts, start=1)]
    rows.append(F.struct(F.lit(6).alias("line"), F.lit("Estimated runtime").alias("label"),
                         F.concat(fx.fixed("runtime", 6), F.lit("s")).alias("value"),
                         none.alias("note")))
    lines = m.select("run_id", F.inline(F.array(*rows)))
    found = rules.patterns(m).select(
        "run_id", (F.col("position") + 100).alias("line"), F.col("type").alias("label"),
        F.col("description").alias("value"), none.alias("note"))
    bad = rules.issues(m).select(
        "run_id", (F.col("position") + 200).alias("line"), F.upper("severity").alias("label"),
        F.col("description").alias("value"), none.alias("note"))
    return lines.unionByName(found).unionByName(bad)
