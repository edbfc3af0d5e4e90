"""Communication patterns and performance issues as rules over one metrics row per run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankscope import functions as fx
from rankscope.operators.sentences import said

c = F.col


@dataclass(frozen=True)
class Rule:
    """When it applies, how strong it is, what it reports and which metric groups it reads."""

    kind: str
    groups: tuple[str, ...]
    applies: Column
    text: tuple
    metrics: dict[str, Column]
    score: Column | None = None
    tables: tuple[str, ...] = field(default=())

    def description(self) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in self.text])

    def metrics_json(self) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in self.metrics.items()]),
                         {"ignoreNullFields": "false"})


def pattern_rules() -> list[Rule]:
    many, density = c("total_ranks") >= 8, c("pair_density")
    shape = {"pair_density": density, "pairs_observed": c("pairs_observed")}
    moving, sized = c("canonical_events") > 0, c("canonical_bytes") > 0
    return [
        Rule("dense-communication", ("links",), many & (density >= 0.5),
             said("dense-communication", "pair_density"), shape),
        Rule("sparse-communication", ("links",), many & (density > 0.0) & (density <= 0.1),
             said("sparse-communication", "pair_density"), shape),
        Rule("small-message-dominated", ("totals",), (c("small1k_ratio") >= 0.5) & moving,
             said("small-message-dominated", "small1k_ratio"),
             {"small_lt_1kb_ratio": c("small1k_ratio"), "small_lt_1kb_events": c("small1k_events")}),
        Rule("root-concentrated-collectives", ("roots",),
             (c("roots") > 0) & (c("top_root_share") >= 0.5),
             said("root-concentrated-collectives", "top_root_share"),
             {"top_root": c("top_root"), "top_root_share": c("top_root_share")}),
        Rule("dominant-link", ("totals", "links"), (c("top_link_share") >= 0.2) & sized,
             said("dominant-link", "top_link_share"),
             {"top_link_share": c("top_link_share"), "top_link": c("top_link")},
             tables=("top_link",)),
        Rule("rank-communication-imbalance", ("touch",),
             (c("touch_cv") >= 1.0) & (c("total_ranks") > 1),
             said("rank-communication-imbalance", "touch_cv"),
             {"touch_bytes_cv": c("touch_cv")}),
        Rule("completion-heavy", ("totals",), c("completion_ratio") >= 0.5,
             said("completion-heavy", "completion_ratio"),
             {"completion_to_transfer_ratio": c("completion_ratio")}),
        Rule("barrier-heavy", ("totals",),
             (c("barrier_events") > 0) & (c("barrier_fraction") >= 0.05),
             said("barrier-heavy", "barrier_events"),
             {"barrier_events": c("barrier_events"), "barrier_fraction": c("barrier_fraction")}),
    ]


def issue_rules() -> list[Rule]:
    def capped(value: Column) -> Column:
        return F.least(value, F.lit(1.0))

    def late(kind, group, ratio, count, time, fraction, lost):
        """The four timing rules share threshold, score and layout."""
        denominator = "canonical_events" if group == "p2p" else "collective_events"
        return Rule(kind, ("totals", group), (c(denominator) > 0) & (c(ratio) > 0.05), said(kind, count, time),
                    {count: c(count), fraction: c(ratio), lost: c(time)},
                    capped(c(ratio) * 4.0))

    moving, sized = c("canonical_events") > 0, c("canonical_bytes") > 0
    return [
        late("late_sender", "p2p", "late_sender_ratio", "late_sender_count", "late_sender_time",
             "fraction_of_traffic", "wasted_time_sec"),
        late("late_receiver", "p2p", "late_receiver_ratio", "late_receiver_count", "late_receiver_time",
             "fraction_of_traffic", "delayed_time_sec"),
        late("late_broadcaster", "bcast", "late_broadcaster_ratio", "late_broadcaster_count", "late_broadcaster_time",
             "fraction_of_collectives", "wasted_time_sec"),
        late("early_reduce_arrival", "reduce", "early_reduce_ratio", "early_reduce_count", "early_reduce_time",
             "fraction_of_collectives", "wasted_time_sec"),
        Rule("small_message_pressure", ("totals",), (c("small1k_ratio") >= 0.6) & moving,
             said("small_message_pressure", "small1k_ratio"),
             {"small_lt_1kb_ratio": c("small1k_ratio"), "small_lt_1kb_events": c("small1k_events")},
             capped(c("small1k_ratio"))),
        Rule("rank_traffic_imbalance", ("touch",), (c("touch_cv") >= 1.2) & (c("total_ranks") > 1),
             said("rank_traffic_imbalance", "touch_cv"),
             {"touch_bytes_cv": c("touch_cv"), "top_ranks_by_touch": c("top_ranks_by_touch")},
             capped(c("touch_cv") / 2.0), ("top_ranks_by_touch",)),
        Rule("collective_root_bottleneck", ("roots",),
             (c("top_root_share") >= 0.7) & (c("root_bytes") > 0),
             said("collective_root_bottleneck", "top_root_share"),
             {"top_root": c("top_root"), "top_root_share": c("top_root_share")},
             capped(c("top_root_share"))),
        Rule("barrier_arrival_skew", ("totals", "barriers"),
             (c("barrier_instances") > 0) & (c("runtime") > 0.0)
             & (c("max_barrier_spread") >= 0.001) & (c("rel_barrier_spread") >= 0.01),
             said("barrier_arrival_skew", "max_barrier_spread", "avg_barrier_spread"),
             {"max_barrier_spread": c("max_barrier_spread"),
              "avg_barrier_spread": c("avg_barrier_spread"),
              "barrier_instances": c("barrier_instances")},
             capped(c("rel_barrier_spread") * 5.0)),
        Rule("completion_overhead", ("totals",),
             (c("completion_ratio") >= 1.0) & (c("completion_events") > 0),
             said("completion_overhead", "completion_ratio"),
             {"completion_events": c("completion_events"),
              "completion_to_transfer_ratio": c("completion_ratio")},
             capped(c("completion_ratio") / 2.0)),
        Rule("link_hotspot", ("totals", "links"), (c("top_link_share") >= 0.35) & sized,
             said("link_hotspot", "top_link_share"),
             {"top_link_share": c("top_link_share"), "top_link": c("top_link")},
             capped(c("top_link_share") * 2.0), ("top_link",)),
    ]


def rule(kind: str) -> Rule:
    return next(r for r in pattern_rules() + issue_rules() if r.kind == kind)


def evaluate(metrics: DataFrame, r: Rule) -> DataFrame:
    """Outcome of one rule for every run, whether it applies or not."""
    cols = [F.lit(r.kind).alias("type"), F.coalesce(r.applies, F.lit(False)).alias("applies")]
    if r.score is not None:
        cols += [r.score.alias("score"), fx.severity(r.score).alias("severity")]
    return metrics.select("run_id", *cols, r.description().alias("description"),
                          r.metrics_json().alias("metrics"))


def _fired(metrics: DataFrame, rules: list[Rule], scored: bool) -> DataFrame:
    def outcome(i: int, r: Rule) -> Column:
        score = [r.score.alias("score"), fx.severity(r.score).alias("severity")] if scored else []
        return F.when(r.applies, F.struct(
            F.lit(i).alias("ord"), F.lit(r.kind).alias("type"), *score,
            r.description().alias("description"), r.metrics_json().alias("metrics")))

    found = F.array_compact(F.array(*[outcome(i, r) for i, r in enumerate(rules)]))
    return metrics.select("run_id", F.inline(found))


def patterns(metrics: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Patterns of each run in rule order."""
    found = _fired(metrics, pattern_rules() if rules is None else rules, scored=False)
    w = Window.partitionBy("run_id").orderBy("ord")
    return found.withColumn("position", F.row_number().over(w)) \
                .select("run_id", "position", "type", "description", "metrics")


def issues(metrics: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Issues of each run by score; equal scores in rule order."""
    found = _fired(metrics, issue_rules() if rules is None else rules, scored=True)
    w = Window.partitionBy("run_id").orderBy(F.col("score").desc(), "ord")
    return found.withColumn("position", F.row_number().over(w)) \
                .select("run_id", "position", "type", "severity", "score", "description", "metrics")
