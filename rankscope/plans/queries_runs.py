"""Patterns and issues with their metrics over several runs, each bent so that other rules apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankscope.operators.sentences import said_sql
from rankscope.plans import analysis
from rankscope.plans.derived import RANKS, derive_trace
from rankscope.plans.metrics import Trace
from rankscope.plans.queries_rules import _RULES, SEVERITY
from rankscope.plans.registry import METRICS_SQL, query
from rankscope.session import written

# Run, rows it keeps, and columns it bends, as SQL that both engines read. Rows of one message or call have one group.
RUNS = {
    "even": ("true", {}),
    "small": ("call_code not in (39, 40)", {"bytes": "least(bytes, 100)", "cnt": "least(cnt, 100)"}),
    "one link": ("call_code between 13 and 22", {"sender": "0", "receiver": "1"}),
    "waiting": ("call_code in (24, 25, 26, 33, 34, 35, 36, 37, 38) or (call_code = 13 and event_id % 10 < 1)", {}),
    "one root": ("call_code in (27, 28)", {"sender": "case when call_code = 27 then 0 else sender end", "receiver": "case when call_code = 28 then 0 else receiver end"}),
}
NUMBERS = list(enumerate(RUNS.items()))

# Scalar metrics of each rule in the order of their names.
METRICS = {
    "dense-communication": ["pair_density", "pairs_observed"], "sparse-communication": ["pair_density", "pairs_observed"],
    "small-message-dominated": ["small1k_events", "small1k_ratio"], "root-concentrated-collectives": ["top_root", "top_root_share"],
    "dominant-link": ["top_link_share"], "rank-communication-imbalance": ["touch_cv"], "completion-heavy": ["completion_ratio"],
    "barrier-heavy": ["barrier_events", "barrier_fraction"],
    "late_sender": ["ls_n / canonical_events", "ls_n", "ls_t"], "late_receiver": ["lr_t", "lr_n / canonical_events", "lr_n"],
    "late_broadcaster": ["lb_n / collective_events", "lb_n", "lb_t"], "early_reduce_arrival": ["er_n", "er_n / collective_events", "er_t"],
    "small_message_pressure": ["small1k_events", "small1k_ratio"], "rank_traffic_imbalance": ["touch_cv"],
    "collective_root_bottleneck": ["top_root", "top_root_share"],
    "barrier_arrival_skew": ["avg_barrier_spread", "barrier_instances", "max_barrier_spread"],
    "completion_overhead": ["completion_events", "completion_ratio"], "link_hotspot": ["top_link_share"],
}


def runs_trace(spark: SparkSession, sf: str) -> Trace:
    """The derived trace dealt to five runs of the same ranks, all in one pass over a stored copy.

    Rules read the events several times; deriving and bending them in one step would also be too long a method for Java to compile.
    """
    def of_run(values: dict[int, str], otherwise: str) -> str:
        return f"case number {' '.join(f'when {i} then {value}' for i, value in values.items())} else {otherwise} end" if values else otherwise

    trace = written(derive_trace(spark, sf), "trace")
    dealt = trace.withColumn("number", F.expr("pmod(event_id div 64, 5)")).filter(of_run({i: f"({keeps})" for i, (_, (keeps, _)) in NUMBERS}, "false"))
    bent = {c: of_run({i: bends[c] for i, (_, (_, bends)) in NUMBERS if c in bends}, c) for c in trace.columns}
    bent["run_id"] = of_run({i: f"'{name}'" for i, (name, _) in NUMBERS}, "null")
    parts = dealt.select(*[F.expr(sql).cast(trace.schema[c].dataType).alias(c) for c, sql in bent.items()])
    runs = spark.range(len(RUNS)).select(F.element_at(F.array(*[F.lit(n) for n in RUNS]), (F.col("id") + 1).cast("int")).alias("run_id"), F.lit(RANKS).alias("total_ranks"))
    return Trace(parts, runs, share=True)


# A run may lack transfers, collectives or traffic: no share of nothing applies, and a variation of nothing is 0.
WHOLE = """,
whole as (select * replace (nullif(canonical_events, 0) as canonical_events, nullif(collective_events, 0) as collective_events,
""" + ", ".join(f"case when isnan({c}) then 0 else {c} end as {c}" for c in ("touch_cv", "completion_ratio", "small1k_ratio", "top_link_share", "top_root_share")) + ") from m)"


def _found_sql(scored: bool) -> str:
    """The rules that apply to each run, with scalar metrics."""
    parts = []
    for i, (name, (keeps, bent)) in NUMBERS:
        replaced = f" replace ({', '.join(f'{sql} as {c}' for c, sql in bent.items())})" if bent else ""
        source = f"from (select *{replaced} from raw where (event_id // 64) % 5 = {i} and ({keeps})) as raw)"
        head, tail = METRICS_SQL.split("  from raw)", 1)
        rows = " union all ".join(
            f"select {n} as ord, '{kind}' as type, {score or 'null'} as score, {said_sql(kind, *text.split(', '))} as description, "
            + ", ".join(f"round(cast({m} as double), 6) as m{k}" for k, m in enumerate((METRICS[kind] + ["null"] * 3)[:3], 1))
            + f" from whole where {applies}" for n, (_, kind, applies, score, text) in enumerate(_RULES) if (score is not None) == scored)
        parts.append(f"select '{name}' as run_id, * from ({head}  {source}{tail}{WHOLE} {rows})")
    return " union all ".join(parts)


def scalars(metrics: Column) -> list[Column]:
    """The numbers among a rule's metrics, in the order of their names."""
    entries = F.array_sort(F.map_entries(F.from_json(metrics, "map<string,string>")))
    numbers = F.transform(F.filter(entries, lambda e: e["value"].rlike(r"^-?[0-9.]+(E-?[0-9]+)?$")), lambda e: F.round(e["value"].cast("double"), 6))
    return [F.get(numbers, F.lit(k)).alias(f"m{k + 1}") for k in range(3)]


@query("f22_patterns_of_runs", f"""with found as ({_found_sql(False)})
select run_id, row_number() over (partition by run_id order by ord) as position, type, description, m1, m2, m3 from found""")
def patterns_of_runs(spark, sf) -> DataFrame:
    return analysis.patterns(runs_trace(spark, sf)).select("run_id", "position", "type", "description", *scalars(F.col("metrics")))


@query("o06_issues_of_runs", f"""with found as ({_found_sql(True)})
select run_id, row_number() over (partition by run_id order by score desc, ord) as position, type, round(score, 6) as score,
       {SEVERITY.format('score')} as severity, description, m1, m2, m3 from found""")
def issues_of_runs(spark, sf) -> DataFrame:
    return analysis.issues(runs_trace(spark, sf)).select(
        "run_id", "position", "type", F.round("score", 6).alias("score"), "severity", "description", *scalars(F.col("metrics")))
