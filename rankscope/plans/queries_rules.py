"""Queries for patterns, issues, highlights and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import frames, quality, topk
from rankscope.operators.sentences import said_sql
from rankscope.plans import analysis
from rankscope.plans.derived import derived_runs, table
from rankscope.plans.queries_scalar import trace_anchors
from rankscope.plans.registry import EVENTS_SQL, METRICS_SQL, PAIRS_SQL, query, r6, trace

SEVERITY = "case when {0} >= 0.85 then 'critical' when {0} >= 0.6 then 'warning' else 'info' end"

# name, rule, condition over m, score, values of its sentence
_RULES = [
    ("d01_dense_communication", "dense-communication", "pair_density >= 0.5", None,
     "pair_density"),
    ("d02_sparse_communication", "sparse-communication", "pair_density > 0 and pair_density <= 0.1", None,
     "pair_density"),
    ("d03_small_message_dominated", "small-message-dominated", "small1k_ratio >= 0.5 and canonical_events > 0", None,
     "small1k_ratio * 100"),
    ("d04_root_concentrated", "root-concentrated-collectives", "roots > 0 and top_root_share >= 0.5", None,
     "top_root_share * 100"),
    ("d05_dominant_link", "dominant-link", "top_link_share >= 0.2 and canonical_bytes > 0", None,
     "top_link_share * 100"),
    ("d06_rank_imbalance", "rank-communication-imbalance", "touch_cv >= 1", None,
     "touch_cv"),
    ("d07_completion_heavy", "completion-heavy", "completion_ratio >= 0.5", None,
     "completion_ratio"),
    ("d08_barrier_heavy", "barrier-heavy", "barrier_events > 0 and barrier_fraction >= 0.05", None,
     "barrier_events"),
    ("i01_late_sender", "late_sender", "ls_n / canonical_events > 0.05", "least(ls_n / canonical_events * 4.0, 1.0)",
     "ls_n, ls_t"),
    ("i02_late_receiver", "late_receiver", "lr_n / canonical_events > 0.05", "least(lr_n / canonical_events * 4.0, 1.0)",
     "lr_n, lr_t"),
    ("i03_late_broadcaster", "late_broadcaster", "lb_n / collective_events > 0.05", "least(lb_n / collective_events * 4.0, 1.0)",
     "lb_n, lb_t"),
    ("i04_early_reduce_arrival", "early_reduce_arrival", "er_n / collective_events > 0.05", "least(er_n / collective_events * 4.0, 1.0)",
     "er_n, er_t"),
    ("i05_small_message_pressure", "small_message_pressure", "small1k_ratio >= 0.6", "least(small1k_ratio, 1.0)",
     "small1k_ratio * 100"),
    ("i06_rank_traffic_imbalance", "rank_traffic_imbalance", "touch_cv >= 1.2", "least(touch_cv / 2.0, 1.0)",
     "touch_cv"),
    ("i07_collective_root_bottleneck", "collective_root_bottleneck", "top_root_share >= 0.7 and root_bytes > 0", "least(top_root_share, 1.0)",
     "top_root_share * 100"),
    ("i08_barrier_arrival_skew", "barrier_arrival_skew",
     "barrier_instances > 0 and runtime > 0 and max_barrier_spread >= 0.001 and max_barrier_spread / runtime >= 0.01",
     "least(max_barrier_spread / runtime * 5.0, 1.0)",
     "max_barrier_spread, avg_barrier_spread"),
    ("i09_completion_overhead", "completion_overhead", "completion_ratio >= 1 and completion_events > 0", "least(completion_ratio / 2.0, 1.0)",
     "completion_ratio"),
    ("i10_link_hotspot", "link_hotspot", "top_link_share >= 0.35 and canonical_bytes > 0", "least(top_link_share * 2.0, 1.0)",
     "top_link_share * 100"),
]


def _rule_sql(kind: str, applies: str, score: str | None, text: str) -> str:
    extra = f", round({score}, 6) as score, {SEVERITY.format(score)} as severity" if score else ""
    return f" select '{kind}' as type, {applies} as applies{extra}, {said_sql(kind, *text.split(', '))} as description from m"


def _rule_query(kind: str, scored: bool):
    def run(spark, sf):
        out = analysis.rule_outcome(trace(spark, sf, share=True), kind)
        cols = ["type", "applies", "description"] + (["severity"] if scored else [])
        return out.select(*cols, *([r6("score").alias("score")] if scored else []))
    return run


for _name, _kind, _applies, _score, _text in _RULES:
    query(_name, METRICS_SQL + _rule_sql(_kind, _applies, _score, _text))(_rule_query(_kind, _score is not None))

_PATTERNS = " union all ".join(
    f"select {i} as ord, '{kind}' as type, {said_sql(kind, *text.split(", "))} as description from m where {applies}"
    for i, (_, kind, applies, score, text) in enumerate(_RULES) if score is None)
_ISSUES = " union all ".join(
    f"select {i} as ord, '{kind}' as type, {score} as score, {said_sql(kind, *text.split(", "))} as description from m where {applies}"
    for i, (_, kind, applies, score, text) in enumerate(_RULES) if score is not None)


@query("f22_pattern_report", METRICS_SQL + f""", found as ({_PATTERNS})
select row_number() over (order by ord) as position, type, description from found""")
def f22(spark, sf):
    return analysis.patterns(trace(spark, sf, share=True)).select("position", "type", "description")


@query("o06_issues", METRICS_SQL + f""", found as ({_ISSUES})
select row_number() over (order by score desc, ord) as position, type, round(score, 6) as score,
  {SEVERITY.format('score')} as severity, description from found""")
def o06(spark, sf):
    return analysis.issues(trace(spark, sf, share=True)).select(
        "position", "type", r6("score").alias("score"), "severity", "description")


@query("k07_analysis_findings", METRICS_SQL + f""", pat as ({_PATTERNS}), iss as ({_ISSUES})
select unnest(range(1, 7)) as line,
  unnest(['Total events', 'Canonical transfers', 'Canonical transfer bytes', 'Completion events', 'Barrier events', 'Estimated runtime']) as label,
  unnest([total_events::varchar, canonical_events::varchar, canonical_bytes::varchar, completion_events::varchar, barrier_events::varchar,
          printf('%.6fs', runtime)]) as value,
  unnest([printf('(Avg per rank: %.1f)', total_events / 64.0::double), printf('(Avg per rank: %.1f)', canonical_events / 64.0::double), null,
          printf('(Avg per rank: %.1f)', completion_events / 64.0::double), printf('(Avg per rank: %.1f)', barrier_events / 64.0::double), null]) as note
from m
union all select 100 + row_number() over (order by ord), type, description, null from pat
union all select 200 + row_number() over (order by score desc, ord), upper({SEVERITY.format('score')}), description, null from iss""")
def k07_findings(spark, sf):
    """The whole printed summary: totals, pattern and issue lines. ``k07_analysis_summary`` has the SQL of the totals only."""
    return analysis.analysis_summary_table(trace(spark, sf, share=True)).select("line", "label", "value", "note")


# --- highlights ---------------------------------------------------------------

@query("h01_rank_highlights", METRICS_SQL + """,
cand as (
  select row_number() over (order by bytes desc, seen) as ord, root as rank, 'root' as kind, 120 as priority, 'collective_root' as reason
  from roots qualify ord <= 3
  union all
  select 100 + row_number() over (order by touch_bytes desc, rank) as ord, rank, 'top', 50, 'top_rank' from ranks_t qualify ord <= 105),
win as (select *, first_value(ord) over (partition by rank order by priority desc, ord) as w from cand)
select rank, max(kind) filter (ord = w) as kind, max(priority) filter (ord = w) as priority,
       string_agg(reason, ',' order by ord) filter (ord >= w) as reasons from win group by rank""")
def h01(spark, sf):
    t = trace(spark, sf, share=True)
    return frames.rank_highlights(t.roots, topk.top_ranks_by_touch(t.ranks)).select(
        "rank", "kind", "priority", F.array_join("reasons", ",").alias("reasons"))


@query("h02_link_highlights", METRICS_SQL + """,
top as (select row_number() over (order by bytes desc, seen) as ord, * from links qualify ord <= 6),
pair as (select sender, receiver, max(bytes) as bytes, min(ord) as ord from top where sender <> receiver group by all)
select sender, receiver, 'top' as kind, 100 as priority, 'top_link' as reason, bytes,
       row_number() over (order by bytes desc, ord) as position from pair qualify position <= 10""")
def h02(spark, sf):
    t = trace(spark, sf)
    return frames.link_highlights(topk.top_links(t.events, t.runs, link_table=t.links)).drop("run_id")


@query("h03_issue_focus", METRICS_SQL + f""", found as ({_ISSUES}),
one as (select type, case {SEVERITY.format('score')} when 'critical' then 400 when 'warning' then 300 else 200 end as priority
        from found order by score desc, ord limit 1),
top as (select sender, receiver from links order by bytes desc, seen limit 1)
select rank as sender, null as receiver, 0 as bytes, priority, type as reason from one, (select distinct unnest([sender, receiver]) as rank from top)
union all select sender, receiver, 0, priority, type from one, top""")
def h03(spark, sf):
    """Issues name no ranks or pairs of their own; the largest link's ends stand in for them."""
    t = trace(spark, sf, share=True)
    top = topk.top_links(t.events, t.runs, 1, t.links).select(
        "run_id", F.array("sender", "receiver").alias("ranks"),
        F.array(F.array("sender", "receiver")).alias("pairs"))
    return frames.issue_focus(analysis.issues(t).join(top, "run_id"), 1).drop("run_id")


# --- quality ------------------------------------------------------------------

PROCS_SQL = "with procs as (select s_suppkey % 70 as rank, count(*) as n from supplier group by 1)"


def supplier_ranks(spark, sf):
    return table(spark, sf, "supplier").select(
        F.lit("derived").alias("run_id"), (F.col("s_suppkey") % 70).cast("int").alias("rank"))


@query("q01_rank_coverage", PROCS_SQL + """
select coalesce(p.rank, r.range) as rank, case when r.range is null then 'out of range' when p.n is null then 'missing'
  else 'duplicate' end as problem
from procs p full join range(64) r on p.rank = r.range where r.range is null or p.n is null or p.n > 1""")
def q01(spark, sf):
    return quality.rank_coverage(supplier_ranks(spark, sf), derived_runs(spark)).drop("run_id")


@query("q02_bad_anchors", EVENTS_SQL + " select distinct rank_recording as rank from ev where rank_recording % 9 = 8")
def q02(spark, sf):
    t = trace(spark, sf)
    runs = t.runs.withColumn("file_format_version", F.lit(2))
    return quality.bad_anchors(trace_anchors(t.events), runs).select("rank")


@query("q03_broken_bookends", "select range as rank from range(64, 67)")
def q03(spark, sf):
    t = trace(spark, sf)
    return quality.broken_bookends(t.events, t.runs.withColumn("total_ranks", F.lit(67))).select("rank")


@query("q03_lost_first_calls", EVENTS_SQL + """
select rank_recording as rank from ev group by rank_recording having count(*) filter (call_code = 13) % 2 = 1""")
def q03_lost(spark, sf):
    """Ranks with an odd number of sends have lost their Init row."""
    t = trace(spark, sf)
    odd = t.events.groupBy("run_id", "rank_recording").agg((F.count_if(F.col("call_code") == 13) % 2 == 1).alias("odd"))
    kept = t.events.join(odd, ["run_id", "rank_recording"]).filter(~((F.col("call_code") == S.INIT) & F.col("odd")))
    return quality.broken_bookends(kept, t.runs).select("rank")


@query("q04_expect_rows", EVENTS_SQL + """
select label, n, found from (
  select 'sends in comm 1' as label, 0 as n, count(*) filter (call_code = 13 and comm = 1) as found from ev
  union all select 'init rows', 64, count(*) filter (call_code = 39) from ev
  union all select 'self barriers of rank 3', 1, count(*) filter (call_code = 26 and sender = 3 and receiver = 3) from ev)
where n <> found""")
def q04(spark, sf):
    return quality.expect_rows(trace(spark, sf).events, [
        {"label": "sends in comm 1", "n": 0, "call_code": 13, "comm": 1},
        {"label": "init rows", "n": 64, "call_code": S.INIT},
        {"label": "self barriers of rank 3", "n": 1, "call_code": S.BARRIER, "sender": 3, "receiver": 3},
    ]).drop("run_id")


@query("q05_tag_mismatch", EVENTS_SQL + """
select comm, sender, receiver, tag, count(*) filter (call_code in (13, 15, 16, 17, 18, 19, 20, 21))
  - count(*) filter (call_code in (14, 22)) as balance
from ev where call_code between 13 and 22 group by all having balance <> 0""")
def q05(spark, sf):
    ev = trace(spark, sf).events
    return quality.tag_mismatch(ev.filter(fx.is_send_like()), ev.filter(fx.is_recv_like()),
                                ["comm", "sender", "receiver"])


@query("q06_mixed_comm", EVENTS_SQL + """
select call, rank_recording, min(comm) as low, max(comm) as high from ev group by all having low <> high""")
def q06(spark, sf):
    return quality.mixed_comm(trace(spark, sf).events, ["call", "rank_recording"])


@query("q07_stray_control", EVENTS_SQL + """,
used as (select distinct rank_recording, tag, comm from ev where call_code between 13 and 22),
c as (select rank_recording, event_id, tag + (event_id % 50 = 0)::int * 90 as tag, comm from ev where completion)
select rank_recording, event_id, 'tag' as field, cast(tag as bigint) as value from c
where tag <> 0 and not exists (select 1 from used u where u.rank_recording = c.rank_recording and u.tag = c.tag)
union all
select rank_recording, event_id, 'comm', comm from c
where comm <> 0 and not exists (select 1 from used u where u.rank_recording = c.rank_recording and u.comm = c.comm)""")
def q07(spark, sf):
    ev = trace(spark, sf).events
    bent = ev.withColumn("tag", F.when(fx.is_completion() & (F.col("event_id") % 50 == 0), F.col("tag") + 90)
                         .otherwise(F.col("tag")))
    return quality.stray_control(bent).drop("run_id")


@query("q08_tagged_collectives", EVENTS_SQL + """
select call, count(*) as n from ev where (coll or barrier) and epoch_ns % 3 = 0 group by call""")
def q08(spark, sf):
    ev = trace(spark, sf).events
    tagged = ev.withColumn("tag", F.when(F.col("epoch_ns") % 3 == 0, 5).otherwise(F.lit(0)))
    return quality.tagged_collectives(tagged).groupBy("call").agg(F.count(F.lit(1)).alias("n"))


@query("q09_pair_disagreement", EVENTS_SQL + PAIRS_SQL + """
select comm, sender, receiver, tag, i as ordinal, cs as send_cnt, cr as recv_cnt from pairs where cs <> cr or bs <> br""")
def q09(spark, sf):
    return quality.pair_disagreement(trace(spark, sf).events).select(
        "comm", "sender", "receiver", "tag", "ordinal", "send_cnt", "recv_cnt")


@query("q10_unmirrored_sendrecv", EVENTS_SQL + """,
x as (select a.sender as a, a.receiver as b, a.tag + (a.event_id % 40 = 0)::int * 50 as o, b.tag as i
      from ev a join ev b on a.call_code = 23 and b.call_code = 23 and a.part = 1 and b.part = 2
       and a.rank_recording = b.rank_recording and a.event_id = b.event_id),
y as (select least(a, b) as low, greatest(a, b) as high, case when a < b then o else i end as tag_up,
        case when a < b then i else o end as tag_down, case when a < b then 1 else -1 end as s from x where a <> b)
select low, high, tag_up, tag_down, cast(sum(s) as bigint) as balance from y group by all having sum(s) <> 0""")
def q10(spark, sf):
    ev = trace(spark, sf).events
    bent = ev.withColumn("tag", F.when((F.col("part") == 1) & (F.col("call_code") == S.SENDRECV)
                                       & (F.col("event_id") % 40 == 0), F.col("tag") + 50)
                         .otherwise(F.col("tag")))
    return quality.unmirrored_sendrecv(bent).drop("run_id")


@query("q11_aggregate_mismatch", EVENTS_SQL + """,
rec as (select rank_recording, event_id, call_code,
  max(cnt) filter (if(call_code = 31, part = 2, part = 1)) as mc, max(cnt) filter (not if(call_code = 31, part = 2, part = 1)) as tc,
  max(bytes) filter (if(call_code = 31, part = 2, part = 1)) as mb, max(bytes) filter (not if(call_code = 31, part = 2, part = 1)) as tb,
  max(sender) filter (not if(call_code = 31, part = 2, part = 1)) as root
  from ev where call_code in (30, 31, 32) group by all)
select rank_recording, event_id, mc as member_cnt, tc as total_cnt from rec
where tc <> mc * case when call_code = 32 or root = rank_recording then 60 else 0 end
   or tb <> mb * case when call_code = 32 or root = rank_recording then 60 else 0 end""")
def q11(spark, sf):
    t = trace(spark, sf)
    return quality.aggregate_mismatch(t.events, t.runs.withColumn("total_ranks", F.lit(60))).select(
        "rank_recording", "event_id", "member_cnt", "total_cnt")


@query("q12_cancelled_leftovers", EVENTS_SQL + """,
c as (select rank_recording as rank, 22 as call_code, sender, receiver, tag, event_id + 1 as wait_id
      from ev where call_code = 18 and event_id % 10 < 5)
select rank, sender, receiver, tag, wait_id, 'transfer row present' as problem from c
where exists (select 1 from ev where ev.rank_recording = c.rank and ev.call_code = 22 and ev.sender = c.sender
              and ev.receiver = c.receiver and ev.tag = c.tag)
union all
select rank, sender, receiver, tag, wait_id, 'wait row missing' from c
where not exists (select 1 from ev where completion and ev.rank_recording = c.rank and ev.event_id = c.wait_id)""")
def q12(spark, sf):
    ev = trace(spark, sf).events
    cancelled = ev.filter("call_code = 18 and event_id % 10 < 5").select(
        "run_id", F.col("rank_recording").alias("rank"), F.lit(22).alias("call_code"), "sender",
        "receiver", "tag", (F.col("event_id") + 1).alias("wait_id"))
    return quality.cancelled_leftovers(ev, cancelled).select(
        F.col("rank_recording").alias("rank"), "sender", "receiver", "tag", "wait_id", "problem")


@query("w06_first_last", EVENTS_SQL + """
select rank_recording, arg_min(call_code, event_id) as first_code, arg_max(call_code, event_id) as last_code
from ev where part = 0 group by 1""")
def w06(spark, sf):
    return quality.first_last(trace(spark, sf).events).drop("run_id")
