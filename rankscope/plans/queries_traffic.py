"""Queries for histograms, ranks, links, roots, totals and ordered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankscope.operators import frames, pairing, phases, topk, traffic
from rankscope.plans.registry import (
    EVENTS_SQL, LINKS_SQL, METRICS_SQL, PAIRS_SQL, RANKS_SQL, calls_text, query, r6, trace)

BINS_SQL = ", ".join(f"count(*) filter (bin = {i} and not synthetic_empty) as b{i}" for i in range(6))
HIST_SQL = EVENTS_SQL + f""",
hist as (select call, {BINS_SQL} from ev group by call),
cells as (select call, unnest(['< 128B', '128B - 1KB', '1KB - 64KB', '64KB - 1MB', '1MB - 16MB', '> 16MB']) as bin,
                 unnest([b0, b1, b2, b3, b4, b5]) as n from hist)"""


@query("a01_message_histogram", HIST_SQL + " select call, bin, n from cells")
def a01(spark, sf):
    return traffic.histogram_long(traffic.message_histogram(trace(spark, sf).events)).drop("run_id")


@query("a02_histogram_totals", HIST_SQL + """
select call, b0 + b1 + b2 + b3 + b4 + b5 as total, (b0 + b1 + b2 + b3 + b4 + b5) / 64.0::double as per_rank_avg from hist""")
def a02(spark, sf):
    t = trace(spark, sf)
    return traffic.histogram_totals(traffic.message_histogram(t.events), t.runs) \
        .select("call", "total", "per_rank_avg")


@query("a03_trace_totals", METRICS_SQL + """
select total_events, canonical_events, canonical_bytes, completion_events, barrier_events, collective_events,
       global_collective_events from m""")
def a03(spark, sf):
    return trace(spark, sf).totals.select(
        "total_events", "canonical_events", "canonical_bytes", "completion_events", "barrier_events",
        "collective_events", "global_collective_events")


ACTS = ("events, completion_events, barrier_events, collective_events, global_collective_events, "
        "rooted_collective_events, completion_request_count")


@query("a04_rank_activity", RANKS_SQL + f" select rank, {ACTS} from acts")
def a04(spark, sf):
    t = trace(spark, sf)
    return traffic.rank_activity(t.events, t.runs).drop("run_id")


@query("a05_rank_traffic_out", RANKS_SQL + " select rank, canonical_bytes_out, canonical_messages_out from ranks_t")
def a05(spark, sf):
    t = trace(spark, sf)
    return traffic.rank_traffic_out(traffic.rank_pairs(t.events), t.runs).drop("run_id")


@query("a06_rank_traffic_in", RANKS_SQL + " select rank, canonical_bytes_in, canonical_messages_in from ranks_t")
def a06(spark, sf):
    t = trace(spark, sf)
    return traffic.rank_traffic_in(traffic.rank_pairs(t.events), t.runs).drop("run_id")


@query("a07_distinct_peers", RANKS_SQL + " select rank, distinct_out_peers, distinct_in_peers from ranks_t")
def a07(spark, sf):
    t = trace(spark, sf)
    return traffic.distinct_peers(traffic.rank_pairs(t.events), t.runs).drop("run_id")


@query("a08_per_rank", RANKS_SQL + """
select ranks_t.*, events, completion_events, barrier_events, collective_events, global_collective_events,
       rooted_collective_events, completion_request_count from ranks_t join acts using (rank)""")
def a08(spark, sf):
    t = trace(spark, sf)
    return traffic.per_rank(t.events, t.runs).drop("run_id")


@query("a09_links", LINKS_SQL + """
select comm, sender, receiver, messages, bytes, calls, round(first_time, 6) as first_time,
       round(last_time, 6) as last_time from links""")
def a09(spark, sf):
    return trace(spark, sf).links.select(
        "comm", "sender", "receiver", "messages", "bytes", calls_text().alias("calls"),
        r6("first_time").alias("first_time"), r6("last_time").alias("last_time"))


@query("a10_collective_roots", LINKS_SQL + " select root, events, bytes, calls from roots")
def a10(spark, sf):
    return traffic.collective_roots(trace(spark, sf).events) \
        .select("root", "events", "bytes", calls_text().alias("calls"))


@query("a11_small_message_ratio", METRICS_SQL + """
select small128_events, small1k_events, round(small1k_ratio, 6) as small1k_ratio from m""")
def a11(spark, sf):
    return traffic.small_message_ratio(trace(spark, sf).totals).select(
        "small128_events", "small1k_events", r6("small1k_ratio").alias("small1k_ratio"))


@query("a11_small_messages_by_call", EVENTS_SQL + """
select call, count(*) as events, count(*) filter (bytes < 128) as lt_128, count(*) filter (bytes < 1024) as lt_1024
from ev where canon group by call""")
def a11_calls(spark, sf):
    return traffic.small_messages_by_call(trace(spark, sf).events) \
        .select("call", "events", "lt_128", "lt_1024")


@query("a12_pair_density", METRICS_SQL + " select pairs_observed, round(pair_density, 6) as pair_density from m")
def a12(spark, sf):
    t = trace(spark, sf)
    return traffic.pair_density(t.links, t.runs).select("pairs_observed", r6("pair_density").alias("pair_density"))


@query("a13_average_peers", METRICS_SQL + """
select round(avg_out_peers, 6) as avg_out_peers, round(avg_in_peers, 6) as avg_in_peers from m""")
def a13(spark, sf):
    return trace(spark, sf).group("touch").select(
        r6("avg_out_peers").alias("avg_out_peers"), r6("avg_in_peers").alias("avg_in_peers"))


@query("a14_touch_variation", METRICS_SQL + " select round(touch_cv, 6) as touch_cv from m")
def a14(spark, sf):
    t = trace(spark, sf)
    return traffic.rank_balance(traffic.rank_pairs(t.events), t.runs).select(r6("touch_cv").alias("touch_cv"))


@query("a15_top_link_share", METRICS_SQL + """
select (select max(bytes) from links) as top_link_bytes, canonical_bytes, round(top_link_share, 6) as top_link_share from m""")
def a15(spark, sf):
    return traffic.top_link_share(trace(spark, sf).links).select(
        "top_link_bytes", "canonical_bytes", r6("top_link_share").alias("top_link_share"))


@query("a16_top_root_share", METRICS_SQL + """
select (select max(bytes) from roots) as top_root_bytes, root_bytes, round(top_root_share, 6) as top_root_share from m""")
def a16(spark, sf):
    return traffic.top_root_share(traffic.collective_roots(trace(spark, sf).events)).select(
        "top_root_bytes", "root_bytes", r6("top_root_share").alias("top_root_share"))


@query("a17_completion_ratio", METRICS_SQL + " select completion_events, round(completion_ratio, 6) as completion_ratio from m")
def a17(spark, sf):
    return traffic.completion_ratio(trace(spark, sf).totals).select(
        "completion_events", r6("completion_ratio").alias("completion_ratio"))


@query("a18_barrier_fraction", METRICS_SQL + " select barrier_events, round(barrier_fraction, 6) as barrier_fraction from m")
def a18(spark, sf):
    return traffic.barrier_fraction(trace(spark, sf).totals).select(
        "barrier_events", r6("barrier_fraction").alias("barrier_fraction"))


@query("a19_runtime", METRICS_SQL + """
select round(arg_min(time, (epoch_ns, time, event_id, rank_recording, part)), 6) as start_time,
       round(arg_max(time, (epoch_ns, time, event_id, rank_recording, part)), 6) as end_time,
       round((select runtime from m), 6) as runtime from ev""")
def a19(spark, sf):
    return traffic.runtime(trace(spark, sf).events).select(
        *[r6(c).alias(c) for c in ("start_time", "end_time", "runtime")])


@query("a20_barrier_spreads", EVENTS_SQL + PAIRS_SQL + """
select barrier_index, round(t_min, 6) as t_min, round(t_max, 6) as t_max, round(spread, 6) as spread from spreads""")
def a20(spark, sf):
    return trace(spark, sf).spreads.select(
        "barrier_index", r6("t_min").alias("t_min"), r6("t_max").alias("t_max"), r6("spread").alias("spread"))


@query("f17_heat", HIST_SQL + """
select call, bin, n, case when n = 0 then 0.0 else greatest(0.15, round(n / (select max(n) from cells), 6)) end as heat from cells""")
def f17(spark, sf):
    wide = traffic.message_histogram(trace(spark, sf).events)
    return frames.cell_heat(wide, wide).select("call", "bin", "n", r6("heat").alias("heat"))


# --- ordered reports ----------------------------------------------------------

@query("o01_top_links", LINKS_SQL + """
select row_number() over (order by bytes desc, seen) as position, comm, sender, receiver, messages, bytes, calls,
       round(first_time, 6) as first_time, round(last_time, 6) as last_time from links qualify position <= 20""")
def o01(spark, sf):
    t = trace(spark, sf)
    return topk.top_links(t.events, t.runs).select(
        "position", "comm", "sender", "receiver", "messages", "bytes", calls_text().alias("calls"),
        r6("first_time").alias("first_time"), r6("last_time").alias("last_time"))


def _ranks_sql(value: str, messages: str | None) -> str:
    extra = f", {messages} as messages" if messages else ""
    return RANKS_SQL + f"""
select row_number() over (order by {value} desc, rank) as position, rank, {value} as bytes{extra}
from ranks_t qualify position <= 10"""


@query("o02_top_ranks_by_out", _ranks_sql("canonical_bytes_out", "canonical_messages_out"))
def o02(spark, sf):
    return topk.top_ranks_by_out(trace(spark, sf).ranks).drop("run_id")


@query("o03_top_ranks_by_in", _ranks_sql("canonical_bytes_in", "canonical_messages_in"))
def o03(spark, sf):
    return topk.top_ranks_by_in(trace(spark, sf).ranks).drop("run_id")


@query("o04_top_ranks_by_touch", _ranks_sql("touch_bytes", None))
def o04(spark, sf):
    return topk.top_ranks_by_touch(trace(spark, sf).ranks).drop("run_id")


@query("o05_collective_roots", LINKS_SQL + """
select row_number() over (order by bytes desc, seen) as position, root, events, bytes, calls from roots""")
def o05(spark, sf):
    return trace(spark, sf).roots.select("position", "root", "events", "bytes", calls_text().alias("calls"))


@query("o07_worst_barriers", EVENTS_SQL + PAIRS_SQL + """
select row_number() over (order by spread desc, barrier_index) as position, barrier_index, round(spread, 6) as spread
from spreads qualify position <= 8""")
def o07(spark, sf):
    return topk.worst_barriers(trace(spark, sf).spreads).select(
        "position", "barrier_index", r6("spread").alias("spread"))


@query("o09_report_cuts", RANKS_SQL + """
select 'link' as report, row_number() over (order by bytes desc, seen) as position, bytes from links qualify position <= 10
union all select 'rank', row_number() over (order by touch_bytes desc, rank) as position, touch_bytes from ranks_t qualify position <= 10
union all select 'root', row_number() over (order by bytes desc, seen) as position, bytes from roots qualify position <= 8""")
def o09(spark, sf):
    t = trace(spark, sf, share=True)
    cuts = {"link": topk.top_links(t.events, t.runs, topk.REPORT_LINKS, t.links),
            "rank": topk.top_ranks_by_touch(t.ranks, topk.REPORT_RANKS),
            "root": t.roots.filter(F.col("position") <= topk.REPORT_ROOTS)}
    parts = [df.select(F.lit(name).alias("report"), "position", "bytes") for name, df in cuts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("o10_top_items", EVENTS_SQL + """,
c as (select call, count(*) as n from ev group by call)
select row_number() over (order by n desc, call) as position, call, n from c qualify position <= 5""")
def o10(spark, sf):
    n = trace(spark, sf).events.groupBy("run_id", "call").agg(F.count(F.lit(1)).alias("n"))
    return topk.top_items(n, "n", 5, ties=["call"]).select("position", "call", "n")


@query("j06_rank_spine", EVENTS_SQL + """
select s.range as rank, count(ev.event_id) as events from range(70) s left join ev on ev.rank_recording = s.range group by 1""")
def j06(spark, sf):
    t = trace(spark, sf)
    wider = t.runs.withColumn("total_ranks", F.lit(70))
    return traffic.rank_activity(t.events, wider).select("rank", "events")


# --- pairing ------------------------------------------------------------------

@query("j02_pair_p2p", EVENTS_SQL + PAIRS_SQL + """
select comm, sender, receiver, tag, i as ordinal, es as send_epoch_ns, er as recv_epoch_ns from pairs""")
def j02(spark, sf):
    return pairing.pair_p2p(trace(spark, sf).events).drop("run_id", "send_time", "recv_time")


def _collective_sql(source: str) -> str:
    return EVENTS_SQL + PAIRS_SQL + f"""
select comm, root, i as ordinal, local, cast(diff_ns as bigint) as diff_ns from {source}"""


def _collective_pairs(df):
    ns = F.round(F.col("diff") * 1e9).cast("long")
    return df.select("comm", "root", "ordinal", "local", ns.alias("diff_ns"))


@query("j03_pair_bcast", _collective_sql("bcast"))
def j03(spark, sf):
    return _collective_pairs(pairing.pair_bcast(trace(spark, sf).events))


@query("j04_pair_reduce", _collective_sql("reduces"))
def j04(spark, sf):
    return _collective_pairs(pairing.pair_reduce(trace(spark, sf).events))


@query("w01_p2p_ordinals", EVENTS_SQL + PAIRS_SQL + """
select comm, sender, receiver, tag, side, event_id, part, i as ordinal from numbered""")
def w01(spark, sf):
    return pairing.p2p_ordinals(trace(spark, sf).events).select(
        "comm", "sender", "receiver", "tag", "side", "event_id", "part", "ordinal")


def _ordinal_sql(source: str) -> str:
    return EVENTS_SQL + PAIRS_SQL + f" select comm, root, local, epoch_ns, i as ordinal from {source}"


@query("w02_bcast_ordinals", _ordinal_sql("bc"))
def w02(spark, sf):
    return pairing.bcast_ordinals(trace(spark, sf).events).select("comm", "root", "local", "epoch_ns", "ordinal")


@query("w03_reduce_ordinals", _ordinal_sql("rd"))
def w03(spark, sf):
    return pairing.reduce_ordinals(trace(spark, sf).events).select("comm", "root", "local", "epoch_ns", "ordinal")


@query("w04_barrier_ordinals", EVENTS_SQL + PAIRS_SQL + " select rank as rank_recording, epoch_ns, k as ordinal from br")
def w04(spark, sf):
    return pairing.barrier_ordinals(trace(spark, sf).events).select("rank_recording", "epoch_ns", "ordinal")


@query("g01_late_senders", METRICS_SQL + " select ls_n as late_sender_count, round(ls_t, 6) as late_sender_time from m")
def g01(spark, sf):
    return pairing.late_senders(pairing.pair_p2p(trace(spark, sf).events)).select(
        "late_sender_count", r6("late_sender_time").alias("late_sender_time"))


@query("g02_late_receivers", METRICS_SQL + " select lr_n as late_receiver_count, round(lr_t, 6) as late_receiver_time from m")
def g02(spark, sf):
    return pairing.late_receivers(pairing.pair_p2p(trace(spark, sf).events)).select(
        "late_receiver_count", r6("late_receiver_time").alias("late_receiver_time"))


@query("g03_late_broadcasters", METRICS_SQL + """
select lb_n as late_broadcaster_count, round(lb_t, 6) as late_broadcaster_time from m""")
def g03(spark, sf):
    return trace(spark, sf).group("bcast").select(
        "late_broadcaster_count", r6("late_broadcaster_time").alias("late_broadcaster_time"))


@query("g04_early_reducers", METRICS_SQL + " select er_n as early_reduce_count, round(er_t, 6) as early_reduce_time from m")
def g04(spark, sf):
    return trace(spark, sf).group("reduce").select(
        "early_reduce_count", r6("early_reduce_time").alias("early_reduce_time"))


@query("g05_unmatched_p2p", EVENTS_SQL + PAIRS_SQL + """
select comm, sender, receiver, tag, count(*) filter (side = 0) as sends, count(*) filter (side = 1) as receives,
  greatest(count(*) filter (side = 0) - count(*) filter (side = 1), 0) as surplus_sends,
  greatest(count(*) filter (side = 1) - count(*) filter (side = 0), 0) as surplus_receives
from numbered group by all having sends <> receives""")
def g05(spark, sf):
    return pairing.unmatched_p2p(trace(spark, sf).events).drop("run_id")


# --- phases -------------------------------------------------------------------

PHASES_SQL = METRICS_SQL + """,
bounds as (select arg_min(time, (epoch_ns, time, event_id, rank_recording, part)) as s,
                  arg_max(time, (epoch_ns, time, event_id, rank_recording, part)) as e, count(*) as rows from ev),
b as (select s, e - s as span, case when e - s <= 0 then 1 else least(40, greatest(10, rows // 50000 + 10)) end as w from bounds),
idx as (select ev.*, case when span <= 0 then 0
               else least(w - 1, greatest(0, cast(trunc((time - s) / span * w) as bigint))) end as phase from ev, b),
grid as (select range as phase, s + span * range / w as t_start, s + span * (range + 1) / w as t_end
         from b, range(40) where range < w),
phases as (
  select grid.phase, t_start, t_end, count(idx.event_id) as events, count(*) filter (canon) as canonical_events,
         cast(coalesce(sum(bytes) filter (canon), 0) as bigint) as canonical_bytes,
         count(*) filter (completion) as completion_events, count(*) filter (barrier) as barrier_events,
         count(*) filter (coll) as collective_events
  from grid left join idx using (phase) group by all)"""


@query("p01_phases", PHASES_SQL + """
select phase, round(t_start, 6) as t_start, round(t_end, 6) as t_end, events, canonical_events, canonical_bytes,
       completion_events, barrier_events, collective_events from phases""")
def p01(spark, sf):
    t = trace(spark, sf)
    return phases.phases(t.events, t.runs).select(
        "phase", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"), *phases.PHASE_COUNTS)


@query("p04_phase_shares", PHASES_SQL + """
select phase, canonical_bytes, round(canonical_bytes / greatest((select max(canonical_bytes) from phases), 1), 6) as share from phases""")
def p04(spark, sf):
    t = trace(spark, sf)
    return phases.phase_shares(phases.phases(t.events, t.runs)).select(
        "phase", "canonical_bytes", r6("share").alias("share"))


@query("w09_maximum_share", HIST_SQL + """
select call, bin, round(n / cast((select max(n) from cells) as double), 6) as share from cells""")
def w09(spark, sf):
    cells = traffic.histogram_long(traffic.message_histogram(trace(spark, sf).events))
    return phases.maximum_share(cells, "n").select("call", "bin", r6("share").alias("share"))


@query("j09_phase_at", PHASES_SQL + """,
boundary as (select t_end as t from phases where phase = 4)
select phase, round(t_start, 6) as t_start from phases, boundary where t between t_start and t_end""")
def j09(spark, sf):
    t = trace(spark, sf)
    table = phases.phases(t.events, t.runs)
    boundary = table.filter("phase = 4").select("run_id", F.col("t_end").alias("t"))
    return phases.phases_at(table, boundary).select("phase", r6("t_start").alias("t_start"))
