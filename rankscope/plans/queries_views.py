"""Queries for chunks, time lookups, topology, frames and request completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankscope import schema as S
from rankscope.operators import frames, pairing, phases, timeline, topk, topology, traffic
from rankscope.plans.derived import RUN_ID, derive_trace, table
from rankscope.plans.registry import EVENTS_SQL, TO, query, r6
from rankscope.sources import store

CHUNK = 10_000
MOMENT = 1000.1

CHUNKS_SQL = EVENTS_SQL + f""",
num as (select *, row_number() over (order by {TO}) - 1 as ordinal from ev),
chunked as (select *, ordinal // {CHUNK} as chunk_id from num),
chunks as (select chunk_id, arg_min(time, ordinal) as t_start, arg_max(time, ordinal) as t_end, count(*) as n_events
           from chunked group by 1)"""


def chunked(spark, sf) -> DataFrame:
    """Chunk numbers need the timeline order and nothing else of an event."""
    return timeline.with_chunk_id(derive_trace(spark, sf).select("run_id", *S.ORDER_COLUMNS), CHUNK)


@query("w07_chunk_id", CHUNKS_SQL + " select event_id, part, rank_recording, ordinal, chunk_id from chunked")
def w07(spark, sf):
    return chunked(spark, sf).select("event_id", "part", "rank_recording", "ordinal", "chunk_id")


@query("k02_chunk_index", CHUNKS_SQL + """
select chunk_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, n_events from chunks""")
def k02(spark, sf):
    return timeline.chunk_index(chunked(spark, sf)).select(
        "chunk_id", r6("t_start").alias("t_start"), r6("t_end").alias("t_end"), "n_events")


@query("j08_chunks_for_time", CHUNKS_SQL + f""",
target as (select coalesce(min(chunk_id) filter (t_end >= {MOMENT}), max(chunk_id)) as c from chunks)
select chunk_id from chunks, target where chunk_id in (c, c - 1)""")
def j08(spark, sf):
    return phases.chunks_for_time(timeline.chunk_index(chunked(spark, sf)), MOMENT).select("chunk_id")


ACTIVE_SQL = EVENTS_SQL + f""",
shown as (select * from ev where time <= {MOMENT} and time >= {MOMENT} - 0.5
          and (time >= {MOMENT} - 0.05 or coll or barrier or call_code in (39, 40))),
active as (select * from shown qualify row_number() over (
             order by time desc, epoch_ns desc, event_id desc, rank_recording desc, part desc) <= 800)"""


def active(spark, sf) -> DataFrame:
    return phases.active_events(derive_trace(spark, sf), MOMENT, k=800)


@query("p02_active_events", ACTIVE_SQL + f"""
select row_number() over (order by time, {TO}) as position, event_id, part, rank_recording, call from active""")
def p02(spark, sf):
    return active(spark, sf).select("position", "event_id", "part", "rank_recording", "call")


@query("o08_newest_active", EVENTS_SQL + f"""
select event_id, part, rank_recording from ev
qualify row_number() over (order by time desc, epoch_ns desc, event_id desc, rank_recording desc, part desc) <= 800""")
def o08(spark, sf):
    return topk.newest_active(derive_trace(spark, sf)).select("event_id", "part", "rank_recording")


@query("p03_active_events_live", ACTIVE_SQL + " select event_id, part, rank_recording, call from shown")
def p03(spark, sf):
    return phases.active_events_live(derive_trace(spark, sf), MOMENT) \
        .select("event_id", "part", "rank_recording", "call")


@query("s14_events_between", EVENTS_SQL + """
select event_id, part, rank_recording from ev
where epoch_ns // 1000000 >= cast(trunc(1500.25 * 1000) as bigint) and epoch_ns // 1000000 < cast(trunc(1900.75 * 1000) as bigint)""")
def s14(spark, sf):
    ev = store.with_event_ts(derive_trace(spark, sf))
    return store.events_between(ev, 1500.25, 1900.75).select("event_id", "part", "rank_recording")


# --- topology -----------------------------------------------------------------

NODES_SQL = """
nodes as (select n_name as hostname, r_name as rack_id, 'CAB-' || (r_regionkey // 2) as cab_id,
                 cast((r_regionkey // 2) * 60 + (r_regionkey % 2) * 12 as double) as x, cast(n_nationkey * 15 as double) as y,
                 0.0::double as z, 1 + n_nationkey % 2 as cpus, 1 + n_nationkey % 3 as cores
          from nation join region on n_regionkey = r_regionkey),
procs as (select s_suppkey % 64 as rank, min(n_name) as hostname from supplier join nation on s_nationkey = n_nationkey group by 1)"""

SLOTS_SQL = NODES_SQL + """,
slots as (select rank, hostname, i // cores as chip_slot, i % cores as core_slot, cpus, cores, i
          from (select rank, p.hostname, cpus, cores, row_number() over (partition by p.hostname order by rank) - 1 as i
                from procs p join nodes n on p.hostname = n.hostname) where i < cpus * cores)"""


def map_nodes(spark, sf) -> DataFrame:
    """Nations as hosts, regions as racks, pairs of regions as cabinets."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).selectExpr(
        f"'{RUN_ID}' as run_id", "n_name as hostname", "concat('CAB-', r_regionkey div 2) as cab_id",
        "r_name as rack_id", "cast(null as string) as blade_id",
        "cast((r_regionkey div 2) * 60 + (r_regionkey % 2) * 12 as double) as x",
        "cast(n_nationkey * 15 as double) as y", "0D as z", "1 + n_nationkey % 2 as cpus",
        "1 + n_nationkey % 3 as cores_per_cpu")


def map_processes(spark, sf) -> DataFrame:
    """One process per rank, placed on a supplier's nation."""
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return (supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
            .groupBy((F.col("s_suppkey") % 64).cast("int").alias("rank"))
            .agg(F.min("n_name").alias("hostname"))
            .selectExpr(f"'{RUN_ID}' as run_id", "rank", "1000 + rank as pid", "0 as core", "0 as chip", "hostname"))


def slots(spark, sf) -> DataFrame:
    return topology.core_slots(map_processes(spark, sf), map_nodes(spark, sf))


@query("j01_build_topology", "with " + NODES_SQL + """
select rank, p.hostname, coalesce(n.x, rank * 15.0) as x, coalesce(n.y, 0) as y, coalesce(n.z, 0) as z, n.cab_id, n.rack_id
from procs p left join nodes n on p.hostname = n.hostname and n.rack_id <> 'ASIA'""")
def j01(spark, sf):
    nodes = map_nodes(spark, sf).filter("rack_id <> 'ASIA'")
    return topology.build_topology(map_processes(spark, sf), nodes).select(
        "rank", "hostname", "x", "y", "z", "cab_id", "rack_id")


@query("a24_node_occupancy", "with " + NODES_SQL + """,
used as (select hostname, count(*) as n from procs group by 1)
select hostname, coalesce(n, 0) as ranks, cpus * cores as capacity, greatest(cpus * cores - coalesce(n, 0), 0) as idle_cores,
       case when coalesce(n, 0) > 0 then 'active' else 'idle' end as state from nodes left join used using (hostname)""")
def a24(spark, sf):
    return topology.node_occupancy(map_processes(spark, sf), map_nodes(spark, sf)).drop("run_id")


@query("a25_run_size", "with " + NODES_SQL + " select count(distinct rank) as ranks, count(distinct hostname) as hosts from procs")
def a25(spark, sf):
    return topology.run_size(map_processes(spark, sf)).drop("run_id")


@query("w08_core_slots", "with " + SLOTS_SQL + " select rank, hostname, chip_slot, core_slot from slots")
def w08(spark, sf):
    return slots(spark, sf).select("rank", "hostname", "chip_slot", "core_slot")


@query("j07_place_events", EVENTS_SQL + "," + SLOTS_SQL + """
select a.hostname as sender_host, b.hostname as receiver_host, a.chip_slot as sender_chip, b.core_slot as receiver_core, count(*) as n
from ev join slots a on a.rank = ev.sender join slots b on b.rank = ev.receiver group by all""")
def j07(spark, sf):
    return topology.place_events(derive_trace(spark, sf), slots(spark, sf)) \
        .groupBy("sender_host", "receiver_host", "sender_chip", "receiver_core").agg(F.count(F.lit(1)).alias("n"))


@query("a21_frame_connections", ACTIVE_SQL + "," + SLOTS_SQL + f""",
placed as (select active.*, a.hostname as sh, b.hostname as rh, coll or barrier as c,
             row_number() over (order by time, {TO}) as pos
           from active join slots a on a.rank = sender join slots b on b.rank = receiver where sender <> receiver),
g as (select call, case when c then sh else sender::varchar end as k1, case when c then rh else receiver::varchar end as k2,
        arg_min(sender, pos) as sender, arg_min(receiver, pos) as receiver, arg_min(sh = rh, pos) as intra_node, count(*) as n
      from placed group by all)
select call, sender, receiver, intra_node, n, round(1 + log10(n), 6) as weight from g""")
def a21(spark, sf):
    return frames.frame_connections(active(spark, sf), slots(spark, sf)).select(
        "call", "sender", "receiver", "intra_node", "n", r6("weight").alias("weight"))


@query("a22_frame_histogram", ACTIVE_SQL + """
select call, """ + ", ".join(f"count(*) filter (a.bin = {i}) as b{i}" for i in range(6)) + """
from (select distinct call from ev) left join active a using (call) group by call""")
def a22(spark, sf):
    overall = traffic.message_histogram(derive_trace(spark, sf))
    return frames.frame_histogram(active(spark, sf), overall).drop("run_id")


@query("a23_latest_activity", ACTIVE_SQL + "," + SLOTS_SQL + f""",
pos as (select *, row_number() over (order by time, {TO}) as pos from active where not completion),
t as (select sender as rank, call, call_code, pos, time from pos union all select receiver, call, call_code, pos, time from pos)
select rank, arg_max(call, pos) as call, round(max(time), 6) as time from t where rank in (select rank from slots) group by rank""")
def a23(spark, sf):
    return frames.latest_activity(active(spark, sf), slots(spark, sf)) \
        .select("rank", "call", r6("time").alias("time"))


# --- communicators and requests -----------------------------------------------

def comm_members(events: DataFrame) -> DataFrame:
    """Members of communicator 1: the world ranks below 60, rotated by a factor coprime to 60."""
    return events.select("run_id", F.col("sender").alias("comm_rank")).distinct() \
        .filter("comm_rank < 60") \
        .selectExpr("run_id", "1 as comm", "comm_rank", "(comm_rank * 7 + 3) % 60 as world_rank")


def two_groups(spark: SparkSession) -> DataFrame:
    """Members of communicator 2, which joins the ranks below 32 with the others; each group counts from 0."""
    return spark.range(64).selectExpr(
        f"'{RUN_ID}' as run_id", "2 as comm", "cast(id % 32 as int) as comm_rank", "cast(if(id < 32, (id * 5 + 1) % 32, 32 + (id * 3 + 2) % 32) as int) as world_rank",
        "cast(id div 32 as int) as side")


@query("j10_translate_ranks", EVENTS_SQL + """,
cm as (select *, case when tag = 7 then 2 else comm end as c, call_code in (14, 22) as is_recv, rank_recording // 32 as own from ev),
tr as (select c as comm, case when c = 1 and sender < 60 then (sender * 7 + 3) % 60 when c = 2 and sender < 32
                then case when (own = 1) <> is_recv then 32 + (sender * 3 + 2) % 32 else (sender * 5 + 1) % 32 end else sender end as s,
              case when c = 1 and receiver < 60 then (receiver * 7 + 3) % 60 when c = 2 and receiver < 32
                then case when (own = 1) = is_recv then 32 + (receiver * 3 + 2) % 32 else (receiver * 5 + 1) % 32 end else receiver end as r from cm)
select comm, s as sender, r as receiver, count(*) as n from tr group by all""")
def j10(spark, sf):
    """Communicator 1 is one rotated group; transfers of tag 7 go through an intercommunicator."""
    ev = derive_trace(spark, sf).select("run_id", F.when(F.col("tag") == 7, 2).otherwise(F.col("comm")).alias("comm"), "sender", "receiver",
                                        "rank_recording", "call_code")
    members = comm_members(ev).withColumn("side", F.lit(None).cast("int")).unionByName(two_groups(spark))
    return pairing.translate_ranks(ev, members).groupBy("comm", "sender", "receiver").agg(F.count(F.lit(1)).alias("n"))


def posted_requests(events: DataFrame) -> DataFrame:
    """The trace's nonblocking transfers as posted requests; handles are reused."""
    return events.filter("call_code between 18 and 22").selectExpr(
        "run_id", "rank_recording as rank", "pmod(event_id, 997) as handle", "time + (event_id % 1000) * 1e-12D as t",
        "call_code", "comm", "tag", "sender", "receiver", "bytes as cnt", "4 as type_size",
        "call_code = 22 as is_recv", "call_code = 22 and event_id % 3 = 0 as wildcard", "event_id")


def request_completions(posted: DataFrame) -> DataFrame:
    return posted.filter("event_id % 7 <> 3 or event_id % 5 <> 1").selectExpr(
        "run_id", "rank", "handle", "t + 1e-6D as t", "pmod(sender + 1, 64) as status_source",
        "if(event_id % 4 = 0, -1L, cnt + 1) as status_count", "event_id % 11 = 0 as cancelled")


@query("j11_complete_requests", EVENTS_SQL + """,
po as (select rank_recording as rank, event_id % 997 as handle, time + (event_id % 1000) * 1e-12::double as t, call_code, comm, tag,
         sender, receiver, bytes as cnt, call_code = 22 as is_recv, call_code = 22 and event_id % 3 = 0 as wild, event_id
       from ev where call_code between 18 and 22),
uses as (select rank, handle, t, false as done, call_code, tag, sender, receiver, cnt, is_recv, wild, null::bigint as src, null::bigint as c, false as cancelled from po
         union all
         select rank, handle, t + 1e-6::double, true, null, null, null, null, null, null, null, (sender + 1) % 64,
                case when event_id % 4 = 0 then -1 else cnt + 1 end, event_id % 11 = 0 from po where event_id % 7 <> 3 or event_id % 5 <> 1),
turns as (select rank, handle, done, src, c, cancelled, lag({'done': done, 'call_code': call_code, 'tag': tag, 'sender': sender, 'receiver': receiver, 'cnt': cnt,
                 'is_recv': is_recv, 'wild': wild}) over (partition by rank, handle order by t, done) as p from uses)
select rank as rank_recording, handle, p.call_code as call_code, p.tag as tag, case when p.is_recv and p.wild then src else p.sender end as sender, p.receiver as receiver,
  case when p.is_recv and c >= 0 then c else p.cnt end as cnt,
  least(4 * case when p.is_recv and c >= 0 then c else p.cnt end, 2147483647) as bytes
from turns where done and not p.done and not cancelled""")
def j11(spark, sf):
    posted = posted_requests(derive_trace(spark, sf))
    return pairing.complete_requests(posted, request_completions(posted)).select(
        "rank_recording", "handle", "call_code", "tag", "sender", "receiver", "cnt", "bytes")


@query("a26_unanimous_control", EVENTS_SQL + """
select rank_recording as rank, epoch_ns // 5000000 as wait_id, count(*) as requests,
  case when count(distinct (comm, tag)) = 1 then max(comm) else 0 end as comm,
  case when count(distinct (comm, tag)) = 1 then max(tag) else 0 end as tag
from ev where call_code between 18 and 22 group by all""")
def a26(spark, sf):
    requests = derive_trace(spark, sf).filter("call_code between 18 and 22").selectExpr(
        "run_id", "rank_recording as rank", "epoch_ns div 5000000 as wait_id", "comm", "tag")
    return pairing.unanimous_control(requests).drop("run_id")
