"""Queries for the column functions and for building the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import timeline
from rankscope.plans.derived import derive_trace, table
from rankscope.plans.registry import EVENTS_SQL, query, r6

BIN_SQL = ("case bin when 0 then '< 128B' when 1 then '128B - 1KB' when 2 then '1KB - 64KB' "
           "when 3 then '64KB - 1MB' when 4 then '1MB - 16MB' when 5 then '> 16MB' end")


@query("f01_size_bin", EVENTS_SQL + f" select bytes, {BIN_SQL} as bin, count(*) as n from ev group by all")
def f01(spark, sf):
    return derive_trace(spark, sf).groupBy("bytes").agg(F.count(F.lit(1)).alias("n")) \
        .select("bytes", fx.size_bin("bytes").alias("bin"), "n")


@query("f02_severity", EVENTS_SQL + """
select (bytes % 101) / 100.0::double as score, case when (bytes % 101) / 100.0::double >= 0.85 then 'critical'
  when (bytes % 101) / 100.0::double >= 0.6 then 'warning' else 'info' end as severity, count(*) as n from ev group by all""")
def f02(spark, sf):
    return derive_trace(spark, sf).withColumn("score", F.col("bytes") % 101 / 100.0) \
        .groupBy("score").agg(F.count(F.lit(1)).alias("n")) \
        .select("score", fx.severity("score").alias("severity"), "n")


@query("f03_safe_div", EVENTS_SQL + """
select call, round(case when sum(cnt) = 0 then 0.0 else cast(sum(bytes) as double) / cast(sum(cnt) as double) end, 6) as ratio
from ev group by call""")
def f03(spark, sf):
    return derive_trace(spark, sf).groupBy("call").agg(
        r6(fx.safe_div(F.sum("bytes"), F.sum("cnt"))).alias("ratio"))


@query("f04_statistics", EVENTS_SQL + """
select call, round(avg(b), 3) as mean, round(stddev_pop(b), 3) as pstdev,
       round(case when avg(b) = 0 then 0 else stddev_pop(b) / avg(b) end, 6) as cv
from (select call, cast(bytes as double) as b from ev) group by call""")
def f04(spark, sf):
    return derive_trace(spark, sf).groupBy("call").agg(
        F.round(fx.mean("bytes"), 3).alias("mean"), F.round(fx.pstdev("bytes"), 3).alias("pstdev"),
        r6(fx.cv("bytes")).alias("cv"))


@query("f05_small_category", EVENTS_SQL + """
select call, case when completion then 'completion' when call_code in (26, 39, 40) then 'synchronisation'
  when call_code in (27, 28, 29) then 'collective' else 'point-to-point' end as category, count(*) as n
from ev where part = 0 group by all""")
def f05(spark, sf):
    return derive_trace(spark, sf).filter("part = 0") \
        .groupBy(fx.call_name().alias("call"), fx.small_category().alias("category")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("f06_large_category", EVENTS_SQL + """
select call, case when call_code = 23 then 'sendrecv_part_' else 'collective_part_' end || part as category, count(*) as n
from ev where part > 0 group by all""")
def f06(spark, sf):
    return derive_trace(spark, sf).filter("part > 0") \
        .groupBy(fx.call_name().alias("call"), fx.large_category().alias("category")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("f07_call_families", EVENTS_SQL + """
select call, call_code in (13, 15, 16, 17, 18, 19, 20, 21) as send_like, call_code in (14, 22) as recv_like,
       completion, call_code in (26, 39, 40) as sync, rooted, globl as "global", count(*) as n from ev group by all""")
def f07(spark, sf):
    return derive_trace(spark, sf).groupBy("call_code").agg(F.count(F.lit(1)).alias("n")).select(
        fx.call_name().alias("call"), fx.is_send_like().alias("send_like"),
        fx.is_recv_like().alias("recv_like"), fx.is_completion().alias("completion"),
        fx.is_sync().alias("sync"), fx.is_rooted().alias("rooted"), fx.is_global().alias("global"), "n")


@query("f08_real_payload", EVENTS_SQL + """
select call, part, count(*) filter (bytes > 0 and not synthetic_empty) as real, count(*) as n from ev group by all""")
def f08(spark, sf):
    return derive_trace(spark, sf).groupBy("call", "part").agg(
        F.count_if(fx.is_real_payload()).alias("real"), F.count(F.lit(1)).alias("n"))


@query("f09_canonical_transfer", EVENTS_SQL + """
select call, part, count(*) filter (canon) as canonical, cast(coalesce(sum(bytes) filter (canon), 0) as bigint) as bytes
from ev group by all""")
def f09(spark, sf):
    canonical = fx.is_canonical_transfer()
    return derive_trace(spark, sf).groupBy("call", "part").agg(
        F.count_if(canonical).alias("canonical"),
        F.coalesce(F.sum(F.when(canonical, F.col("bytes"))), F.lit(0)).alias("bytes"))


@query("f10_collective_root", EVENTS_SQL + """
select call, root, count(*) as n from ev where coll group by all""")
def f10(spark, sf):
    return derive_trace(spark, sf).filter(fx.is_collective()) \
        .groupBy("call", fx.collective_root().alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query("f11_visual_category", EVENTS_SQL + """
select call, case when call_code in (13, 14, 15, 16, 17, 23) then 'p2p_block'
  when call_code between 18 and 22 then 'p2p_nonblock' when completion then 'state'
  when coll or barrier then 'collective' when call_code in (39, 40) then 'lifecycle' else 'unknown' end as category,
  count(*) as n from ev group by all""")
def f11(spark, sf):
    return derive_trace(spark, sf).groupBy("call_code").agg(F.count(F.lit(1)).alias("n")) \
        .select(fx.call_name().alias("call"), fx.visual_category().alias("category"), "n")


@query("f12_cstr", "select s_suppkey, s_name as text from supplier")
def f12(spark, sf):
    padded = F.concat("s_name", F.lit("\x00padding"))
    return table(spark, sf, "supplier").select("s_suppkey", fx.cstr(padded).alias("text"))


@query("f13_nbytes", EVENTS_SQL + """
select cnt, bytes % 100000 as type_size, case when cnt <= 0 or bytes % 100000 <= 0 then 0
  else least(cnt * (bytes % 100000), 2147483647) end as nbytes, count(*) as n from ev group by all""")
def f13(spark, sf):
    return derive_trace(spark, sf).groupBy("cnt", (F.col("bytes") % 100000).alias("type_size")) \
        .agg(F.count(F.lit(1)).alias("n")) \
        .select("cnt", "type_size", fx.nbytes("cnt", "type_size").alias("nbytes"), "n")


@query("f14_short_call", EVENTS_SQL + " select replace(call, 'MPI_', '') as call, count(*) as n from ev group by all")
def f14(spark, sf):
    return derive_trace(spark, sf).groupBy("call").agg(F.count(F.lit(1)).alias("n")) \
        .select(fx.short_call("call").alias("call"), "n")


@query("f15_format_bytes", EVENTS_SQL + """,
steps as (select bytes, count(*) as n, case when bytes < 1024 then 0 when bytes < 1048576 then 1
            when bytes < 1073741824 then 2 when bytes < 1099511627776 then 3 else 4 end as u from ev group by bytes),
vals as (select *, bytes / pow(1024, u) as v from steps),
digs as (select *, case when u = 0 or v >= 100 then 0 when v >= 10 then 1 else 2 end as d from vals)
select bytes, n, case d when 0 then printf('%.0f', floor(v + 0.5)) when 1 then printf('%.1f', floor(v * 10 + 0.5) / 10)
  else printf('%.2f', floor(v * 100 + 0.5) / 100) end || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][u + 1] as text
from digs""")
def f15(spark, sf):
    return derive_trace(spark, sf).groupBy("bytes").agg(F.count(F.lit(1)).alias("n")) \
        .select("bytes", "n", fx.format_bytes("bytes").alias("text"))


@query("f16_format_time", EVENTS_SQL + """,
d as (select bytes, unnest([(bytes % 100003) / 1e5, (bytes % 9999) / 1e7, cast(bytes % 100003 as double)]) as s
      from (select distinct bytes from ev))
select bytes, s, case when s < 1e-9 then printf('%.3f s', s) when s < 1e-6 then printf('%.1f ns', s * 1e9)
  when s < 1e-3 then printf('%.1f µs', s * 1e6) when s < 1 then printf('%.2f ms', s * 1e3)
  when s < 60 then printf('%.3f s', s) else printf('%.2f min', s / 60) end as text from d""")
def f16(spark, sf):
    b = F.col("bytes")
    seconds = F.array(b % 100003 / F.lit(1e5), b % 9999 / F.lit(1e7), (b % 100003).cast("double"))
    return derive_trace(spark, sf).select("bytes").distinct() \
        .select("bytes", F.explode(seconds).alias("s")) \
        .select("bytes", "s", fx.format_time("s").alias("text"))


@query("f18_link_weight", EVENTS_SQL + """
select comm, sender, receiver, count(*) as messages, round(1 + log10(count(*)), 6) as weight
from ev where canon group by all""")
def f18(spark, sf):
    return derive_trace(spark, sf).filter(fx.is_canonical_transfer()) \
        .groupBy("comm", "sender", "receiver").agg(F.count(F.lit(1)).alias("messages")) \
        .withColumn("weight", r6(fx.link_weight("messages")))


@query("f19_expand_hostlist", """
with r as (select s_nationkey as k, count(*) as n from supplier group by 1)
select cast(k as bigint) as nation, unnest(list_concat(
  list_transform(range(1, n + 1), lambda i: 'cs-n' || lpad(cast(i as varchar), cast(greatest(4, length(cast(i as varchar))) as integer), '0')),
  ['cs-n' || lpad(cast(9000 + k as varchar), 4, '0')])) as host from r""")
def f19(spark, sf):
    n = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string("cs-n[0001-%04d,%04d]", F.col("n"), F.col("s_nationkey") + 9000)
    return n.select(F.col("s_nationkey").cast("long").alias("nation"),
                    F.explode(fx.expand_hostlist(text)).alias("host"))


@query("f20_escape_tag", r"""
select doc_id, md5(regexp_replace(regexp_replace(text, '[\r\n]', '', 'g'), '([, =])', '\\\1', 'g')) as digest
from documents""")
def f20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(fx.escape_tag("text")).alias("digest"))


@query("f21_to_ms", EVENTS_SQL + """
select rank_recording, cast(trunc(time * 1000) as bigint) as ms, count(*) as n from ev group by all""")
def f21(spark, sf):
    return derive_trace(spark, sf).groupBy("rank_recording", fx.to_ms("time").alias("ms")) \
        .agg(F.count(F.lit(1)).alias("n"))


# --- timeline -----------------------------------------------------------------

def small_records(events: DataFrame) -> DataFrame:
    return events.filter("part = 0").select(
        "run_id", "rank_recording", "section_pos", "rec_pos", "local_time", "event_id", "call_code",
        "comm", "tag", "sender", "receiver", "cnt", "bytes")


def large_records(events: DataFrame) -> DataFrame:
    """Two-part records put back together."""
    part = F.struct("part", "sender", "receiver", "cnt", "bytes", "tag")
    return (events.filter("part > 0")
            .groupBy("run_id", "rank_recording", "section_pos", "rec_pos", "event_id", "call_code", "comm")
            .agg(F.max("local_time").alias("local_time"),
                 F.max(F.when(F.col("part") == 1, part)).alias("one"),
                 F.max(F.when(F.col("part") == 2, part)).alias("two"))
            .select("run_id", "rank_recording", "section_pos", "rec_pos", "local_time", "event_id",
                    "call_code", "comm", F.array("one", "two").alias("parts")))


EVENT_SUMMARY = """
select call, part, case when part = 0 then
    case when completion then 'completion' when call_code in (26, 39, 40) then 'synchronisation'
         when call_code in (27, 28, 29) then 'collective' else 'point-to-point' end
  else case when call_code = 23 then 'sendrecv_part_' else 'collective_part_' end || part end as category,
  synthetic_empty, count(*) as n, cast(sum(bytes) as bigint) as bytes, cast(sum(sender * 64 + receiver) as bigint) as ends,
  cast(sum(tag) as bigint) as tags, round(max(time), 6) as latest from ev %s group by all"""


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("call", "part", "category", "synthetic_empty").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        F.sum(F.col("sender") * 64 + F.col("receiver")).alias("ends"), F.sum("tag").alias("tags"),
        r6(F.max("time")).alias("latest"))


@query("t01_small_to_events", EVENTS_SQL + EVENT_SUMMARY % "where part = 0")
def t01(spark, sf):
    return event_summary(timeline.small_to_events(small_records(derive_trace(spark, sf))))


@query("t02_large_to_events", EVENTS_SQL + EVENT_SUMMARY % "where part > 0")
def t02(spark, sf):
    return event_summary(timeline.large_to_events(large_records(derive_trace(spark, sf))))


@query("t03_build_timeline", EVENTS_SQL + EVENT_SUMMARY % "")
def t03(spark, sf):
    ev = derive_trace(spark, sf)
    return event_summary(timeline.build_timeline(small_records(ev), large_records(ev)))


@query("t04_call_name", f"""
select code, case code {" ".join(f"when {k} then '{v}'" for k, v in S.CALLS.items())} else 'UNKNOWN_' || code end as call,
  count(*) as n from (select cast(l_quantity as bigint) as code from lineitem) group by all""")
def t04(spark, sf):
    codes = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("code")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return timeline.with_call_name(codes, "code")


def trace_anchors(events: DataFrame) -> DataFrame:
    """An anchor per recording rank; every ninth rank has none that is usable."""
    rank = F.col("rank_recording")
    return events.select("run_id", rank.alias("rank")).distinct().select(
        "run_id", "rank", (F.col("rank") / 8.0).alias("mpi_time_zero"),
        F.when(F.col("rank") % 9 == 8, F.lit(0).cast("long"))
        .otherwise(F.lit(1_700_000_000_000_000_000) + (F.col("rank") * 31 % 17).cast("long") * 1_000_003)
        .alias("unix_time_zero_ns"))


def local_clock(events: DataFrame) -> DataFrame:
    """The trace with a local clock only, some of it before the rank's zero."""
    local = (F.col("epoch_ns") % 10_000_000_019 - 5_000_000_000) / F.lit(2e9)
    return events.withColumn("local_time", local).withColumn("time", local) \
                 .withColumn("epoch_ns", F.lit(None).cast("long"))


CLOCK_SQL = EVENTS_SQL + """,
anchors as (select rank, case when rank % 9 = 8 then 0 else 1700000000000000000 + (rank * 31 % 17) * 1000003 end as zero
            from (select distinct rank_recording as rank from ev)),
origin as (select min(zero) as o from anchors where zero > 0),
loc as (select rank_recording as rank, (epoch_ns % 10000000019 - 5000000000) / 2e9 as lt from ev)"""


@query("t05_register_time", CLOCK_SQL + """,
reg as (select rank, case when zero > 0 then zero + cast(round_even(lt * 1e9, 0) as bigint) end as e, lt, o
        from loc join anchors using (rank), origin)
select rank, count(*) as n, count(e) as aligned, cast(sum(e - o) as bigint) as ns,
  round(min(coalesce((e - o) / 1e9, lt)), 6) as t_min, round(max(coalesce((e - o) / 1e9, lt)), 6) as t_max from reg group by rank""")
def t05(spark, sf):
    ev = derive_trace(spark, sf)
    anchors = trace_anchors(ev)
    reg = timeline.register_time(local_clock(ev), anchors)
    return reg.groupBy(F.col("rank_recording").alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), F.count("epoch_ns").alias("aligned"),
        F.sum(F.col("epoch_ns") - F.lit(1_700_000_000_000_000_000)).alias("ns"),
        r6(F.min("time")).alias("t_min"), r6(F.max("time")).alias("t_max"))


@query("t06_timeline_metadata", CLOCK_SQL + """
select 'global-epoch-registered' as timeline_clock, 'minimum-rank-anchor' as timeline_origin, o as timeline_origin_unix_ns from origin""")
def t06(spark, sf):
    anchors = trace_anchors(derive_trace(spark, sf))
    runs = anchors.select("run_id").distinct()
    return timeline.timeline_metadata(runs, anchors).drop("run_id")


@query("t07_register_time_live", CLOCK_SQL + """
select rank, count(*) as n, cast(sum(cast(floor(greatest(lt, 0) * 1e9 + 0.5) as bigint)) as bigint) as ns,
  cast(sum(zero % 1000000) as bigint) as zeros from loc join anchors using (rank) group by rank""")
def t07(spark, sf):
    ev = derive_trace(spark, sf)
    anchors = trace_anchors(ev)
    live = timeline.register_time_live(local_clock(ev), anchors).join(
        anchors.select(F.col("rank").alias("rank_recording"), "unix_time_zero_ns"), "rank_recording")
    return live.groupBy(F.col("rank_recording").alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("epoch_ns") - F.col("unix_time_zero_ns")).alias("ns"),
        F.sum(F.col("unix_time_zero_ns") % 1000000).alias("zeros"))


@query("t08_sort_timeline", EVENTS_SQL + """
select epoch_ns, event_id, rank_recording, part, call from ev order by epoch_ns, time, event_id, rank_recording, part""")
def t08(spark, sf):
    return timeline.sort_timeline(derive_trace(spark, sf)).select(
        "epoch_ns", "event_id", "rank_recording", "part", "call")


@query("t09_derive_trace", EVENTS_SQL + """
select call, comm, tag, part, count(*) as n, cast(sum(bytes) as bigint) as bytes, cast(sum(cnt) as bigint) as cnt,
  cast(sum(epoch_ns % 1000003) as bigint) as epochs, cast(sum(event_id % 1000003) as bigint) as ids,
  cast(sum(rank_recording * 4096 + sender * 64 + receiver) as bigint) as ranks, round(max(time), 6) as latest
from ev group by all""")
def t09(spark, sf):
    return derive_trace(spark, sf).groupBy("call", "comm", "tag", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("cnt").alias("cnt"),
        F.sum(F.col("epoch_ns") % 1000003).alias("epochs"), F.sum(F.col("event_id") % 1000003).alias("ids"),
        F.sum(F.col("rank_recording") * 4096 + F.col("sender") * 64 + F.col("receiver")).alias("ranks"),
        r6(F.max("time")).alias("latest"))
