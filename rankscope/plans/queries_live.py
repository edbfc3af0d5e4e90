"""Queries for stored timelines, text feeds and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import phases, timeline, traffic
from rankscope.plans import analysis
from rankscope.plans.derived import RUN_ID, derive_trace, derived_runs, table
from rankscope.plans.queries_rules import _ISSUES as ISSUES_SQL, _PATTERNS as PATTERNS_SQL, _RULES as RULES, SEVERITY
from rankscope.plans.queries_scalar import trace_anchors
from rankscope.plans.queries_traffic import HIST_SQL, PHASES_SQL
from rankscope.plans.queries_views import CHUNK, MOMENT, map_nodes, posted_requests, request_completions
from rankscope.plans.registry import EVENTS_SQL, METRICS_SQL, TO, calls_text, query, trace
from rankscope.session import scratch
from rankscope.sources import hardware, live, store
from rankscope.streaming import live as feed, stateful

# --- stored timelines ---------------------------------------------------------


def stored(spark: SparkSession, sf: str) -> str:
    """The derived trace written in chunks."""
    path = scratch(spark, "timeline")
    store.write_timeline(derive_trace(spark, sf), path, CHUNK)
    return path


@query("k01_write_timeline", EVENTS_SQL + f""",
num as (select *, row_number() over (order by epoch_ns, time, event_id, rank_recording, part) - 1 as ordinal from ev)
select ordinal // {CHUNK} as chunk_id, call, count(*) as n, cast(sum(bytes) as bigint) as bytes,
       min(epoch_ns) as first_ns, max(epoch_ns) as last_ns from num group by all""")
def k01(spark, sf):
    return store.read_chunks(spark, stored(spark, sf)).groupBy("chunk_id", "call").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("epoch_ns").alias("first_ns"),
        F.max("epoch_ns").alias("last_ns"))


@query("s15_read_events", EVENTS_SQL + """
select call, part, synthetic_empty, count(*) as n, cast(sum(event_id % 1000003) as bigint) as ids from ev group by all""")
def s15(spark, sf):
    return store.read_events(spark, stored(spark, sf)).groupBy("call", "part", "synthetic_empty").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") % 1000003).alias("ids"))


@query("s15_frame_at", EVENTS_SQL + f"""
select event_id, part, rank_recording from ev where time <= {MOMENT} and time >= {MOMENT} - 0.5
  and (time >= {MOMENT} - 0.05 or coll or barrier or call_code in (39, 40))
qualify row_number() over (order by time desc, epoch_ns desc, event_id desc, rank_recording desc, part desc) <= 800""")
def s15_frame(spark, sf):
    return store.frame_at(spark, stored(spark, sf), "derived", MOMENT, k=800).select("event_id", "part", "rank_recording")


@query("k03_analysis_document")
def k03(spark, sf):
    t = trace(spark, sf, share=True)
    path = scratch(spark, "blueprint")
    hardware.write_hardware_map(map_nodes(spark, sf), path, "cluster")
    runs = t.runs.join(hardware.read_hardware_metadata(spark, path).select(F.lit(RUN_ID).alias("run_id"), "hardware_blueprint"), "run_id", "left")
    topology = hosted(spark, sf).groupBy("run_id", F.col("rank_recording").alias("rank")).agg(F.min("host").alias("hostname"))
    statistics = traffic.histogram_totals(traffic.message_histogram(t.events), t.runs)
    sections = analysis.analyse(t)
    order = store.packed(t.events.select("run_id", *S.ORDER_COLUMNS))  # after the sections: what they have shuffled is gone by now
    chunks = timeline.chunk_index(timeline.with_chunk_id(order, CHUNK, store.packed_order(order)))
    return analysis.analysis_document(sections, runs, topology, trace_anchors(t.events), statistics, chunks)


# Fields of the document that hold real numbers; they are compared to six digits.
DOCUMENT_REALS = {
    "mpi_time_zero", "per_rank_avg", "t_start", "t_end", "estimated_runtime", "pair_density", "avg_out_peers", "avg_in_peers", "first_time", "last_time", "t_min", "t_max", "spread",
    "score", "small_lt_1kb_ratio", "top_root_share", "top_link_share", "touch_bytes_cv", "barrier_fraction", "completion_to_transfer_ratio", "fraction_of_traffic",
    "fraction_of_collectives", "wasted_time_sec", "delayed_time_sec", "max_barrier_spread", "avg_barrier_spread"}

# All fields of the document's sections, by section; SQL gives the same as (section, position, field, value). Those of patterns and issues follow with their metrics.
DOCUMENT_FIELDS = {
    "metadata": ["total_ranks"], "topology": ["rank", "hostname"], "time_anchors": ["rank", "mpi_time_zero", "unix_time_zero_ns"],
    "statistics": ["call", "call_code", *traffic.BIN_COLUMNS, "total", "per_rank_avg"], "hardware_blueprint": ["hardware_blueprint"],
    "chunks": ["chunk_id", "t_start", "t_end", "n_events"],
    "analysis.summary": ["total_events", "canonical_transfer_events", "canonical_transfer_bytes", "completion_events", "barrier_events", "collective_events",
                         "estimated_runtime", "pair_density", "avg_out_peers", "avg_in_peers"],
    "analysis.per_rank": ["rank", "events", "completion_events", "barrier_events", "collective_events", "global_collective_events", "rooted_collective_events",
                          "completion_request_count", "canonical_bytes_out", "canonical_messages_out", "distinct_out_peers", "canonical_bytes_in",
                          "canonical_messages_in", "distinct_in_peers", "touch_bytes"],
    "analysis.top_ranks_by_out_bytes": ["rank", "bytes", "messages"], "analysis.top_ranks_by_in_bytes": ["rank", "bytes", "messages"],
    "analysis.top_ranks_by_touch_bytes": ["rank", "bytes"], "analysis.top_links": analysis.LINK_FIELDS, "analysis.collective_roots": ["root", "events", "bytes", "calls"],
    "analysis.barrier_spreads": ["barrier_index", "t_min", "t_max", "spread"], "analysis.time_windows": ["phase", "t_start", "t_end", *phases.PHASE_COUNTS],
    "analysis.patterns": ["type", "description"], "analysis.issues": ["type", "severity", "score", "description"]}

# What a finding says in its metrics, by type, and where SQL has it. The largest link's own fields are those of top_links.
_SMALL = {"small_lt_1kb_ratio": "small1k_ratio", "small_lt_1kb_events": "small1k_events"}
_ROOT, _LINK = {"top_root": "top_root", "top_root_share": "top_root_share"}, {"top_link_share": "top_link_share", **{f"top_link.{f}": f"top_link.{f}" for f in analysis.LINK_FIELDS}}
_DENSITY, _TOUCH = {"pair_density": "pair_density", "pairs_observed": "pairs_observed"}, {"touch_bytes_cv": "touch_cv"}


def _late(count: str, side: str, lost: str, of: str, per: str) -> dict[str, str]:
    return {count: f"{side}_n", of: f"{side}_n / cast({per} as double)", lost: f"{side}_t"}


FINDING_METRICS = {
    "dense-communication": _DENSITY, "sparse-communication": _DENSITY, "small-message-dominated": _SMALL, "root-concentrated-collectives": _ROOT, "dominant-link": _LINK,
    "rank-communication-imbalance": _TOUCH, "completion-heavy": {"completion_to_transfer_ratio": "completion_ratio"},
    "barrier-heavy": {"barrier_events": "barrier_events", "barrier_fraction": "barrier_fraction"},
    "late_sender": _late("late_sender_count", "ls", "wasted_time_sec", "fraction_of_traffic", "canonical_events"),
    "late_receiver": _late("late_receiver_count", "lr", "delayed_time_sec", "fraction_of_traffic", "canonical_events"),
    "late_broadcaster": _late("late_broadcaster_count", "lb", "wasted_time_sec", "fraction_of_collectives", "collective_events"),
    "early_reduce_arrival": _late("early_reduce_count", "er", "wasted_time_sec", "fraction_of_collectives", "collective_events"),
    "small_message_pressure": _SMALL, "rank_traffic_imbalance": {**_TOUCH, "top_ranks_by_touch": "busiest"}, "collective_root_bottleneck": _ROOT,
    "barrier_arrival_skew": {x: x for x in ("max_barrier_spread", "avg_barrier_spread", "barrier_instances")},
    "completion_overhead": {"completion_events": "completion_events", "completion_to_transfer_ratio": "completion_ratio"}, "link_hotspot": _LINK}


def _document_sql() -> str:
    """Every field of the document from the tables."""
    bins = ", ".join(f"count(*) filter (bin = {i} and not synthetic_empty) as {c}" for i, c in enumerate(traffic.BIN_COLUMNS))
    total = "count(*) filter (bin is not null and not synthetic_empty)"
    top_ranks = "select row_number() over (order by {0} desc, rank) as position, rank, {0} as bytes{1} from ranks_t qualify position <= 10"
    sources = {
        "metadata": "select 0 as position, 64 as total_ranks",
        "topology": "select rank_recording as position, rank_recording as rank, min('node ' || (rank_recording // 8) || ',x=' || (rank_recording % 3)) as hostname from ev group by rank_recording",
        "time_anchors": "select distinct rank_recording as position, rank_recording as rank, rank_recording / 8.0::double as mpi_time_zero, case when rank_recording % 9 = 8 then 0 else 1700000000000000000 + (rank_recording * 31 % 17) * 1000003 end as unix_time_zero_ns from ev",
        "statistics": f"select call_code as position, call, call_code, {bins}, {total} as total, {total} / 64.0::double as per_rank_avg from ev group by call_code, call",
        "hardware_blueprint": "select 0 as position, * from blueprint",
        "chunks": f"select chunk_id as position, chunk_id, arg_min(time, o) as t_start, arg_max(time, o) as t_end, count(*) as n_events from (select time, row_number() over (order by {TO}) - 1 as o, o // {CHUNK} as chunk_id from ev) group by chunk_id",
        "analysis.summary": "select 0 as position, total_events, canonical_events as canonical_transfer_events, canonical_bytes as canonical_transfer_bytes, completion_events, barrier_events, collective_events, runtime as estimated_runtime, pair_density, avg_out_peers, avg_in_peers from m",
        "analysis.per_rank": "select rank as position, * from ranks_t join acts using (rank)",
        "analysis.top_ranks_by_out_bytes": top_ranks.format("canonical_bytes_out", ", canonical_messages_out as messages"),
        "analysis.top_ranks_by_in_bytes": top_ranks.format("canonical_bytes_in", ", canonical_messages_in as messages"),
        "analysis.top_ranks_by_touch_bytes": top_ranks.format("touch_bytes", ""),
        "analysis.top_links": "select row_number() over (order by bytes desc, seen) as position, * from links qualify position <= 20",
        "analysis.collective_roots": "select row_number() over (order by bytes desc, seen) as position, * from roots",
        "analysis.barrier_spreads": "select barrier_index as position, * from spreads",
        "analysis.time_windows": "select phase as position, * from phases",
        "analysis.patterns": "select * from pat", "analysis.issues": "select * from iss"}

    def text(field: str, source: str) -> str:
        return f"printf('%.6f', cast({source} as double))" if field.split(".")[-1] in DOCUMENT_REALS else f"cast({source} as varchar)"

    def fields(section: str, values: dict[str, str], source: str) -> str:
        return (f"select '{section}' as section, cast(position as bigint) as position, unnest([{', '.join(repr(f) for f in values)}]) as field, "
                f"unnest([{', '.join(text(f, x) for f, x in values.items())}]) as value from ({source})")

    rows = [fields(section, {f: f for f in names}, sources[section]) for section, names in DOCUMENT_FIELDS.items()]
    for section, found, scored in (("analysis.patterns", "pat", False), ("analysis.issues", "iss", True)):
        for kind in (kind for _, kind, _, score, _ in RULES if (score is not None) == scored):
            rows.append(fields(section, {f"metrics.{f}": x for f, x in FINDING_METRICS[kind].items()},
                               f"select position, m.*, largest.top_link, busy.busiest from {found}, m left join largest on true, busy where type = '{kind}'"))
    return PHASES_SQL + f""",
pat as materialized (select row_number() over (order by ord) as position, type, description from ({PATTERNS_SQL})),
iss as materialized (select row_number() over (order by score desc, ord) as position, type, score, {SEVERITY.format('score')} as severity, description from ({ISSUES_SQL})),
largest as (select links as top_link from links order by bytes desc, seen limit 1),
busy as (select '[' || string_agg(printf('{{"rank":%d,"bytes":%d}}', rank, touch_bytes), ',' order by touch_bytes desc, rank) || ']' as busiest
         from (select rank, touch_bytes from ranks_t order by touch_bytes desc, rank limit 5)),
nodes as (
  select 'CAB-' || (r_regionkey // 2) as cab, r_name as rack, cast(n_nationkey * 15 as double) as y, string_agg(printf(
    '{{"slot":0,"hostname":"%s","x_offset":%s,"cpus":%d,"cores_per_cpu":%d}}', n_name,
    cast(cast((r_regionkey // 2) * 60 + (r_regionkey % 2) * 12 as double) as varchar), 1 + n_nationkey % 2, 1 + n_nationkey % 3), ',' order by n_name) as listed
  from nation join region on n_regionkey = r_regionkey group by 1, 2, 3),
racks as (select cab, rack, string_agg('{{"y_offset":' || y || ',"nodes":[' || listed || ']}}', ',' order by y) as listed from nodes group by 1, 2),
cabs as (select cab, string_agg('{{"id":"' || rack || '","x_offset":0.0,"z_offset":0.0,"blades":[' || listed || ']}}', ',' order by rack) as listed from racks group by 1),
blueprint as (
  select '{{"metadata":{{"system_name":"cluster"}},"cabinets":['
    || string_agg('{{"id":"' || cab || '","x":0.0,"z":0.0,"racks":[' || listed || ']}}', ',' order by cab) || ']}}' || chr(10) as hardware_blueprint from cabs)
""" + " union all ".join(rows)


@query("k03_document_values", _document_sql())
def k03_values(spark, sf):
    """What the document says, read back from its lines: all fields of all sections, those of a finding's metrics one by one."""
    def opened(rows: DataFrame, field: str) -> DataFrame:
        """The member ``field``, itself an object, as its own members."""
        inner = F.from_json("value", "map<string,string>")
        pairs = F.transform(F.map_entries(inner), lambda e: F.struct(F.concat(F.lit(f"{field}."), e["key"]).alias("field"), e["value"].alias("value")))
        return rows.select("section", "position", F.inline(F.when((F.col("field") == field) & F.col("value").isNotNull(), pairs).otherwise(
            F.array(F.struct("field", "value")))))

    told = k03(spark, sf).select("section", "position", F.explode(F.from_json("json", "map<string,string>")).alias("field", "value"))
    told = opened(opened(told, "metrics"), "metrics.top_link")
    name = F.substring_index("field", ".", -1)
    value = F.when(name == "calls", calls_text(F.from_json("value", "map<string,bigint>"))).when(name.isin(sorted(DOCUMENT_REALS)), fx.fixed("cast(value as double)", 6)) \
        .otherwise(F.col("value"))
    return told.select("section", "position", "field", value.alias("value"))


@query("k04_hardware_map", "select n_name as hostname, 1 + n_nationkey % 2 as cpus, 1 + n_nationkey % 3 as cores_per_cpu from nation")
def k04(spark, sf):
    path = scratch(spark, "map")
    hardware.write_hardware_map(map_nodes(spark, sf), path, "cluster")
    return hardware.read_hardware_map(spark, path).select("hostname", "cpus", "cores_per_cpu")


@query("s09_hardware_map", """
select n_name as hostname, r_name as rack_id, 'CAB-' || (r_regionkey // 2) as cab_id,
       cast((r_regionkey // 2) * 60 + (r_regionkey % 2) * 12 as double) as x, cast(n_nationkey * 15 as double) as y
from nation join region on n_regionkey = r_regionkey""")
def s09(spark, sf):
    path = scratch(spark, "map")
    hardware.write_hardware_map(map_nodes(spark, sf), path, "cluster")
    return hardware.read_hardware_map(spark, path).select("hostname", "rack_id", "cab_id", "x", "y")


@query("s10_system_name", "select 'region map' as system_name, count(*) as nodes from nation")
def s10(spark, sf):
    path = scratch(spark, "map")
    hardware.write_hardware_map(map_nodes(spark, sf), path, "region map")
    meta = hardware.read_hardware_metadata(spark, path).withColumn("run_id", F.lit("derived"))
    runs = derived_runs(spark).withColumn("system_name", F.lit("Unknown Cluster"))
    hosts = F.regexp_count("hardware_blueprint", F.lit('"hostname"')).cast("long")
    return hardware.with_system_name(runs, meta.filter("map_system_name is not null")) \
        .select("system_name", hosts.alias("nodes"))


@query("s11_slurm_topology", """
with r as (select s_nationkey as k, count(*) as n, row_number() over (order by s_nationkey) - 1 as rack from supplier group by 1)
select 'sw' || lpad(cast(k as varchar), 2, '0') || '-n' || lpad(cast(h + 1 as varchar), 4, '0') as hostname,
  printf('CAB-%02d', rack // 4 + 1) as cab_id, printf('BLADE-sw%02d-%02d', k, h // 4) as blade_id,
  cast((rack // 4) * 60 + (rack % 4) * 12 + (h % 4) * 8 as double) as x, cast((h // 4) * 12 as double) as y
from (select *, unnest(range(n)) as h from r)""")
def s11(spark, sf):
    path = scratch(spark, "topo")
    n = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    line = F.format_string("SwitchName=sw%02d Level=0 LinkSpeed=1 Nodes=sw%02d-n[0001-%04d]",
                           "s_nationkey", "s_nationkey", "n")
    n.orderBy("s_nationkey").coalesce(1).select(line.alias("value")).write.text(path)
    return hardware.read_slurm_topology(spark, path).select("hostname", "cab_id", "blade_id", "x", "y")


# --- summaries ----------------------------------------------------------------

@query("k06_summary_table", HIST_SQL + """
select case when call = 'MPI_SEND' then 13 else code end as call_order, replace(call, 'MPI_', '') as call, b0, b1, b2, b3, b4, b5,
  b0 + b1 + b2 + b3 + b4 + b5 as total, printf('%.1f', (b0 + b1 + b2 + b3 + b4 + b5) / 64.0::double) as per_rank_avg
from hist join (select distinct call as c, call_code as code from ev) on c = call""")
def k06(spark, sf):
    t = trace(spark, sf)
    return analysis.summary_table(t.events, t.runs).drop("run_id")


@query("k07_analysis_summary", METRICS_SQL + """
select unnest(['Total events', 'Canonical transfers', 'Canonical transfer bytes', 'Completion events', 'Barrier events', 'Estimated runtime']) as label,
  unnest([total_events::varchar, canonical_events::varchar, canonical_bytes::varchar, completion_events::varchar, barrier_events::varchar,
          printf('%.6fs', runtime)]) as value,
  unnest([printf('(Avg per rank: %.1f)', total_events / 64.0::double), printf('(Avg per rank: %.1f)', canonical_events / 64.0::double), null,
          printf('(Avg per rank: %.1f)', completion_events / 64.0::double), printf('(Avg per rank: %.1f)', barrier_events / 64.0::double), null]) as note
from m""")
def k07(spark, sf):
    return analysis.analysis_summary_table(trace(spark, sf, share=True)).filter("line <= 6").select("label", "value", "note")


# --- text feeds ---------------------------------------------------------------

def hosted(spark, sf) -> DataFrame:
    text = [F.coalesce(F.expr(number).cast("string"), F.lit("null")) for number in ("rank_recording div 8", "rank_recording % 3")]
    return derive_trace(spark, sf).withColumn("host", F.concat(F.lit("node "), text[0], F.lit(",x="), text[1]))


LINE_SQL = EVENTS_SQL + """,
h as (select *, 'node\\ ' || (rank_recording // 8) || '\\,x\\=' || (rank_recording % 3) as host from ev),
lines as (
  select printf('mpi_call,host=%s producer_world_rank=%di,producer_subset_rank=%di,message_type=%di,sender=%di,receiver=%di,bytes=%di,count=%di,id=%di,is_large=0i %d',
           host, rank_recording, rank_recording, call_code, sender, receiver, bytes, cnt, event_id, epoch_ns) as line from h where part = 0
  union all
  select printf('mpi_call,host=%s producer_world_rank=%di,producer_subset_rank=%di,message_type=%di,sender1=%di,receiver1=%di,bytes1=%di,count1=%di,sender2=%di,receiver2=%di,bytes2=%di,count2=%di,id=%di,is_large=1i %d',
           a.host, a.rank_recording, a.rank_recording, a.call_code, a.sender, a.receiver, a.bytes, a.cnt, b.sender, b.receiver, b.bytes, b.cnt, a.event_id, a.epoch_ns)
  from h a join h b on a.part = 1 and b.part = 2 and a.rank_recording = b.rank_recording and a.event_id = b.event_id)"""


@query("k05_line_protocol", LINE_SQL + " select md5(line) as digest, count(*) as n from lines group by 1")
def k05(spark, sf):
    return store.to_line_protocol(hosted(spark, sf)).groupBy(F.md5("value").alias("digest")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("s12_parse_line_protocol", EVENTS_SQL + """
select 'node ' || (rank_recording // 8) || ',x=' || (rank_recording % 3) as host, call, part, synthetic_empty, count(*) as n,
  cast(sum(bytes) as bigint) as bytes, cast(sum(sender * 64 + receiver) as bigint) as ends,
  cast(sum(epoch_ns % 1000003) as bigint) as epochs, cast(sum(event_id % 1000003) as bigint) as ids from ev group by all""")
def s12(spark, sf):
    return live.parse_line_protocol(store.to_line_protocol(hosted(spark, sf)).select("value")) \
        .groupBy("host", "call", "part", "synthetic_empty").agg(
            F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
            F.sum(F.col("sender") * 64 + F.col("receiver")).alias("ends"),
            F.sum(F.col("epoch_ns") % 1000003).alias("epochs"), F.sum(F.col("event_id") % 1000003).alias("ids"))


@query("s13_parse_series_export", EVENTS_SQL + """
select call, sender, receiver, bytes, is_large, count(*) as n, round(sum(ms) / 1000.0, 3) as seconds from (
  select call, sender, receiver, bytes, 0 as is_large, epoch_ns // 1000000 as ms from ev where part = 0
  union all select call, sender, receiver, bytes, 1, epoch_ns // 1000000 from ev where part = 1) group by all""")
def s13(spark, sf):
    """Samples of equal labels share a series; series are cut by second to stay small."""
    ev = derive_trace(spark, sf).filter("part < 2")
    labels = F.when(F.col("part") == 0, F.create_map(
        F.lit("type"), F.col("call_code").cast("string"), F.lit("sender"), F.col("sender").cast("string"),
        F.lit("receiver"), F.col("receiver").cast("string"), F.lit("bytes"), F.col("bytes").cast("string"))) \
        .otherwise(F.create_map(
            F.lit("type"), F.col("call_code").cast("string"), F.lit("sender1"), F.col("sender").cast("string"),
            F.lit("receiver1"), F.col("receiver").cast("string"), F.lit("bytes1"), F.col("bytes").cast("string"),
            F.lit("bytes2"), F.lit("0")))
    series = ev.groupBy("call_code", "sender", "receiver", "bytes", "part",
                        F.expr("epoch_ns div 1000000000").alias("second")) \
        .agg(F.sort_array(F.collect_list(F.expr("epoch_ns div 1000000"))).alias("timestamps"))
    text = F.to_json(F.struct(labels.alias("metric"), F.transform("timestamps", lambda t: F.lit(1)).alias("values"),
                              "timestamps"))
    return live.parse_series_export(series.select(text.alias("value"))) \
        .groupBy("call", "sender", "receiver", "bytes", "is_large") \
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("time") * 1000)) / 1000, 3).alias("seconds"))


# --- streams ------------------------------------------------------------------

def feed_events(events: DataFrame) -> DataFrame:
    """The event table of the given data as live events: users are ranks, types are calls."""
    us = F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', ts)")
    code = F.expr("get(array(13, 18, 23, 26, 29), cast(event_id % 5 as int))")
    return events.select(
        F.lit("feed").alias("run_id"), (F.col("user_id") % 64).cast("int").alias("rank_recording"),
        "event_id", code.alias("call_code"), (F.col("user_id") % 64).cast("int").alias("sender"),
        (F.col("event_id") % 64).cast("int").alias("receiver"), F.lit(1).alias("part"),
        (F.col("value") * 100).cast("long").alias("bytes"), F.lit(1).cast("long").alias("cnt"),
        F.lit(False).alias("synthetic_empty"), (us * 1000).alias("epoch_ns"),
        F.timestamp_micros(us).alias("event_ts"))


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


FEED_SQL = """
with fe as (select epoch_us(ts) as us, [13, 18, 23, 26, 29][event_id % 5 + 1] as code, user_id % 64 as sender, event_id % 64 as receiver,
                   cast(trunc(value * 100) as bigint) as bytes from events)"""


def in_halves(spark: SparkSession, events: DataFrame, stream) -> DataFrame:
    """What ``stream(source, where)`` has given when the older half, the newer half, and then a tenth of the older half have arrived."""
    path, where = scratch(spark, "late"), scratch(spark, "late-run")
    half = events.agg(F.expr("(min(epoch_ns) div 1000 + max(epoch_ns) div 1000) div 2")).first()[0]
    older, delayed = F.expr(f"epoch_ns div 1000 < {half}"), F.col("event_id") % 10 == 0
    out = None
    for part in (events.filter(older & ~delayed), events.filter(~older), events.filter(older & delayed)):
        part.write.mode("append").parquet(path)
        out = stream(spark.readStream.schema(events.schema).parquet(path), where)
    return out


def arriving(spark: SparkSession, rows: DataFrame, at: str, stream, slices: int = 2, flush: DataFrame | None = None,
             ticks: int = 1_000_000) -> DataFrame:
    """What ``stream(source, where, lateness)`` has given after ``rows`` arrived in slices of their time ``at`` (in ``ticks`` of a second), shuffled, a tenth of
    each slice with the next one; ``flush`` is a last row far behind them, with which the watermark passes all others."""
    path, where = scratch(spark, "arriving"), scratch(spark, "arriving-run")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    width = (high - low) // slices + 1
    number = F.floor((F.col(at) - low) / width) + (F.xxhash64(*rows.columns) % 10 == 0).cast("int")
    out = None
    for i in range(slices + 1):
        rows.filter(number == i).orderBy(F.xxhash64(at)).write.mode("append").parquet(path)
        if i == slices and flush is not None:
            flush.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]).write.mode("append").parquet(path)
        out = stream(spark.readStream.schema(rows.schema).parquet(path), where, f"{2 * width * 1000 // ticks + 1} milliseconds")
    return out


@query("st02_late_rows", FEED_SQL + """,
f as (select epoch_us(ts) as us, event_id % 10 = 0 as delayed from events),
b as (select (min(us) + max(us)) // 2 as half, max(us) as newest from f)
select us // 1000000 as second, count(*) as events from f, b
where not (delayed and us < half and (us // 1000000 + 1) * 1000000 <= newest - 3000000) group by all""")
def st02(spark, sf):
    """The older half, the newer half, then a tenth of the older half that comes too late for its windows."""
    def counted(source, where):
        polls = feed.with_lateness(source).groupBy(F.window("event_ts", "1 second").alias("poll")).agg(F.count(F.lit(1)).alias("events"))
        return feed.run_once(polls, "update", ["poll"], where)

    return in_halves(spark, feed_events(table(spark, sf, "events")), counted).select(F.unix_seconds("poll.start").alias("second"), "events")


@query("st02_held_back", FEED_SQL.replace("event_id % 64 as receiver", "event_id % 64 as receiver, event_id % 10 = 0 as delayed, event_id") + """,
b as (select (min(us) + max(us)) // 2 as half, max(us) as newest from fe)
select event_id, sender as rank, us from fe, b
where us <= newest // 1000 * 1000 - 2000000 and not (delayed and us < half and us <= newest // 1000 * 1000 - 5000000)""")
def st02_held_back(spark, sf):
    """Two seconds behind the newest event; what comes more than three seconds behind that moment is lost."""
    def released(source, where):
        return feed.run_once(stateful.held_back(source, ["rank_recording"]), "append", where=where)

    return in_halves(spark, feed_events(table(spark, sf, "events")), released).select(
        "event_id", F.col("rank_recording").alias("rank"), F.unix_micros("event_ts").alias("us"))


def in_pieces(spark: SparkSession, sf: str, pieces: int = 3) -> DataFrame:
    """The feed as a stream of several pieces, one per trigger, each with rows of all windows; a piece has a file per task that wrote it."""
    path = scratch(spark, "feed-files")
    events = feed_events(table(spark, sf, "events"))
    for i in range(pieces):
        events.filter(F.col("event_id") % pieces == i).write.mode("append").parquet(path)
    files = len(spark.read.schema(events.schema).parquet(path).inputFiles())
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(-(-files // pieces), 1)).parquet(path)


@query("st03_sliding_activity", FEED_SQL + """,
w as (select *, unnest(range(us // 50000 + 1, us // 50000 + 11)) * 50000 as frame_us from fe)
select frame_us, code as call_code, sender, receiver, count(*) as n from w
where code in (26, 29) or us >= frame_us - 50000 group by all""")
def st03(spark, sf):
    out = feed.run_once(feed.sliding_activity(in_pieces(spark, sf), "3650 days").drop("call"), keys=feed.ACTIVITY_KEYS)
    return out.select(F.unix_micros("frame.end").alias("frame_us"), "call_code", "sender", "receiver", "n")


@query("st03_latest_activity", FEED_SQL.replace("event_id % 64 as receiver", "event_id % 64 as receiver, event_id") + """,
w as (select *, unnest(range(us // 50000 + 1, us // 50000 + 11)) * 50000 as frame_us from fe),
t as (select frame_us, unnest([sender, receiver]) as rank, code, us, event_id from w where code in (26, 29) or us >= frame_us - 50000)
select frame_us, rank, arg_max(code, (us, event_id)) as call_code, max(us) as us from t group by all""")
def st03_latest(spark, sf):
    out = feed.run_once(feed.sliding_latest(in_pieces(spark, sf), "3650 days").drop("call", "category"), keys=["run_id", "frame", "rank"])
    # A later trigger may have touched a frame with earlier rows only, never with less than it had: state keeps the latest.
    return out.select(F.unix_micros("frame.end").alias("frame_us"), "rank", "call_code", F.unix_micros("event_ts").alias("us"))


@query("st04_tumbling_summary", FEED_SQL + """
select us // 1000000 as second, code as call_code, count(*) as events,
  count(*) filter (bytes > 0 and code in (13, 18, 23)) as canonical_events,
  cast(coalesce(sum(bytes) filter (bytes > 0 and code in (13, 18, 23)), 0) as bigint) as canonical_bytes from fe group by all""")
def st04(spark, sf):
    out = feed.run_once(feed.tumbling_summary(in_pieces(spark, sf), lateness="3650 days"), keys=feed.SUMMARY_KEYS)
    return out.select(F.unix_seconds("poll.start").alias("second"), "call_code", "events", "canonical_events",
                      "canonical_bytes")


@query("st07_valid_producers", FEED_SQL + """
select sender as rank, count(*) filter (sender % 9 <> 8 and sender % 7 <> 5) as kept, count(*) filter (sender % 9 = 8 or sender % 7 = 5) as rejected,
  case when sender % 7 = 5 then 'wrong subset rank' when sender % 9 = 8 then 'bad anchor' end as reason from fe group by sender""")
def st07(spark, sf):
    """One pass; every ninth rank has no usable anchor, every seventh stands in another's slot."""
    slots = feed_events(table(spark, sf, "events")).select("run_id", F.col("rank_recording").alias("rank")).distinct().withColumns({
        "slot": F.col("rank"), "subset_rank": F.when(F.col("rank") % 7 == 5, F.col("rank") + 1).otherwise(F.col("rank")), "anchor_ready": F.lit(True),
        "unix_time_zero_ns": F.when(F.col("rank") % 9 == 8, -1).otherwise(1).cast("long")})
    where = scratch(spark, "routed")
    feed.route_producers(feed_events(stream_of(spark, sf, "events")), slots, f"{where}/out", f"{where}/state").awaitTermination()
    lost = feed.routed(spark, f"{where}/out", False).withColumn("ok", F.lit(False))
    return feed.routed(spark, f"{where}/out", True).withColumns({"ok": F.lit(True), "reason": F.lit(None).cast("string")}).unionByName(lost) \
        .groupBy(F.col("rank_recording").alias("rank")) \
        .agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("rejected"), F.max("reason").alias("reason"))


@query("st08_retention", """
with d as (select ts, (select max(ts) from events) as now from events)
select cast(ts as date) as day, count(*) as n from d where ts >= now - interval 1 day group by 1""")
def st08(spark, sf):
    where = scratch(spark, "daily")
    feed.write_daily(feed_events(stream_of(spark, sf, "events")), f"{where}/out", f"{where}/state").awaitTermination()
    newest = table(spark, sf, "events").agg(F.max("ts").alias("t")).first().t
    day = F.expr("date_add(date'1970-01-01', cast(epoch_ns div 86400000000000 as int))").alias("day")
    return feed.retained(spark.read.parquet(f"{where}/out"), newest).groupBy(day).agg(F.count(F.lit(1)).alias("n"))


COUNTERS_SQL = """
with c as (select user_id % 64 as producer, epoch_us(ts) as us, cast(floor(epoch_us(ts) / 1e9) as bigint) as total from events),
l as (select *, total - lag(total, 1, 0) over (partition by producer order by us, total) as delta from c)
select producer, us, delta, total as dropped_total from l where delta <> 0"""


def drop_counters(events: DataFrame) -> DataFrame:
    """Cumulative counts per producer that stand still between some polls."""
    us = F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return events.select((F.col("user_id") % 64).alias("producer"), F.timestamp_micros(us).alias("poll_ts"),
                         F.floor(us / F.lit(1e9)).alias("dropped_total"))


@query("w05_drop_deltas", COUNTERS_SQL)
def w05(spark, sf):
    return stateful.drop_deltas(drop_counters(table(spark, sf, "events"))).select(
        "producer", F.unix_micros("poll_ts").alias("us"), "delta", "dropped_total")


@query("st06_drop_accounting", COUNTERS_SQL)
def st06(spark, sf):
    """Polls arrive shuffled, some of them late."""
    polls = drop_counters(table(spark, sf, "events")).withColumn("us", F.unix_micros("poll_ts"))
    last = polls.limit(1).withColumns({"producer": F.lit(-1), "poll_ts": F.expr("timestamp'2100-01-01'"), "us": F.lit(0), "dropped_total": F.lit(0)})

    def deltas(source, where, lateness):
        return feed.run_once(stateful.drop_deltas_stream(source, lateness), "append", where=where)

    return arriving(spark, polls, "us", deltas, flush=last).select("producer", F.unix_micros("poll_ts").alias("us"), "delta", "dropped_total")


@query("st08_expired_days", """
with d as (select cast(ts as date) as day, (select cast(max(ts) as date) from events) as today from events)
select day, count(*) as n from d where day >= today - 2 group by day""")
def st08_expired(spark, sf):
    """What lies on disk after expiry: the days of the retention period and one of grace."""
    where = scratch(spark, "daily")
    feed.write_daily(feed_events(stream_of(spark, sf, "events")), f"{where}/out", f"{where}/state").awaitTermination()
    newest = table(spark, sf, "events").agg(F.max("ts").alias("t")).first().t
    feed.expire(spark, f"{where}/out", newest)
    stored = spark.read.parquet(f"{where}/out")
    return stored.groupBy(F.expr("date_add(date'1970-01-01', cast(epoch_ns div 86400000000000 as int))").alias("day")).agg(F.count(F.lit(1)).alias("n"))


FEED_FILES = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1_000_000}  # a packed file is one task's work


@query("st01_live_ingest", EVENTS_SQL + """
select call, part, count(*) as n, cast(sum(bytes) as bigint) as bytes, min(epoch_ns // 1000) as first_us from ev group by all""")
def st01(spark, sf):
    path = scratch(spark, "feed")
    store.to_line_protocol(hosted(spark, sf)).select("value").write.options(**FEED_FILES).text(path)
    return feed.run_once(feed.read_feed(spark, path), "append").groupBy("call", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        F.min(F.unix_micros("event_ts")).alias("first_us"))


TICKS = 1 << 21  # of a second; a power of two keeps the times exact, so that no two uses share an instant


@query("st05_request_completion", EVENTS_SQL + """,
po as (select rank_recording as rank, event_id % 31 as handle, call_code, tag, sender, receiver, bytes as cnt, call_code = 22 as is_recv,
         call_code = 22 and event_id % 3 = 0 as wild, (sender + 1) % 64 as src, case when event_id % 4 = 0 then -1 else bytes + 1 end as c
       from ev where call_code between 18 and 22 and event_id % 11 <> 0 and (event_id % 7 <> 3 or event_id % 5 <> 1))
select rank as rank_recording, handle, call_code, tag, case when is_recv and wild then src else sender end as sender, receiver,
  case when is_recv and c >= 0 then c else cnt end as cnt from po""")
def st05(spark, sf):
    """Posts and completions arrive shuffled, some of them late; handles are reused once completed."""
    distinct = F.col("epoch_ns") * 1000 + F.col("event_id") % 997
    rows = derive_trace(spark, sf).filter("call_code between 18 and 22").select(
        "run_id", "rank_recording", "event_id", "call_code", "comm", "tag", "sender", "receiver", "bytes", (distinct / float(TICKS)).alias("time"), distinct.alias("us"))
    last = rows.limit(1).withColumns({"rank_recording": F.lit(-1), "time": F.lit(9e9), "us": F.lit(0)})

    def completed(source, where, lateness):
        posted = posted_requests(source).withColumn("handle", F.col("event_id") % 31)
        return feed.run_once(stateful.complete_requests_stream(posted, request_completions(posted), lateness), "append", where=where)

    return arriving(spark, rows, "us", completed, flush=last, ticks=TICKS).filter("rank_recording >= 0") \
        .select("rank_recording", "handle", "call_code", "tag", "sender", "receiver", "cnt")
