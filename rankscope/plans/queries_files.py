"""Queries over trace files that Spark writes from the order lines: intact, damaged and compressed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankscope.plans.derived import table
from rankscope.plans.registry import query
from rankscope.session import scratch
from rankscope.sources import trace_files, trace_layout as L

RUN_KEYS, RANKS = 1024, 8  # order keys of a run: more orders give more files, not longer ones

FILE_SQL = f"""
with lines as (
  select l_orderkey // {RUN_KEYS} as run, l_suppkey % {RANKS} as rank, l_partkey % {RANKS} as peer, (l_orderkey * 8 + l_linenumber) % 2147483647 as event_id, l_partkey * 64 + l_quantity as turn,
         ((l_orderkey * 8 + l_linenumber) % 1000000) / 1000.0::double as local_time, l_linenumber % 3 as comm, l_partkey % 100 as tag,
         cast(l_quantity as bigint) as cnt, (l_orderkey + l_linenumber) % 4 = 0 as is_large,
         [13, 14, 18, 22, 24][l_linenumber % 5 + 1] as small_code, [23, 30, 31, 32][l_partkey % 4 + 1] as large_code from lineitem),
numbered as (select *, row_number() over (partition by run, rank, is_large order by event_id, turn) - 1 as rec_pos from lines),
runs as (select run, printf('run-%05d.trace', run) as run_id, case when run % 4 = 3 then 1 else 2 end as version from (select distinct run from lines)),
spine as (select run, run_id, version, cast(range as bigint) as rank from runs, range({RANKS})),
counts as (select run, rank, count(*) filter (not is_large) as s, count(*) filter (is_large) as l from lines group by all),
sized as (select spine.*, coalesce(s, 0) as n_small, coalesce(l, 0) as n_large, 60 + 40 * coalesce(s, 0) + 64 * coalesce(l, 0) as size
          from spine left join counts using (run, rank)),
sections as (select *, case version when 2 then 16 else 4 end + 64 + 1024 + {RANKS} * (1040 + case version when 2 then 24 else 0 end)
                       + coalesce(sum(size) over (partition by run order by rank rows between unbounded preceding and 1 preceding), 0) as start from sized)"""


def file_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Runs, processes, anchors and records of the files; every fourth run is of the old format, every fifth has no program."""
    lines = table(spark, sf, "lineitem").selectExpr(
        f"l_orderkey div {RUN_KEYS} as run", f"cast(l_suppkey % {RANKS} as int) as rank_recording", f"cast(l_partkey % {RANKS} as int) as peer",
        "(l_orderkey * 8 + l_linenumber) % 2147483647 as event_id", "cast(l_partkey * 64 + l_quantity as bigint) as turn", "((l_orderkey * 8 + l_linenumber) % 1000000) / 1000D as local_time",
        "cast(l_linenumber % 3 as int) as comm", "cast(l_partkey % 100 as int) as tag", "cast(l_quantity as bigint) as cnt",
        "(l_orderkey + l_linenumber) % 4 = 0 as is_large", "get(array(13, 14, 18, 22, 24), cast(l_linenumber % 5 as int)) as small_code",
        "get(array(23, 30, 31, 32), cast(l_partkey % 4 as int)) as large_code").withColumn("run_id", F.format_string("run-%05d.trace", "run"))
    runs = lines.select("run", "run_id").distinct().selectExpr(
        "run_id", f"{RANKS} as total_ranks", "concat('day ', run) as date", "if(run % 5 = 4, '', concat('prog-', run % 3)) as program",
        "if(run % 4 = 3, 1, 2) as file_format_version", "run")
    ranks = runs.select("run_id", "run", "file_format_version", F.explode(F.sequence(F.lit(0), F.lit(RANKS - 1))).alias("rank"))
    small, large = lines.filter("not is_large"), lines.filter("is_large")
    part = "named_struct('part', {0}, 'sender', {1}, 'receiver', {2}, 'cnt', cnt + {0} - 1, 'bytes', (cnt + {0} - 1) * 8, 'tag', tag + {0} - 1)"
    lead = ["run_id", "rank_recording", "event_id * 4294967296 + turn as rec_pos", "local_time", "event_id"]
    return {
        "runs": runs.drop("run"), "processes": ranks.selectExpr("run_id", "rank", "1000 + rank as pid", "rank % 4 as core", "rank div 4 as chip",
                                                                "concat('node', run % 2, '-', rank div 4) as hostname"),
        "anchors": ranks.filter("file_format_version = 2").selectExpr(
            "run_id", "rank as pos", "if(rank = 7, 99, (rank + 3) % 7) as rank", "rank / 8D as mpi_time_zero", "1700000000000000000 + run * 1000000 + rank as unix_time_zero_ns"),
        "small": small.selectExpr(*lead, "small_code as call_code", "comm", "tag", "rank_recording as sender", "peer as receiver", "cnt", "cnt * 8 as bytes"),
        "large": large.selectExpr(*lead, "large_code as call_code", "comm", f"array({part.format(1, 'rank_recording', 'peer')}, {part.format(2, 'peer', 'rank_recording')}) as parts")}


def written(spark: SparkSession, sf: str, **options) -> str:
    path = scratch(spark, "trace-files")
    trace_files.write_trace(path=path, **file_tables(spark, sf), **options)
    return path


@query("s01_read_runs", FILE_SQL + f"""
select run_id, {RANKS} as total_ranks, 'day ' || run as date, case when run % 5 = 4 then 'unknown' else 'prog-' || (run % 3) end as program,
       'Unknown Cluster' as system_name, case version when 2 then 'MPICv002' else 'legacy-v1' end as file_format, version as file_format_version,
       case version when 2 then 'per-rank-unix-anchor' else 'legacy-local-time' end as time_registration from runs""")
def s01(spark, sf):
    return trace_files.read_runs(spark, written(spark, sf))


@query("s02_read_processes", FILE_SQL + """
select run_id, rank, 1000 + rank as pid, rank % 4 as core, rank // 4 as chip, 'node' || (run % 2) || '-' || (rank // 4) as hostname from spine""")
def s02(spark, sf):
    return trace_files.read_processes(spark, written(spark, sf))


@query("s03_read_anchors", FILE_SQL + """
select run_id, case when rank = 7 then 7 else (rank + 3) % 7 end as rank, rank / 8.0::double as mpi_time_zero, 1700000000000000000 + run * 1000000 + rank as unix_time_zero_ns
from spine where version = 2""")
def s03(spark, sf):
    return trace_files.read_anchors(spark, written(spark, sf))


SMALL_SQL = FILE_SQL + """
select run_id, rank as rank_recording, rank as section_pos, rec_pos, local_time, event_id, small_code as call_code, comm, tag, rank as sender, peer as receiver,
       cnt, cnt * 8 as bytes from numbered join runs using (run) where not is_large"""


@query("s04_read_small", SMALL_SQL)
def s04(spark, sf):
    return trace_files.read_small(spark, written(spark, sf), "FAILFAST")


LARGE_SQL = FILE_SQL + """
select run_id, rank as rank_recording, rank as section_pos, rec_pos, local_time, event_id, large_code as call_code, comm, part, case part when 1 then rank else peer end as sender,
       case part when 1 then peer else rank end as receiver, cnt + part - 1 as cnt, (cnt + part - 1) * 8 as bytes, tag + part - 1 as tag
from numbered join runs using (run), (select unnest([1, 2]) as part) where is_large"""


@query("s05_read_large", LARGE_SQL)
def s05(spark, sf):
    records = trace_files.read_large(spark, written(spark, sf), "FAILFAST")
    return records.select("*", F.inline("parts")).drop("parts")


@query("s06_read_sections", FILE_SQL + """
select run_id, rank, rank as section_pos, start + 32 as small_offset, n_small, start + 60 + 40 * n_small as large_offset, n_large from sections""")
def s06(spark, sf):
    return trace_files.read_sections(spark, written(spark, sf), "FAILFAST") \
        .select("run_id", "rank", "section_pos", "small_offset", "n_small", "large_offset", "n_large")


# --- damage -------------------------------------------------------------------

LOST = 3  # the rank whose label a damaged file loses


def damaged(spark: SparkSession, path: str) -> str:
    """Copies of trace files: of three one stays whole, one ends within its last section, one has a label overwritten."""
    target = scratch(spark, "damaged")
    labels = trace_files.read_sections(spark, path, "FAILFAST").filter(F.col("rank") == LOST).select("run_id", "path", (F.col("small_offset") - 28).alias("label"))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kind = int(r["run_id"].removeprefix("run-").removesuffix(".trace")) % 3
                _, source = L.locate(r["path"])
                where, out = L.locate(f"{target}/{r['run_id']}")
                where.create_dir(out.rsplit("/", 1)[0], recursive=True)
                left = where.get_file_info(source).size - (20 if kind == 1 else 0)
                with where.open_input_stream(source) as f, where.open_output_stream(out) as g:
                    head = f.read(r["label"])
                    g.write(head)
                    left -= len(head)
                    if kind == 2:
                        g.write(b"XXX")
                        f.read(3)
                        left -= 3
                    while left > 0 and (block := f.read(min(left, 1 << 20))):
                        g.write(block)
                        left -= len(block)
                yield pa.RecordBatch.from_pydict({"run_id": [r["run_id"]]})

    labels.mapInArrow(copy, "run_id string").write.format("noop").mode("overwrite").save()
    return target


@query("s07_salvage", FILE_SQL + f"""
select run_id, rank, row_number() over (partition by run order by rank) - 1 as section_pos, start + 32 as small_offset, n_small, n_large,
       case run % 3 when 0 then 'intact' else 'partial' end as status
from sections where not (run % 3 = 1 and rank = {RANKS - 1}) and not (run % 3 = 2 and rank = {LOST})""")
def s07(spark, sf):
    path = damaged(spark, written(spark, sf))
    report = trace_files.salvage_report(spark, path).select("run_id", "status")
    return trace_files.read_sections(spark, path).join(report, "run_id", "left").fillna("intact", ["status"]) \
        .select("run_id", "rank", "section_pos", "small_offset", "n_small", "n_large", "status")


@query("s07_salvaged_records", FILE_SQL + f"""
select run_id, rank as rank_recording, count(*) as n, sum(event_id) as ids, max(rec_pos) as last from numbered join runs using (run)
where not is_large and not (run % 3 = 1 and rank = {RANKS - 1}) and not (run % 3 = 2 and rank = {LOST}) group by all""")
def s07_records(spark, sf):
    return trace_files.read_small(spark, damaged(spark, written(spark, sf))).groupBy("run_id", "rank_recording").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.max("rec_pos").alias("last"))


# --- compression --------------------------------------------------------------

@query("s08_compressed", SMALL_SQL.replace("select run_id, rank as rank_recording", "select run_id || '.gz' as run_id, rank as rank_recording"))
def s08(spark, sf):
    """Files of many members, which several tasks read."""
    return trace_files.read_small(spark, written(spark, sf, compressed=True, member_bytes=1 << 15), "FAILFAST")
