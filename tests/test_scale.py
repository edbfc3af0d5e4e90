"""Plans and layouts that let a step grow with its input."""

import os
import re
import time

from pyspark.sql import Window, functions as F

from rankscope import schema as S
from rankscope.operators import ordinal, pairing, phases, timeline
from rankscope.plans import queries_live, queries_runs, queries_views
from rankscope.plans.derived import derive_trace
from rankscope.sources import live, store, trace_files
from rankscope.streaming import live as feed
from tests.test_sources_streams import feed_rows
from tests.traces import events, header, rows, runs, section, small, write


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_dealt_in_one_pass(spark, sf_dir):
    dealt = queries_runs.runs_trace(spark, sf_dir).events
    assert plan_of(dealt).count("FileScan") == 1
    assert {r.run_id for r in dealt.select("run_id").distinct().collect()} == set(queries_runs.RUNS) - {"one root"}  # no call of these tables falls to it
    assert dealt.filter("run_id = 'small'").agg(F.max("bytes")).first()[0] == 100
    assert rows(dealt.filter("run_id = 'one link'").select("sender", "receiver").distinct(), "sender", "receiver") == [(0, 1)]


def test_phases_leave_the_events_of_a_run_where_they_lie(spark):
    ev = events(spark, [(0, i / 10, i, 13, 0, 1, 1, 1) for i in range(100)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = phases.phases(ev, runs(spark, 3))
        plan = plan_of(found)
        assert "BroadcastHashJoin" in plan
        assert sum(r.events for r in found.collect()) == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_stored_files_do_not_depend_on_the_chunks(spark, tmp_path):
    ev = events(spark, [(0, i / 10, i, 13, 0, 1, 1, 1) for i in range(1000)])
    store.write_timeline(ev, str(tmp_path), 5)
    files = [f for _, _, names in os.walk(tmp_path / "events") for f in names if f.endswith(".parquet")]
    assert len(files) < 40
    assert store.read_chunks(spark, str(tmp_path)).select("chunk_id").distinct().count() == 200
    assert "PushedFilters: [In(chunk_id" in plan_of(store.events_at(spark, str(tmp_path), "r", 35.0))


def test_latest_activity_is_hashed_and_keeps_the_order_of_ties(spark):
    made = feed_rows(spark, [(5, 0, 10.01), (5, 0, 10.01), (7, 0, 10.01), (2 ** 62, 1, 10.02), (-2 ** 62, 1, 10.02)]) \
        .withColumn("call_code", F.when(F.col("event_id") == 7, F.lit(None)).otherwise(F.col("call_code") + F.col("bytes").cast("int")).cast("int")) \
        .withColumns({"receiver": F.col("sender"), "event_id": F.when(F.col("event_id") == 5, F.lit(None)).otherwise(F.col("event_id")).cast("long")})
    made = made.filter("call_code is not null or event_id = 7").withColumn("call_code", F.coalesce("call_code", F.lit(13)))
    got = feed.sliding_latest(made.unionByName(made.filter("event_id = 7").withColumn("call_code", F.lit(18))))
    assert "SortAggregate" not in plan_of(got)
    assert rows(got.select("rank", "call_code", F.unix_micros("event_ts").alias("us")), "rank", "call_code", "us") == [
        (0, 18, 10_010_000), (1, 21, 10_020_000)]


def test_salvage_reads_an_index_that_is_written_down(spark, tmp_path):
    write(tmp_path / "a.trace", header(2), section(0, [small(1.0, 1, 13, 0, 1)]), section(1, []))
    write(tmp_path / "b.trace", header(2), section(0, [small(1.0, 1, 13, 0, 1)]), section(1, [])[:-4])
    found, report = trace_files.read_sections(spark, str(tmp_path)), trace_files.salvage_report(spark, str(tmp_path))
    assert "BatchScan trace" not in plan_of(found) + plan_of(report)
    assert rows(found, "run_id", "rank") == [("a.trace", 0), ("a.trace", 1), ("b.trace", 0)]
    assert rows(report, "run_id", "status") == [("b.trace", "partial")]


def test_calls_are_picked_by_code_that_the_machine_compiles(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pairing, "number_rows", lambda rows, keys: rows)
    picked = pairing.calls_in_turn(derive_trace(spark, sf_dir), (pairing.SEND, pairing.RECEIVE), payload=True)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(picked._jdf.queryExecution().executedPlan()))]
    assert sizes and max(sizes) < 7000  # methods of more than 8,000 bytes are interpreted
    assert {r.kind for r in picked.select("kind").distinct().collect()} == {pairing.SEND, pairing.RECEIVE}


def test_chunk_numbers_carry_the_order_alone(spark, sf_dir):
    assert set(queries_views.chunked(spark, sf_dir).columns) == {"run_id", *S.ORDER_COLUMNS, "ordinal", "chunk_id"}


def test_many_files_are_looked_at_once_by_few_tasks(spark, tmp_path):
    for i in range(150):
        write(tmp_path / f"{i:03d}.trace", header(1), section(0, [small(1.0, i, 13, 0, 1)]))
    few = max(spark.sparkContext.defaultParallelism, 3)
    assert trace_files._load(spark, str(tmp_path), "sections").rdd.getNumPartitions() <= few
    found = trace_files.read_small(spark, str(tmp_path), "FAILFAST")
    assert "BatchScan trace" not in plan_of(found)
    assert sorted(r.event_id for r in found.collect()) == list(range(150))


def test_series_are_read_once(spark):
    made = spark.createDataFrame([(1, [5, 7]), (2, []), (3, None)], "bytes long, timestamps array<long>").select(F.to_json(F.struct(
        F.create_map(F.lit("sender"), F.when(F.col("bytes") == 2, "x").otherwise("4")).alias("metric"),
        F.transform("timestamps", lambda t: F.lit(1)).alias("values"), "timestamps")).alias("value"))
    got = live.parse_series_export(made)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert rows(got, "time", "sender") == [(0.005, 4), (0.007, 4)]


def test_a_piece_of_the_feed_is_one_trigger_however_many_files_it_has(spark, tmp_path):
    made = spark.range(3000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 100) as ts", "id % 7 as user_id", "1.5D as value")
    made.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    assert made.sparkSession.read.parquet(str(tmp_path / "events.parquet")).rdd.getNumPartitions() > 1
    seen, stream = [], queries_live.in_pieces(spark, str(tmp_path))
    stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.count())).option("checkpointLocation", str(tmp_path / "state")) \
        .trigger(availableNow=True).start().awaitTermination()
    assert seen == [1000, 1000, 1000]


def test_a_timeline_is_written_down_once(spark, tmp_path, monkeypatch):
    """Rows are numbered where the one shuffle has put them; no table of theirs lies beside the timeline."""
    monkeypatch.setattr(ordinal, "written", None)
    made = events(spark, [(i % 3, i // 7, i % 50, 13, 0, 1, i, 8 * i) for i in range(400)]).withColumn("run_id", F.expr("nullif(concat('r', event_id % 4), 'r3')"))
    twice = made.unionByName(made.filter("event_id % 5 = 0"))
    number = F.row_number().over(Window.partitionBy("run_id").orderBy(*S.timeline_order())) - 1
    want = rows(twice.withColumn("ordinal", number), "run_id", "event_id", "rank_recording", "rec_pos", "ordinal")
    numbered = timeline.with_chunk_id(twice.repartition(5), 10)
    assert rows(numbered, "run_id", "event_id", "rank_recording", "rec_pos", "ordinal") == want
    store.write_timeline(twice, str(tmp_path), 10)
    assert rows(store.read_chunks(spark, str(tmp_path)).filter("run_id like 'r%'"), "run_id", "event_id", "rank_recording", "rec_pos", "ordinal") == [w for w in want if w[0]]


def test_stored_events_leave_out_what_other_columns_tell(spark):
    usual = events(spark, [(1, 2.0, 3, 13, 1, 2, 8, 8)]).withColumn("rec_pos", F.col("event_id"))
    odd = usual.withColumns({"call": F.lit("other"), "category": F.lit(None).cast("string"), "section_pos": F.lit(9), "rec_pos": F.lit(None).cast("long"), "time": F.lit(0.0),
                             "local_time": F.lit(-0.0), "cnt": F.lit(7).cast("long"), "synthetic_empty": F.lit(None).cast("boolean")})
    empty = usual.withColumns({"part": F.lit(1), "cnt": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long"), "synthetic_empty": F.lit(True)})
    made = usual.unionByName(odd).unionByName(empty)
    text = [str(r) for r in made.collect()]
    stored = store.packed(made)
    assert [str(r) for r in store.unpacked(stored).collect()] == text
    left = stored.collect()
    assert all(left[0][c] is None for c in store.TOLD) and left[1]["call"] == "other" and str(left[1]["local_time"]) == "-0.0" and left[2]["cnt"] is None


def test_numbering_leaves_no_shuffle_files(spark):
    """Once the pieces are written down, what they were shuffled through goes at once."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held() -> set[str]:
        files = disk.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    ev = events(spark, [(0, i / 10, i, 13, 0, 1, 1, 1) for i in range(1000)]).repartition(4)
    kept, name = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    ordinal.ranged(ev, ["run_id"], S.timeline_order())
    for _ in range(100):
        if held() <= kept:
            break
        time.sleep(0.1)
    assert held() <= kept and spark.conf.get(name) == before


def test_chunks_of_the_document_carry_the_order_alone(spark, sf_dir, monkeypatch):
    seen, given = [], timeline.with_chunk_id
    monkeypatch.setattr(timeline, "with_chunk_id", lambda rows, *a: seen.append(set(rows.columns)) or given(rows, *a))
    queries_live.k03(spark, sf_dir)
    assert seen == [{"run_id", "_told", *S.ORDER_COLUMNS}]


def test_feed_files_are_packed(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_live, "scratch", lambda spark, name: str(tmp_path / name))
    read = queries_live.st01(spark, sf_dir)
    names = [f for f in os.listdir(tmp_path / "feed") if f.startswith("part-")]
    assert names and all(f.endswith(".txt.gz") for f in names)
    lines = store.to_line_protocol(queries_live.hosted(spark, sf_dir))
    assert read.agg(F.sum("n")).first()[0] == live.parse_line_protocol(lines.select("value")).count()
