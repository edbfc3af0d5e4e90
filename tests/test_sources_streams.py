"""Hardware maps, scheduler listings, stored timelines, text feeds and streams."""

import json

import pytest

from pyspark.sql import functions as F

from rankscope.operators import topology
from rankscope.operators.traffic import trace_totals
from rankscope.plans.derived import derive_trace
from rankscope.sources import hardware, live, store
from rankscope.streaming import live as feed, stateful
from tests.traces import events, rows


def write_map(tmp_path, body):
    path = tmp_path / "map.json"
    path.write_text(json.dumps(body, indent=1))
    return str(path)


def test_rack_and_blade_forms(spark, tmp_path):
    rack = {"id": "R1", "x_offset": 5, "nodes": [{"hostname": "a", "slot": 2}, {"hostname": ""}]}
    blade = {"id": "R2", "z_offset": 1, "blades": [{"id": "B", "y_offset": 7, "nodes": [
        {"hostname": "b", "slot": 3, "cpus": 2, "cores_per_cpu": 4}, {"hostname": "c", "slot": 1, "x_offset": 9},
        {"hostname": "a", "slot": 1}]}]}
    path = write_map(tmp_path, {"metadata": {"system_name": "sys"},
                                "cabinets": [{"id": "C", "x": -50, "z": 2, "racks": [rack, blade]}]})
    got = rows(hardware.read_hardware_map(spark, path), "hostname", "rack_id", "blade_id", "x", "y", "z", "cpus")
    assert got == [("a", "R2", "B", -38.0, 7.0, 3.0, None), ("b", "R2", "B", -14.0, 7.0, 3.0, 2),
                   ("c", "R2", "B", -41.0, 7.0, 3.0, None)]
    meta = hardware.read_hardware_metadata(spark, path).first()
    assert meta.map_system_name == "sys" and json.loads(meta.hardware_blueprint)["cabinets"][0]["id"] == "C"
    only_rack = write_map(tmp_path, {"cabinets": [{"id": "C", "x": 50, "racks": [rack]}]})
    assert rows(hardware.read_hardware_map(spark, only_rack), "hostname", "x", "y", "blade_id") == [("a", 55.0, 30.0, None)]


def test_missing_and_empty_maps(spark, tmp_path):
    assert hardware.read_hardware_map(spark, str(tmp_path / "none.json")).count() == 0
    assert hardware.read_hardware_map(spark, write_map(tmp_path, {"metadata": {}})).count() == 0


def test_scheduler_listing(spark, tmp_path):
    path = tmp_path / "topo.txt"
    path.write_text("SwitchName=s0 Level=0 LinkSpeed=1 Nodes=n[00-04]\nSwitchName=root Level=1 Switches=s[0-1]\n"
                    "SwitchName=s1 Level=0 Nodes=m1,m2\nSwitchName=bad Level=0\n")
    got = rows(hardware.read_slurm_topology(spark, str(path), racks_per_cabinet=1), "hostname", "cab_id", "blade_id", "x", "y")
    assert got == [("m1", "CAB-02", "BLADE-s1-00", 60.0, 0.0), ("m2", "CAB-02", "BLADE-s1-00", 68.0, 0.0),
                   ("n00", "CAB-01", "BLADE-s0-00", 0.0, 0.0), ("n01", "CAB-01", "BLADE-s0-00", 8.0, 0.0),
                   ("n02", "CAB-01", "BLADE-s0-00", 16.0, 0.0), ("n03", "CAB-01", "BLADE-s0-00", 24.0, 0.0),
                   ("n04", "CAB-01", "BLADE-s0-01", 0.0, 12.0)]


def test_unknown_hosts_get_default_places(spark):
    procs = spark.createDataFrame([("r", 2, 1, 0, 0, "x")], "run_id string, rank int, pid int, core int, chip int, hostname string")
    nodes = spark.createDataFrame([], "hostname string, cab_id string, rack_id string, blade_id string, x double, y double, z double")
    assert rows(topology.build_topology(procs, nodes), "x", "y", "z", "cab_id") == [(30.0, 0.0, 0.0, None)]


def test_time_lookup_reads_two_chunks(spark, tmp_path):
    ev = events(spark, [(0, i / 10, i, 13, 0, 1, 1, 1) for i in range(1000)])
    store.write_timeline(ev, str(tmp_path), 100)
    assert rows(store.read_chunk_index(spark, str(tmp_path)), "chunk_id", "n_events") == [(i, 100) for i in range(10)]
    found = store.events_at(spark, str(tmp_path), "r", 35.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "chunk_id" in plan
    assert {r.chunk_id for r in found.select("chunk_id").distinct().collect()} == {2, 3}
    assert store.read_events(spark, str(tmp_path)).count() == 1000
    frame = store.frame_at(spark, str(tmp_path), "r", 35.0, k=800).collect()
    assert [r.event_id for r in frame] == [350]
    late = store.events_at(spark, str(tmp_path), "r", 1e6)
    assert {r.chunk_id for r in late.select("chunk_id").distinct().collect()} == {8, 9}


FEED = """mpi_call,host=n\\ 1 producer_world_rank=0i,producer_subset_rank=0i,message_type=13i,sender=0i,receiver=1i,bytes=4i,count=1i,id=7i,is_large=0i 1700000000000000000
mpi_call,host=n1 producer_world_rank=0i,producer_subset_rank=0i,message_type=23i,sender1=0i,receiver1=1i,bytes1=4i,count1=1i,sender2=1i,receiver2=0i,bytes2=0i,count2=0i,id=8i,is_large=1i 1700000000000000500
other_metric,host=n1 a=1i 5"""


def test_feed_lines_round_trip(spark):
    lines = spark.createDataFrame([(x,) for x in FEED.split("\n")], "value string")
    ev = live.parse_line_protocol(lines)
    assert rows(ev, "host", "call", "part", "sender", "receiver", "bytes", "synthetic_empty", "epoch_ns") == [
        ("n 1", "MPI_SEND", 0, 0, 1, 4, False, 1700000000000000000),
        ("n1", "MPI_SENDRECV", 1, 0, 1, 4, False, 1700000000000000500),
        ("n1", "MPI_SENDRECV", 2, 1, 0, 0, True, 1700000000000000500)]
    assert rows(store.to_line_protocol(ev), "value") == sorted((x,) for x in FEED.split("\n")[:2])
    long_host = ev.withColumn("host", F.repeat(F.lit("h"), 1000))
    assert store.to_line_protocol(long_host, store.FEED_LINE_BYTES).count() == 0
    assert store.rejected_lines(store.to_line_protocol(long_host)).count() == store.to_line_protocol(long_host).count() > 0
    assert live.unparsed_lines(spark.createDataFrame([("x",), (None,), (FEED.split("\n")[0],)], "value string")).count() == 2


def test_usual_lines_are_read_from_their_places(spark):
    small, large = FEED.split("\n")[:2]
    odd = [small.replace("sender=0i,receiver=1i", "receiver=1i,sender=0i"), small.replace("count=1i", "count=1i,more=3i"), small.replace("count=1i,", ""),
           small.replace("sender=0i", "sender=00i"), small.replace("n\\ 1", "n\\x"), small.replace("n\\ 1", "n=1")]
    none = [small.replace("n\\ 1", "n 1"), small + " ", "a=b", "", None]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate([small, large, *odd, *none])], "i int, value string")
    numbers = live._numbers(lines, F.col("value"))
    assert rows(numbers.filter(live._as_written() == F.col("value")), "i")[:2] == [(0,), (1,)]
    # No line of the usual form meets a pattern: there is no filter by one before the lines are told apart.
    parsed = live.parse_line_protocol(lines)
    assert "Filter" not in parsed._jdf.queryExecution().optimizedPlan().toString()
    got = rows(parsed, "i", "host", "part", "sender", "receiver", "cnt", "event_id", "epoch_ns")
    at = 1700000000000000000
    assert got == [(0, "n 1", 0, 0, 1, 1, 7, at), (1, "n1", 1, 0, 1, 1, 8, at + 500), (1, "n1", 2, 1, 0, 0, 8, at + 500),
                   (2, "n 1", 0, 0, 1, 1, 7, at), (3, "n 1", 0, 0, 1, 1, 7, at), (4, "n 1", 0, 0, 1, None, 7, at),
                   (5, "n 1", 0, None, None, None, None, at), (6, "n\\x", 0, 0, 1, 1, 7, at), (7, "n=1", 0, 0, 1, 1, 7, at)]
    assert live.unparsed_lines(lines).count() == len(none)


def test_series_export(spark):
    text = ['{"metric":{"type":"13","sender":"0","receiver":"1","bytes":"4","count":"1"},"values":[1,1],'
            '"timestamps":[1700000000000,1700000000001]}',
            '{"metric":{"type":"23","sender1":"3","receiver1":"4","bytes1":"9","bytes2":"8"},"values":[1],"timestamps":[5]}', "junk"]
    got = rows(live.parse_series_export(spark.createDataFrame([(t,) for t in text], "value string")),
               "time", "call", "sender", "receiver", "bytes", "cnt", "bytes2")
    assert got == [(0.005, "MPI_SENDRECV", 3, 4, 9, 0, 8), (1700000000.0, "MPI_SEND", 0, 1, 4, 1, None),
                   (1700000000.001, "MPI_SEND", 0, 1, 4, 1, None)]


def feed_dir(spark, tmp_path, offsets):
    """One feed file per list of second offsets, picked up one file per trigger."""
    where = tmp_path / "feed"
    where.mkdir()
    import os
    for i, secs in enumerate(offsets):
        text = "\n".join(f"mpi_call,host=a producer_world_rank=0i,producer_subset_rank=0i,message_type=13i,sender=0i,"
                         f"receiver=1i,bytes=4i,count=1i,id={int(s * 10)}i,is_large=0i {1_700_000_000_000_000_000 + int(s * 1e9)}"
                         for s in secs)
        (where / f"{i}.txt").write_text(text)
        os.utime(where / f"{i}.txt", (1_000_000 + i, 1_000_000 + i))
    return str(where)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    path = feed_dir(spark, tmp_path, [[10.0], [10.1], [7.1, 6.9]])
    stream = feed.read_feed(spark, path, max_files=1)
    out = feed.run_once(feed.tumbling_summary(stream, "100 milliseconds"), keys=feed.SUMMARY_KEYS)
    got = {r.ms for r in out.select((F.unix_millis("poll.start") - 1_700_000_000_000).alias("ms")).collect()}
    assert got == {10000, 10100, 7100}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    # Small records only: at this scale the given tables repeat the key of one large record.
    ev = derive_trace(spark, sf_dir).filter("part = 0").withColumn("host", F.lit("h"))
    store.to_line_protocol(ev).select("value").write.text(str(tmp_path / "lines"))
    out = feed.run_once(feed.tumbling_summary(feed.read_feed(spark, str(tmp_path / "lines"), max_files=3), lateness="3650 days"), keys=feed.SUMMARY_KEYS)
    got = out.groupBy("call").agg(F.sum("canonical_bytes").alias("b"), F.sum("events").alias("n"))
    assert rows(got, "call", "n") == rows(ev.groupBy("call").agg(F.count("*").alias("n")), "call", "n")
    assert got.agg(F.sum("b")).first()[0] == trace_totals(ev).first().canonical_bytes


def test_a_window_over_several_triggers_gives_one_row(spark, tmp_path):
    path = feed_dir(spark, tmp_path, [[10.0], [10.1], [10.2, 10.3]])
    out = feed.run_once(feed.tumbling_summary(feed.read_feed(spark, path, max_files=1), "1 second"), keys=feed.SUMMARY_KEYS)
    assert rows(out, "call", "events") == [("MPI_SEND", 4)]


USE = ("run_id string, rank int, handle long, t double, call_code int, comm int, tag int, sender int, receiver int, "
       "cnt long, type_size int, is_recv boolean, wildcard boolean, done boolean, status_source int, status_count long, cancelled boolean")


def completed_after(spark, path, batches, lateness="3 seconds"):
    """Requests completed when each batch has arrived, with a last use far behind that lets the watermark pass all."""
    out, where = None, str(path / "run")
    for batch in [*batches, [("r", -1, 0, 9e6, *[None] * 9, False, None, None, None)]]:
        spark.createDataFrame(batch, USE).write.mode("append").parquet(str(path / "rows"))
        src = spark.readStream.schema(USE).parquet(str(path / "rows"))
        out = feed.run_once(stateful.complete_requests_stream(src.filter("not done"), src.filter("done"), lateness), "append", where=where)
    return rows(out, "handle", "posted_time", "local_time", "sender", "receiver", "cnt", "bytes")


def test_request_state_spans_triggers(spark, tmp_path):
    post = ("r", 1, 7, 1.0, 22, 0, 5, -1, 1, 10, 4, True, True, False, None, None, None)
    done = ("r", 1, 7, 2.0, None, None, None, None, None, None, None, None, None, True, 3, 6, False)
    lost = ("r", 1, 8, 2.0, *done[4:])
    # The completion of handle 9 comes a trigger before its post, and handle 7 has an abandoned post first.
    abandoned, early, behind = ("r", 1, 7, 0.5, *post[4:]), ("r", 1, 9, 2.0, *done[4:]), ("r", 1, 9, 1.5, *post[4:])
    got = completed_after(spark, tmp_path, ([abandoned, early, post], [done, lost, behind]))
    assert got == [(7, 1.0, 2.0, 3, 1, 6, 24), (9, 1.5, 2.0, 3, 1, 6, 24)]


def test_requests_complete_whatever_the_arrival(spark, tmp_path):
    """Reused handles whose uses arrive shuffled over several triggers, within the lateness."""
    import random
    rng, uses, want = random.Random(6), [], []
    for i in range(60):
        t = i * 0.5
        post = ("r", 1, i % 3, t, 18, 0, 5, 2, 1, i, 4, False, False, False, None, None, None)
        uses.append((t, post))
        if i % 7 != 6:
            uses.append((t + 0.25, ("r", 1, i % 3, t + 0.25, *[None] * 9, True, 3, 6, i % 10 == 9)))
            if i % 10 != 9:
                want.append((i % 3, t, t + 0.25, 2, 1, i, 4 * i))
    batches = [[], [], []]
    for t, use in uses:
        batches[min(2, int(t // 10 + rng.choice([0, 0, 1])))].append(use)
    for b in batches:
        rng.shuffle(b)
    assert completed_after(spark, tmp_path, batches, "25 seconds") == sorted(want, key=str)


def test_late_uses_are_lost(spark, tmp_path):
    post = ("r", 1, 7, 1.0, 22, 0, 5, -1, 1, 10, 4, True, True, False, None, None, None)
    done = ("r", 1, 7, 2.0, *[None] * 9, True, 3, 6, False)
    newer = ("r", 2, 7, 50.0, *post[4:])
    assert completed_after(spark, tmp_path, ([post, newer], [done])) == []


def test_drop_accounting_whatever_the_arrival(spark, sf_dir):
    from rankscope.plans import queries_live as q
    counters = q.drop_counters(q.table(spark, sf_dir, "events"))
    want = rows(stateful.drop_deltas(counters).select("producer", F.unix_micros("poll_ts").alias("us"), "delta", "dropped_total"),
                "producer", "us", "delta", "dropped_total")
    assert rows(q.st06(spark, sf_dir), "producer", "us", "delta", "dropped_total") == want


def feed_rows(spark, rows):
    """Events of ``(event_id, rank, seconds)``."""
    made = [("f", r, e, 13, r, (r + 1) % 3, 1, 8, 1, False, int(t * 1e9)) for e, r, t in rows]
    return store.with_event_ts(spark.createDataFrame(made, "run_id string, rank_recording int, event_id long, call_code int, sender int, receiver int, part int, "
                                                            "bytes long, cnt long, synthetic_empty boolean, epoch_ns long"))


def test_events_are_held_back_and_released_in_order(spark, tmp_path):
    """Released once the newest event is 2 s later; 4 s late is released at once, 6 s late is lost."""
    where, path, seen = str(tmp_path / "run"), str(tmp_path / "rows"), []
    for batch in ([(1, 0, 10.0), (2, 0, 9.0), (3, 0, 11.9)], [(4, 0, 13.0), (5, 1, 15.0), (6, 0, 12.5)], [(7, 0, 11.0), (8, 0, 9.0), (9, 0, 20.0)]):
        feed_rows(spark, batch).write.mode("append").parquet(path)
        src = spark.readStream.schema(feed_rows(spark, []).schema).parquet(path)
        out = feed.run_once(stateful.held_back(src, ["rank_recording"]), "append", where=where)
        seen.append(sorted(r.event_id for r in out.collect()))
    assert seen == [[2], [1, 2, 3, 4, 6], [1, 2, 3, 4, 5, 6, 7]]


def test_latest_activity_of_a_frame(spark, tmp_path):
    feed_rows(spark, [(1, 0, 10.01), (2, 1, 10.02), (3, 0, 10.07)]).write.parquet(str(tmp_path / "rows"))
    src = spark.readStream.schema(feed_rows(spark, []).schema).parquet(str(tmp_path / "rows"))
    out = feed.run_once(feed.sliding_latest(src, "1 day"), keys=["run_id", "frame", "rank"])
    got = {(r.ms, r["rank"]): r.us for r in out.select(F.unix_millis("frame.end").alias("ms"), "rank", F.unix_micros("event_ts").alias("us")).collect()}
    assert got == {(10050, 0): 10_010_000, (10050, 1): 10_020_000, (10050, 2): 10_020_000, (10100, 0): 10_070_000, (10100, 1): 10_070_000}


def test_producers_are_routed_in_one_pass_and_a_batch_may_be_repeated(spark, tmp_path):
    slots = spark.createDataFrame([("f", 0, 0, 0, True, 5), ("f", 1, 1, 0, True, 5), ("f", 2, 2, 2, False, 5), ("f", -1, 3, 3, True, 5), ("f", 4, 4, 4, True, 0),
                                   ("f", 0, 9, 8, True, 5)], "run_id string, rank int, slot int, subset_rank int, anchor_ready boolean, unix_time_zero_ns long")
    feed_rows(spark, [(e, e % 6, float(e)) for e in range(12)]).write.parquet(str(tmp_path / "rows"))
    reads = []
    for state in ("one", "two"):  # the second run starts anew and writes batch 0 again
        src = spark.readStream.schema(feed_rows(spark, []).schema).parquet(str(tmp_path / "rows"))
        query = feed.route_producers(src, slots, str(tmp_path / "out"), str(tmp_path / state))
        query.awaitTermination()
        reads.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert reads == [12, 12]
    assert rows(feed.routed(spark, str(tmp_path / "out"), True), "event_id") == [(0,), (6,)]
    assert rows(feed.routed(spark, str(tmp_path / "out"), False).filter("event_id < 6"), "event_id", "reason") == [
        (1, "wrong subset rank"), (2, "anchor not set"), (3, "unknown"), (4, "bad anchor"), (5, "unknown")]
    assert rows(feed.producer_verdicts(slots).filter("rank_recording < 0"), "reason") == [("bad world rank",)]


def test_expired_days_are_removed(spark, tmp_path):
    from datetime import datetime
    day = 24 * 3600.0
    path = str(tmp_path / "daily")
    feed_rows(spark, [(e, 0, e * day + 60) for e in range(6)]).withColumn("day", F.to_date("event_ts")).write.partitionBy("day").parquet(path)
    (tmp_path / "daily" / "notes").mkdir()
    now = datetime(1970, 1, 6, 12)
    open_read = feed.retained(spark.read.parquet(path), now)
    before = {p.name: sorted(x.stat().st_mtime_ns for x in p.iterdir()) for p in (tmp_path / "daily").iterdir() if p.is_dir()}
    assert feed.expire(spark, path, now) == ["1970-01-01", "1970-01-02", "1970-01-03"] and feed.expire(spark, path, now) == []
    after = {p.name: sorted(x.stat().st_mtime_ns for x in p.iterdir()) for p in (tmp_path / "daily").iterdir() if p.is_dir()}
    assert after == {k: v for k, v in before.items() if k not in ("day=1970-01-01", "day=1970-01-02", "day=1970-01-03")}
    assert open_read.count() == 1 and feed.expire(spark, str(tmp_path / "none"), now) == []
