"""Edge cases of the operators on hand-made traces, and brute-force checks of the hot-key paths."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import frames, ordinal, pairing, phases, quality, rules, timeline, topk, traffic
from rankscope.plans.derived import derive_trace, derived_runs
from rankscope.plans.metrics import Trace
from tests.traces import SMALL_DDL, events, rows, runs


def one(df):
    return df.first().asDict()


# --- scalar functions ---------------------------------------------------------

def test_size_bins(spark):
    sizes = [-1, 0, 127, 128, 1023, 1024, 65535, 65536, 1048575, 1048576, 16777215, 16777216]
    df = spark.createDataFrame([(s,) for s in sizes], "b long").select("b", fx.size_bin("b").alias("bin"))
    b = S.BINS
    assert [r.bin for r in df.collect()] == [None, b[0], b[0], b[1], b[1], b[2], b[2], b[3], b[3], b[4], b[4], b[5]]


def test_fixed_equals_python_formatting(spark):
    rng = random.Random(7)
    values = [0.15, 0.125, 2.675, 6.25, 0.0, -1.005, 1e-9, 12345.6789, 0.9985] + \
        [rng.uniform(0, 10 ** rng.randint(-3, 6)) for _ in range(300)] + [k / 2000 for k in range(1, 400, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 3, 6):
        got = [r[0] for r in df.select(fx.fixed("v", digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_hostlists(spark):
    cases = {"n[08-11]": ["n08", "n09", "n10", "n11"], "cs-n[0000-0001,0007]": ["cs-n0000", "cs-n0001", "cs-n0007"],
             "a,b": ["a", "b"], "single": ["single"], "x[9-10]": ["x9", "x10"], "q[3]": ["q3"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", fx.expand_hostlist("t").alias("h"))
    assert {r.t: r.h for r in df.collect()} == cases


def test_names_and_codes(spark):
    df = spark.createDataFrame([(13,), (40,), (99,), (0,)], "call_code int").withColumn("call", fx.call_name())
    assert [(r.call, r.back) for r in df.select("call", fx.call_code().alias("back")).collect()] == [
        ("MPI_SEND", 13), ("MPI_FINALIZE", 40), ("UNKNOWN_99", 99), ("UNKNOWN_0", 0)]


# --- clocks -------------------------------------------------------------------

def test_ranks_without_anchor_sort_last(spark):
    small = spark.createDataFrame(
        [("r", k, k, 0, t, 1, 13, 0, 0, 0, 1, 1, 1) for k, t in ((0, 5.0), (1, -3.0), (2, 2.5e-9))], SMALL_DDL)
    anchors = spark.createDataFrame([("r", 0, 0.0, 1000), ("r", 1, 0.0, 0), ("r", 2, 0.0, 2000)],
                                    "run_id string, rank int, mpi_time_zero double, unix_time_zero_ns long")
    ev = timeline.register_time(timeline.small_to_events(small), anchors)
    got = [(r.rank_recording, r.epoch_ns) for r in timeline.sort_timeline(ev).collect()]
    assert got == [(2, 2002), (0, 5_000_001_000), (1, None)]
    t = one(traffic.trace_totals(ev))
    assert (t["start_time"], t["end_time"], t["runtime"]) == (1.002e-6, -3.0, 0.0)
    p = phases.phases(ev, runs(spark, 3)).collect()
    assert len(p) == 1 and p[0].events == 3 and p[0].t_end < p[0].t_start


@pytest.mark.parametrize("n,w", [(49999, 10), (50000, 11), (1500000, 40), (2000000, 40), (0, 10)])
def test_window_count(spark, n, w):
    c = phases.window_count(F.lit(1.0), F.lit(n).cast("long"))
    assert spark.range(1).select(c.alias("w")).first().w == w


# --- histogram, links ---------------------------------------------------------

def test_placeholders_and_unknown_calls(spark):
    ev = events(spark, [(0, 1, 1, 99, 0, 1, 1, 5), (0, 2, 2, 13, 0, 1, 1, -1)])
    gather = ev.filter("event_id = 1").withColumn("call_code", F.lit(S.GATHER)).withColumn("part", F.lit(2)) \
        .withColumn("synthetic_empty", F.lit(True))
    wide = traffic.message_histogram(ev.unionByName(gather)).collect()
    assert {r.call: sum(r[c] for c in traffic.BIN_COLUMNS) for r in wide} == {
        "UNKNOWN_99": 1, "MPI_SEND": 0, "MPI_GATHER": 0}
    assert ev.filter("call_code = 99").first().category == "point-to-point"


def test_equal_links_keep_first_appearance(spark):
    ev = events(spark, [
        (3, 1.0, 9, 13, 3, 0, 1, 50), (2, 1.0, 4, 13, 2, 0, 1, 50), (1, 1.0, 4, 13, 1, 0, 1, 50),
        (0, 2.0, 1, 13, 0, 1, 1, 50), (0, 3.0, 2, 13, 0, 2, 1, 90)])
    got = topk.top_links(ev, runs(spark, 4), 4).orderBy("position").collect()
    assert [(r.sender, r.receiver, r.bytes) for r in got] == [(0, 2, 90), (1, 0, 50), (2, 0, 50), (3, 0, 50)]
    last = topk.top_links(ev, runs(spark, 4), 5).orderBy("position").collect()[-1]
    assert (last.sender, last.receiver) == (0, 1)


def test_receiver_out_of_range(spark):
    ev = events(spark, [(0, 1, 1, 13, 0, -1, 1, 10), (0, 2, 2, 13, 0, 1, 1, 10)])
    r = traffic.per_rank(ev, runs(spark, 2)).orderBy("rank").collect()
    assert [(x.distinct_out_peers, x.canonical_bytes_out, x.canonical_bytes_in) for x in r] == [(2, 20, 0), (0, 0, 10)]
    assert traffic.links(ev).count() == 2


# --- pairing ------------------------------------------------------------------

def test_fifo_zero_bytes_and_surplus(spark):
    ev = events(spark, [(0, t, i, 13, 0, 1, 0, 0) for i, t in enumerate((1.0, 2.0, 3.0))]
                + [(1, t, i, 14, 0, 1, 0, 0) for i, t in enumerate((1.5, 2.25))])
    assert rows(pairing.pair_p2p(ev), "ordinal", "send_time", "recv_time") == [(0, 1.0, 1.5), (1, 2.0, 2.25)]
    assert rows(pairing.unmatched_p2p(ev), "surplus_sends", "surplus_receives") == [(1, 0)]
    assert one(traffic.trace_totals(ev))["canonical_events"] == 0


def test_difference_of_exactly_one_millisecond_is_not_late(spark):
    pairs = spark.createDataFrame([("r", 0.0, 0.001), ("r", 0.001, 0.0), ("r", 0.0, 0.0011), ("r", 0.0012, 0.0)],
                                  "run_id string, send_time double, recv_time double")
    late = one(pairing.p2p_lateness(pairs))
    assert (late["late_sender_count"], late["late_receiver_count"]) == (1, 1)


def test_bcast_ordinals_run_across_roots(spark):
    rows_ = []
    for i, root in enumerate((0, 1, 0)):
        for rank in (0, 1):
            rows_.append((rank, i + rank / 10, i, 27, root, rank, 1, 4))
    got = rows(pairing.pair_bcast(events(spark, rows_)), "root", "ordinal", "local")
    assert got == [(0, 0, 1), (0, 2, 1), (1, 1, 0)]
    no_root = events(spark, [(1, 1.0, 0, 27, 0, 1, 1, 4)])
    assert pairing.pair_bcast(no_root).count() == 0


def test_barriers_need_every_rank(spark):
    ev = events(spark, [(r, k + r / 100, k, 26, r, r) for r in (0, 1) for k in range(3 - r)])
    assert rows(pairing.barrier_spreads(ev, runs(spark, 2)), "barrier_index") == [(0,), (1,)]
    assert pairing.barrier_spreads(ev, runs(spark, 3)).count() == 0


def skewed(spark, n=6000):
    """A third of all rows on one link, many of them at one instant, some without a clock."""
    rng = random.Random(3)
    out = []
    for i in range(n):
        s, d = (0, 1) if rng.random() < 0.34 else (rng.randrange(6), rng.randrange(6))
        send = rng.random() < 0.5
        t = 5.0 if rng.random() < 0.3 else round(rng.uniform(0, 10), 3)
        out.append((s if send else d, t, i, 13 if send else 14, s, d, 1, rng.randrange(3000), 0, rng.randrange(2)))
    ev = events(spark, out)
    return ev.withColumn("epoch_ns", F.when(F.col("event_id") % 10 < 9, F.col("epoch_ns")))


def brute_order(r):
    return (r.epoch_ns is None, r.epoch_ns or 0, r.time, r.event_id, r.rank_recording)


def test_hot_keys_are_numbered_like_brute_force(spark):
    ev = skewed(spark).cache()
    seen, expected = defaultdict(int), {}
    for r in sorted(ev.collect(), key=brute_order):
        key = (r.comm, r.sender, r.receiver, r.tag, r.call_code)
        expected[r.event_id] = seen[key]
        seen[key] += 1
    got = {r.event_id: r.ordinal for r in pairing.p2p_ordinals(ev).collect()}
    assert got == expected


def test_pieces_stay_even_with_a_bad_anchor_a_burst_and_equal_times(spark):
    good = spark.range(40_000).selectExpr("id as event_id", "id * 1000 as epoch_ns")
    cases = {
        "bad anchor": good.withColumn("epoch_ns", F.when(F.col("event_id") == 7, -1_700_000_000_000_000_000).otherwise(F.col("epoch_ns"))),
        "burst": good.withColumn("epoch_ns", F.when(F.col("event_id") > 4000, F.lit(5_000_000)).otherwise(F.col("epoch_ns"))),
        "equal times": good.withColumn("epoch_ns", F.lit(1).cast("long"))}
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # pieces this small would be put together
    spark.conf.set(coalesce, "false")
    for name, case in cases.items():
        ev = case.selectExpr("'r' as run_id", "0 as rank_recording", "0 as section_pos", "0 as rec_kind", "event_id as rec_pos", "0 as part",
                             "event_id", "epoch_ns", "epoch_ns / 1e9 as time")
        sizes = [r["count"] for r in ordinal.ranged(ev.repartition(8), ["run_id"], S.timeline_order()).groupBy("_piece").count().collect()]
        assert len(sizes) > 4 and max(sizes) <= 2 * sum(sizes) / len(sizes), (name, sizes)
        numbered = ordinal.number_rows(ev, ["run_id"])
        assert numbered.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first()[:] == (40_000, 0, 39_999)
    spark.conf.unset(coalesce)


def test_chunks_do_not_depend_on_slices(spark):
    ev = skewed(spark).cache()
    expected = {r.event_id: i // 700 for i, r in enumerate(sorted(ev.collect(), key=brute_order))}
    chunked = timeline.with_chunk_id(ev, 700)
    assert {r.event_id: r.chunk_id for r in chunked.collect()} == expected
    index = timeline.chunk_index(chunked).orderBy("chunk_id").collect()
    assert [r.n_events for r in index] == [700] * 8 + [400]


def test_partitioning_and_a_second_run_change_nothing(spark, sf_dir):
    ev, rn = derive_trace(spark, sf_dir).cache(), derived_runs(spark)
    twice = ev.unionByName(ev.withColumn("run_id", F.lit("again"))).repartition(13)
    both = rn.unionByName(rn.withColumn("run_id", F.lit("again")))
    cols = ("position", "comm", "sender", "receiver", "bytes")
    base = rows(Trace(ev, rn).metrics(("totals", "links", "touch", "barriers")).drop("run_id"),
                "canonical_bytes", "pairs_observed", "touch_cv", "barrier_instances", "runtime")
    doubled = Trace(twice, both).metrics(("totals", "links", "touch", "barriers"))
    for r in doubled.collect():
        assert [r.canonical_bytes, r.pairs_observed, r.barrier_instances] == [base[0][0], base[0][1], base[0][3]]
        assert r.touch_cv == pytest.approx(base[0][2])
    assert rows(topk.top_links(twice, both).filter("run_id = 'again'"), *cols) == rows(topk.top_links(ev, rn), *cols)


# --- requests -----------------------------------------------------------------

def test_reused_handles_wildcards_and_cancel(spark):
    posted = spark.createDataFrame(
        [("r", 1, 7, 1.0, 22, 0, 5, -1, 1, 10, 4, True, True), ("r", 1, 7, 3.0, 18, 0, 5, 1, 0, 2, 4, False, False),
         ("r", 1, 8, 1.0, 22, 0, 5, 0, 1, 3, 4, True, False), ("r", 1, 9, 1.0, 22, 0, 5, 0, 1, 3, 4, True, False)],
        "run_id string, rank int, handle long, t double, call_code int, comm int, tag int, sender int, receiver int, "
        "cnt long, type_size int, is_recv boolean, wildcard boolean")
    done = spark.createDataFrame(
        [("r", 1, 7, 2.0, 2, 6, False), ("r", 1, 7, 4.0, None, None, None), ("r", 1, 8, 2.0, 0, 3, True)],
        "run_id string, rank int, handle long, t double, status_source int, status_count long, cancelled boolean")
    got = rows(pairing.complete_requests(posted, done), "local_time", "call_code", "sender", "receiver", "cnt", "bytes")
    assert got == [(2.0, 22, 2, 1, 6, 24), (4.0, 18, 1, 0, 2, 8)]


def test_an_abandoned_post_takes_no_later_completion(spark):
    ddl = "run_id string, rank int, handle long, t double, call_code int, comm int, tag int, sender int, receiver int, " \
        "cnt long, type_size int, is_recv boolean, wildcard boolean"
    posted = spark.createDataFrame([("r", 1, 7, t, 22, 1, 5, -1, 1, n, 4, True, True) for t, n in ((1.0, 10), (2.0, 20), (4.0, 40))], ddl)
    done = spark.createDataFrame([("r", 1, 7, 3.0, 0, 6, False), ("r", 1, 7, 5.0, 0, -1, False)],
                                 "run_id string, rank int, handle long, t double, status_source int, status_count long, cancelled boolean")
    members = spark.createDataFrame([("r", 1, 0, 9)], "run_id string, comm int, comm_rank int, world_rank int")
    got = pairing.complete_requests(posted, done, members)
    assert rows(got, "posted_time", "local_time", "sender", "cnt") == [(2.0, 3.0, 9, 6), (4.0, 5.0, 9, 40)]


# --- rules --------------------------------------------------------------------

METRIC_DDL = "run_id string, total_ranks int, total_events long, canonical_events long, canonical_bytes long, " \
    "completion_events long, barrier_events long, collective_events long, pair_density double, pairs_observed long, " \
    "small1k_events long, small1k_ratio double, roots long, root_bytes long, top_root int, top_root_share double, " \
    "top_link_share double, top_link string, touch_cv double, top_ranks_by_touch string, completion_ratio double, " \
    "barrier_fraction double, barrier_instances long, max_barrier_spread double, avg_barrier_spread double, " \
    "rel_barrier_spread double, runtime double, late_sender_ratio double, late_sender_count long, late_sender_time double, " \
    "late_receiver_ratio double, late_receiver_count long, late_receiver_time double, late_broadcaster_ratio double, " \
    "late_broadcaster_count long, late_broadcaster_time double, early_reduce_ratio double, early_reduce_count long, " \
    "early_reduce_time double"
QUIET = dict(run_id="r", total_ranks=16, total_events=1000, canonical_events=100, canonical_bytes=1000,
             collective_events=100, root_bytes=10, roots=1, barrier_events=1, completion_events=1, runtime=1.0,
             barrier_instances=1, pair_density=0.3)
EDGES = [
    ("dense-communication", "pair_density", 0.5, 0.4999), ("sparse-communication", "pair_density", 0.1, 0.1001),
    ("small-message-dominated", "small1k_ratio", 0.5, 0.4999), ("root-concentrated-collectives", "top_root_share", 0.5, 0.4999),
    ("dominant-link", "top_link_share", 0.2, 0.1999), ("rank-communication-imbalance", "touch_cv", 1.0, 0.9999),
    ("completion-heavy", "completion_ratio", 0.5, 0.4999), ("barrier-heavy", "barrier_fraction", 0.05, 0.0499),
    ("late_sender", "late_sender_ratio", 0.0501, 0.05), ("late_receiver", "late_receiver_ratio", 0.0501, 0.05),
    ("late_broadcaster", "late_broadcaster_ratio", 0.0501, 0.05), ("early_reduce_arrival", "early_reduce_ratio", 0.0501, 0.05),
    ("small_message_pressure", "small1k_ratio", 0.6, 0.5999), ("rank_traffic_imbalance", "touch_cv", 1.2, 1.1999),
    ("collective_root_bottleneck", "top_root_share", 0.7, 0.6999), ("completion_overhead", "completion_ratio", 1.0, 0.9999),
    ("link_hotspot", "top_link_share", 0.35, 0.3499),
]


def test_rule_thresholds(spark):
    fields = [f.split()[0] for f in METRIC_DDL.split(", ")]
    kinds = {f.split()[0]: f.split()[1] for f in METRIC_DDL.split(", ")}

    def row(i, **values):
        full = {**{k: (None if kinds[k] == "string" else 0.0 if kinds[k] == "double" else 0) for k in fields}, **QUIET,
                **values, "run_id": str(i)}
        return tuple(full[k] for k in fields)

    data = [row(2 * i + j, **{e[1]: e[2 + j]}) for i, e in enumerate(EDGES) for j in (0, 1)]
    data.append(row(100, max_barrier_spread=0.01, rel_barrier_spread=0.01))
    data.append(row(101, max_barrier_spread=0.0099, rel_barrier_spread=0.0099))
    m = spark.createDataFrame(data, METRIC_DDL).cache()
    fired = {(r.run_id, r.type) for df in (rules.patterns(m), rules.issues(m)) for r in df.collect()}
    for i, (kind, *_rest) in enumerate(EDGES):
        assert (str(2 * i), kind) in fired and (str(2 * i + 1), kind) not in fired, kind
    assert ("100", "barrier_arrival_skew") in fired and ("101", "barrier_arrival_skew") not in fired
    top = rules.issues(m).filter("type = 'link_hotspot'").first()
    assert (top.severity, top.score) == ("warning", 0.7) and '"top_link":null' in top.metrics


# --- frames -------------------------------------------------------------------

def test_newest_active_keeps_800_in_order(spark):
    ev = events(spark, [(0, 1 + i / 100000, i, 13, 0, 1, 1, 1) for i in range(900)])
    got = phases.active_events(ev, 1.05, k=800).orderBy("position").collect()
    assert [r.event_id for r in got] == list(range(100, 900))


def test_rank_highlights_restart_reasons(spark):
    roots = spark.createDataFrame([("r", 1, 4), ("r", 2, 5)], "run_id string, position int, root int")
    touch = spark.createDataFrame([("r", 1, 5), ("r", 2, 9)], "run_id string, position int, rank int")
    issues = spark.createDataFrame([("r", 1, "late", "warning", [9, 9])],
                                   "run_id string, position int, type string, severity string, ranks array<int>")
    got = rows(frames.rank_highlights(roots, touch, issues), "rank", "kind", "priority", "reasons")
    assert got == [(4, "root", 120, ["collective_root"]), (5, "root", 120, ["collective_root", "top_rank"]),
                   (9, "issue", 300, ["late", "late", "top_rank"])]


# --- golden traces ------------------------------------------------------------

def test_collectives_case(spark):
    """Four ranks: Bcast from 2, Reduce to 1, Gather to 3, Scatter from 0, Allgather."""
    one_sided = [(r, 1, 1, 27, 2, r, 3, 12) for r in range(4)] + [(r, 2, 2, 28, r, 1, 5, 20) for r in range(4)]
    ev = events(spark, [(r, 0, 0, 39, r, r) for r in range(4)] + one_sided + [(r, 9, 9, 40, r, r) for r in range(4)])
    large = spark.createDataFrame(
        [("r", r, r, 10 + k, 3.0 + k, 3 + k, code, 0, parts) for r in range(4) for k, (code, parts) in enumerate((
            (30, [(1, r, 3, 2, 8, 0), (2, 3, 3, 8 if r == 3 else 0, 32 if r == 3 else 0, 0)]),
            (31, [(1, 0, 0, 28 if r == 0 else 0, 112 if r == 0 else 0, 0), (2, 0, r, 7, 28, 0)]),
            (32, [(1, r, r, 1, 4, 0), (2, r, r, 4, 16, 0)])))], S.LARGE)
    both = ev.unionByName(timeline.large_to_events(large))
    rn = runs(spark, 4)
    assert quality.aggregate_mismatch(both, rn).count() == 0
    assert quality.aggregate_mismatch(both, runs(spark, 5)).count() > 0
    assert quality.tagged_collectives(both).count() == 0
    assert quality.mixed_comm(both, ["rank_recording"]).count() == 0
    assert quality.broken_bookends(both, rn).count() == 0
    assert quality.expect_rows(both, [
        {"n": 4, "call_code": 27, "sender": 2, "cnt": 3, "bytes": 12},
        {"n": 1, "call_code": 30, "part": 2, "bytes": 32}, {"n": 3, "call_code": 30, "synthetic_empty": True}]).count() == 0
    assert one(traffic.trace_totals(both))["collective_events"] == 8 + 24
    roots = {r.root: r.bytes for r in traffic.collective_roots(both).collect()}
    assert roots == {2: 36, 1: 60, 3: 24, 0: 84}


def test_cancelled_request_leaves_only_its_wait(spark):
    ev = events(spark, [(1, 2, 5, 24, 1, 1, 1, 0), (0, 3, 1, 26, 0, 0), (1, 3, 6, 26, 1, 1)])
    cancelled = spark.createDataFrame([("r", 1, 22, 0, 1, 0, 5)],
                                      "run_id string, rank int, call_code int, sender int, receiver int, tag int, wait_id long")
    assert quality.cancelled_leftovers(ev, cancelled).count() == 0
    extra = ev.unionByName(events(spark, [(1, 1, 4, 22, 0, 1, 1, 4)]))
    assert rows(quality.cancelled_leftovers(extra, cancelled), "problem") == [("transfer row present",)]
    assert rows(quality.cancelled_leftovers(ev.filter("call_code <> 24"), cancelled), "problem") == [("wait row missing",)]


def test_numbers_carry_over_pieces(spark):
    """Keys that fill several pieces, end inside one, or hold nulls are numbered as one window would."""
    keys = [("a", i) for i in range(900)] + [("b", i) for i in range(3)] + [(None, i) for i in range(500)] + [("c", 7)] * 40 + [("d", i) for i in range(1, 700)]
    df = spark.createDataFrame([(k, i % 2, i, n) for n, (k, i) in enumerate(keys)], "k string, side int, at int, id int").repartition(9)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    got = ordinal.number_rows(df, ["k"], within=["side"], order=[F.col("at"), F.col("id")])
    pieces = ordinal.ranged(df, ["k", "side"], [F.col("at"), F.col("id")]).select("_piece").distinct().count()
    found = {r.id: r.ordinal for r in got.collect()}
    spark.conf.unset(setting)
    want, seen = {}, {}
    for k, side, at, n in sorted(((k, i % 2, i, n) for n, (k, i) in enumerate(keys)), key=lambda r: (r[0] or "", r[1], r[2], r[3])):
        want[n] = seen[k, side] = seen.get((k, side), -1) + 1
    assert found == want and pieces > 4
    assert ordinal.number_rows(df.limit(0), ["k"], order=[F.col("at")]).count() == 0


def test_all_kinds_numbered_at_once_equal_each_alone(spark, sf_dir):
    ev = derive_trace(spark, sf_dir)
    turns = pairing.calls_in_turn(ev)
    assert rows(pairing.pair_p2p(ev, turns=turns), "comm", "sender", "receiver", "tag", "ordinal") == rows(pairing.pair_p2p(ev), "comm", "sender", "receiver", "tag", "ordinal")
    assert rows(pairing.pair_bcast(ev, turns), "comm", "root", "ordinal", "local", "diff") == rows(pairing.pair_bcast(ev), "comm", "root", "ordinal", "local", "diff")
    assert rows(pairing.barrier_spreads(ev, derived_runs(spark), turns), "barrier_index", "spread") == rows(pairing.barrier_spreads(ev, derived_runs(spark)), "barrier_index", "spread")


def test_ranks_of_an_intercommunicator(spark):
    """Peers are ranks of the remote group, own ends of the local one; unknown, negative and unlisted ones pass through."""
    members = [("r", 5, i, 10 + i, 0) for i in range(3)] + [("r", 5, i, 20 + i, 1) for i in range(3)] + [("r", 1, 0, 7, None)]
    events = [(5, 10, 13, 0, 2), (5, 21, 14, 2, 1), (5, 21, 13, 1, 9), (5, 11, 22, -1, 1), (5, 99, 13, 0, 1), (1, 7, 13, 0, 3), (0, 4, 13, 4, 2)]
    df = spark.createDataFrame([("r", *e) for e in events], "run_id string, comm int, rank_recording int, call_code int, sender int, receiver int")
    known = spark.createDataFrame(members, "run_id string, comm int, comm_rank int, world_rank int, side int")
    got = rows(pairing.translate_ranks(df, known), "comm", "rank_recording", "sender", "receiver")
    assert got == sorted([(5, 10, 10, 22), (5, 21, 12, 21), (5, 21, 21, 9), (5, 11, -1, 11), (5, 99, 0, 1), (1, 7, 7, 3), (0, 4, 4, 2)], key=str)


def test_tables_on_the_way_are_removed(spark, tmp_path):
    from rankscope.session import scratch, temporary_tables
    with temporary_tables(spark):
        path = scratch(spark, "gone")
        spark.range(3).write.parquet(path)
        with temporary_tables(spark):
            inner = scratch(spark, "inner")
            spark.range(3).write.parquet(inner)
        with pytest.raises(Exception):
            spark.read.parquet(inner)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path)
