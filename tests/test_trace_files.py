"""Trace files: both versions, compression, damage and splitting."""

import gzip

import pytest

from pyspark.sql import functions as F

from rankscope import schema as S
from rankscope.operators import quality, timeline
from rankscope.sources import trace_files as TF, trace_layout as L
from tests.traces import ANCHOR_NS, bookended, header, large, rows, section, small, write


def two_ranks():
    send = small(1.0, 1, 13, 0, 1, 1, 4, tag=5)
    recv = small(1.001, 1, 14, 0, 1, 1, 4, tag=5)
    x0 = large(2.0, 2, 23, (0, 1, 1, 4, 7), (1, 0, 1, 4, 8))
    x1 = large(2.0, 2, 23, (1, 0, 1, 4, 8), (0, 1, 1, 4, 7))
    return [bookended(0, [send], [x0]), bookended(1, [recv], [x1])]


@pytest.fixture
def good(tmp_path):
    (tmp_path / "t").mkdir()
    write(tmp_path / "t" / "a.trace", header(2), *two_ranks())
    write(tmp_path / "t" / "b.trace.gz", header(2), *two_ranks(), packed=True)
    write(tmp_path / "t" / "c.trace", header(2, version=1, program=b""), *two_ranks(), b"\0" * 100)
    return str(tmp_path / "t")


def test_headers(spark, good):
    got = rows(TF.read_runs(spark, good), "run_id", "total_ranks", "program", "file_format", "file_format_version",
               "time_registration", "system_name")
    assert got == [
        ("a.trace", 2, "prog", "MPICv002", 2, "per-rank-unix-anchor", "Unknown Cluster"),
        ("b.trace.gz", 2, "prog", "MPICv002", 2, "per-rank-unix-anchor", "Unknown Cluster"),
        ("c.trace", 2, "unknown", "legacy-v1", 1, "legacy-local-time", "Unknown Cluster")]
    assert rows(TF.read_processes(spark, good).filter("run_id = 'a.trace'"), "rank", "pid", "hostname") == [
        (0, 100, "node000"), (1, 101, "node001")]
    assert rows(TF.read_anchors(spark, good), "run_id", "rank", "unix_time_zero_ns") == [
        (r, k, ANCHOR_NS + k) for r in ("a.trace", "b.trace.gz") for k in (0, 1)]


def test_records_and_timeline(spark, good):
    small_rows = TF.read_small(spark, good)
    assert small_rows.count() == 18
    assert rows(small_rows.filter("run_id = 'b.trace.gz' and call_code = 13"), "rank_recording", "rec_pos",
                "local_time", "sender", "receiver", "cnt", "bytes", "tag") == [(0, 1, 1.0, 0, 1, 1, 4, 5)]
    parts = TF.read_large(spark, good).filter("run_id = 'a.trace' and rank_recording = 1").first().parts
    assert [(p.part, p.sender, p.receiver, p.tag) for p in parts] == [(1, 1, 0, 8), (2, 0, 1, 7)]
    ev = TF.read_trace(spark, good)
    assert ev.columns == S.EVENT_COLUMNS
    aligned = ev.filter("run_id = 'a.trace' and call_code = 14").first()
    assert aligned.epoch_ns == ANCHOR_NS + 1 + 1_001_000_000
    assert aligned.time == pytest.approx(1.001000001)
    assert ev.filter("run_id = 'c.trace' and epoch_ns is not null").count() == 0
    runs = TF.read_runs(spark, good)
    assert quality.broken_bookends(ev, runs).count() == 0
    assert quality.bad_anchors(TF.read_anchors(spark, good), runs).count() == 0
    assert quality.unmirrored_sendrecv(ev).count() == 0
    meta = rows(timeline.timeline_metadata(runs, TF.read_anchors(spark, good)), "run_id", "timeline_clock",
                "timeline_origin", "timeline_origin_unix_ns")
    assert meta[0] == ("a.trace", "global-epoch-registered", "minimum-rank-anchor", ANCHOR_NS)
    assert meta[2] == ("c.trace", "local-relative", "as-recorded", None)


def test_record_ranges_cover_sections_once(spark, tmp_path, monkeypatch):
    many = [small(i / 100, i, 13, 0, 1, 1, i) for i in range(1000)]
    path = write(tmp_path / "m.trace", header(2), section(0, many), section(1, many[:7]))
    monkeypatch.setattr(TF, "RANGE_RECORDS", 64)
    got = TF.read_small(spark, path)
    assert got.groupBy("rank_recording").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("b"), F.count_distinct("rec_pos").alias("d")) \
        .orderBy("rank_recording").collect() == [(0, 1000, 499500, 1000), (1, 7, 21, 7)]
    assert got.filter("rec_pos <> event_id").count() == 0


def test_anchor_slots(spark, tmp_path):
    path = write(tmp_path / "x.trace", header(3, anchors=[(1, 10), (99, 20), (1, 30)]),
                 *[bookended(r, []) for r in range(3)])
    assert rows(TF.read_anchors(spark, path), "rank", "unix_time_zero_ns") == [(1, 30)]
    path = write(tmp_path / "y.trace", header(3, anchors=[(2, 10), (-5, 20), (0, 30)]),
                 *[bookended(r, []) for r in range(3)])
    assert rows(TF.read_anchors(spark, path), "rank", "unix_time_zero_ns") == [(0, 30), (1, 20), (2, 10)]


DAMAGE = {
    "cut": lambda s: (s[0] + s[1][:-10], 1, "partial"),
    "garbage between": lambda s: (s[0] + b"\x01junk" * 3 + s[1], 2, "recovered"),
    "rank twice": lambda s: (s[0] + s[0] + s[1] + b"\x07", 2, "recovered"),
    "non-zero trailer": lambda s: (s[0] + s[1] + b"\0\0x", 2, "recovered"),
    "nothing valid": lambda s: (b"\x01" * 300, 0, "unreadable"),
}


@pytest.mark.parametrize("kind", DAMAGE)
def test_salvage(spark, tmp_path, kind):
    body, recovered, status = DAMAGE[kind](two_ranks())
    path = write(tmp_path / "d.trace", header(2), body)
    report = TF.salvage_report(spark, path).first()
    assert (report.sections_recovered, report.sections_expected, report.status) == (recovered, 2, status)
    assert TF.read_sections(spark, path, on_unreadable="report").count() == recovered
    assert TF.read_small(spark, path, on_unreadable="report").count() == 3 * recovered
    if recovered:
        assert TF.read_small(spark, path).count() == 3 * recovered
    else:
        with pytest.raises(Exception, match="nothing can be recovered"):
            TF.read_small(spark, path).count()
    with pytest.raises(Exception):
        TF.read_small(spark, path, "FAILFAST").count()


def test_salvage_in_small_byte_ranges_equals_one_scan(spark, tmp_path, monkeypatch):
    body = b"".join(section(r, [small(0.0, i, 13, r, 0, 1, 4) for i in range(r % 7)]) + b"??" * r for r in range(40))
    path = write(tmp_path / "s.trace", header(40), body)
    whole = rows(TF.read_sections(spark, path), "rank", "small_offset", "n_small", "section_pos")
    assert len(whole) == 40
    monkeypatch.setattr(TF, "SCAN_BYTES", 37)
    assert rows(TF.read_sections(spark, path), "rank", "small_offset", "n_small", "section_pos") == whole


def test_salvage_matches_scan_by_byte(tmp_path):
    """Label search and greedy choice against trying every offset in turn."""
    body = b"\x05" * 3 + section(3, [small(0, 1, 13, 0, 1)]) + section(3, []) + b"P2P Small Type Messages" \
        + section(-2, []) + section(4, [small(0, 1, 13, 0, 1)] * 3)[:-5]
    path = write(tmp_path / "b.trace", body)
    with L.open_trace(path) as (f, _):
        end = len(body)
        found = L.choose_sections(list(L.find_candidates(f, 0, 0, end, end)))
        expected, at, seen = [], 0, set()
        while at + 32 <= end:
            c = L.candidate_at(f, at, end)
            if c and c["rank"] not in seen:
                seen.add(c["rank"])
                expected.append(c["rank"])
                at = c["stop"]
            else:
                at += 1
    assert [c["rank"] for c in found] == expected == [3, -2]


@pytest.mark.parametrize("head", [b"MPICv002\x03\0\0\0\0\0\0\0", b"MPICv002\x02\0\0\0\xff\xff\xff\xff", b"\xff\xff\xff\xff"])
def test_bad_header_is_an_error(spark, tmp_path, head):
    path = write(tmp_path / "h.trace", head, b"\0" * 2000)
    with pytest.raises(Exception):
        TF.read_runs(spark, path).collect()


def test_a_bad_header_does_not_hide_other_files(spark, tmp_path):
    write(tmp_path / "bad.trace", b"MPICv002\x03\0\0\0\0\0\0\0", b"\0" * 2000)
    write(tmp_path / "good.trace", header(2), *two_ranks())
    path = str(tmp_path)
    assert rows(TF.salvage_report(spark, path), "run_id", "status") == [("bad.trace", "unreadable")]
    assert TF.read_runs(spark, path, "PERMISSIVE").count() == 1
    assert TF.read_small(spark, path, on_unreadable="report").count() == 6
    with pytest.raises(Exception, match="nothing can be recovered"):
        TF.read_small(spark, path).count()


@pytest.mark.parametrize("kind", ["small", "large"])
def test_records_through_the_data_source(spark, tmp_path, kind):
    path = write(tmp_path / "g.trace", header(2), *two_ranks())
    TF.register(spark)
    direct = spark.read.format("trace").option("table", kind).load(path)
    by_ranges = TF.read_small(spark, path) if kind == "small" else TF.read_large(spark, path)
    assert direct.schema == by_ranges.schema and sorted(map(str, direct.collect())) == sorted(map(str, by_ranges.collect()))


# --- members of compressed files ----------------------------------------------

def packed_in_members(path, data, size):
    path.write_bytes(b"".join(gzip.compress(data[i:i + size]) for i in range(0, len(data), size)))
    return str(path)


@pytest.fixture
def long_trace():
    smalls = [[small(i / 100, i, 13, r, 0, i, 4 * i, tag=r) for i in range(3000)] for r in range(3)]
    larges = [[large(i / 7, i, 23, (r, 1, i, 4, 7), (1, r, i, 4, 8)) for i in range(500)] for r in range(3)]
    return header(3) + b"".join(section(r, smalls[r], larges[r]) for r in range(3))


def test_members_are_read_by_several_tasks(spark, tmp_path, monkeypatch, long_trace):
    monkeypatch.setattr(TF, "MEMBER_SCAN", 5000)
    monkeypatch.setattr(TF, "RANGE_RECORDS", 256)
    path, plain = packed_in_members(tmp_path / "m.gz", long_trace, 20_000), write(tmp_path / "m.trace", long_trace)
    members = TF.read_members(spark, path).orderBy("start").collect()
    assert len(members) == -(-len(long_trace) // 20_000) and members[0].start == 0
    assert [m.plain_start for m in members] == [20_000 * i for i in range(len(members))] and sum(m.plain_size for m in members) == len(long_trace)
    for read in (TF.read_small, TF.read_large):
        got, want = read(spark, path, "FAILFAST"), read(spark, plain, "FAILFAST").withColumn("run_id", F.lit("m.gz"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3


def test_one_member_stays_one_task(spark, tmp_path, long_trace):
    path = write(tmp_path / "one.gz", long_trace, packed=True)
    assert TF.read_members(spark, path).count() == 1
    got = TF.read_small(spark, path)
    assert got.count() == 9000 and got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() == 1


def test_a_gzip_file_inside_a_member_is_no_member(spark, tmp_path):
    inner = gzip.compress(b"x" * 50)
    data = b"".join(gzip.compress(part, compresslevel=0) for part in (b"a" * 100 + inner + b"b", inner, b"end"))
    (tmp_path / "n.gz").write_bytes(data)
    found = TF.read_members(spark, str(tmp_path / "n.gz")).orderBy("start").collect()
    assert [m.plain_size for m in found] == [101 + len(inner), len(inner), 3]


@pytest.mark.parametrize("cut", [10, 20_000])
def test_damaged_compressed_files_are_salvaged(spark, tmp_path, long_trace, cut):
    path = packed_in_members(tmp_path / "d.gz", long_trace[:-cut], 30_000)
    assert TF.salvage_report(spark, path).first().sections_recovered == 2
    assert TF.read_small(spark, path).count() == 6000
    with pytest.raises(Exception):
        TF.read_small(spark, path, "FAILFAST").count()


def test_an_empty_compressed_file_is_unreadable(spark, tmp_path):
    (tmp_path / "e.gz").write_bytes(b"")
    write(tmp_path / "good.trace", header(2), *two_ranks())
    assert rows(TF.salvage_report(spark, str(tmp_path)), "run_id", "status") == [("e.gz", "unreadable")]


# --- salvage of many labels ---------------------------------------------------

def test_many_false_labels(spark, tmp_path, monkeypatch):
    """Labels that do not fit are passed over; labels that fit inside a kept section are no sections."""
    monkeypatch.setattr(TF, "SCAN_BYTES", 1 << 20)
    fake = section(7, [])
    inside = (fake * 100_000)[:-(len(fake) * 200_000 % 40) or None]
    label = b"P2P Small Type Messages\0" + b"\xff\xff\xff\x7f"
    first = section(0, [inside[i:i + 40] for i in range(0, len(inside), 40)])
    path = write(tmp_path / "f.trace", header(2), b"\x01" + first + label * 200_000 + section(1, [small(0, 1, 13, 1, 0)]))
    found = TF.read_sections(spark, path).orderBy("section_pos").collect()
    assert [(s.rank, s.section_pos, s.n_small) for s in found] == [(0, 0, len(inside) // 40), (1, 1, 1)]


# --- writing ------------------------------------------------------------------

def tables_of(spark, path):
    anchors = TF._load(spark, path, "anchors").drop("total_ranks")
    return {"runs": TF.read_runs(spark, path), "processes": TF.read_processes(spark, path), "anchors": anchors,
            "small": TF.read_small(spark, path), "large": TF.read_large(spark, path)}


@pytest.mark.parametrize("options", [{}, {"compressed": True, "member_bytes": 700}])
def test_written_files_are_the_files_read(spark, tmp_path, good, options):
    (tmp_path / "t" / "b.trace.gz").unlink()
    out = tmp_path / "out"
    TF.write_trace(path=str(out), **tables_of(spark, good), **options)
    names = sorted(p.name for p in out.iterdir())
    assert names == ([f"{n}.trace.gz" for n in "ac"] if options else ["a.trace", "c.trace"])
    for name in names:
        data = (out / name).read_bytes()
        want = (tmp_path / "t" / name.removesuffix(".gz")).read_bytes()
        plain = gzip.decompress(data) if options else data
        assert plain == (want if name.startswith("a") else want[:68] + b"unknown" + want[75:-100])
    assert not options or TF.read_members(spark, str(out)).count() > 4


def test_ranks_without_records_get_empty_sections(spark, tmp_path, good):
    tables = tables_of(spark, f"{good}/a.trace")
    tables["small"] = tables["small"].filter("rank_recording = 1")
    tables["large"] = tables["large"].limit(0)
    TF.write_trace(path=str(tmp_path / "out"), **tables)
    assert rows(TF.read_sections(spark, str(tmp_path / "out"), "FAILFAST"), "rank", "n_small", "n_large") == [(0, 0, 0), (1, 3, 0)]


WRONG = {
    "a rank too many": lambda t: t | {"small": t["small"].withColumn("rank_recording", F.col("rank_recording") + 1)},
    "no process of a rank": lambda t: t | {"processes": t["processes"].filter("rank = 0")},
    "an anchor too many": lambda t: t | {"anchors": t["anchors"].unionByName(t["anchors"])},
    "records without a run": lambda t: t | {"runs": t["runs"].limit(0)},
    "two rows of a run": lambda t: t | {"runs": t["runs"].unionByName(t["runs"])},
    "bytes beyond 32 bits": lambda t: t | {"small": t["small"].withColumn("bytes", F.lit(1 << 40))},
    "a name too long": lambda t: t | {"runs": t["runs"].withColumn("program", F.lit("x" * 1024))},
    "a null": lambda t: t | {"small": t["small"].withColumn("tag", F.when(F.col("event_id") == 1, F.col("tag")))},
    "a hidden name": lambda t: {k: v.withColumn("run_id", F.lit(".a")) for k, v in t.items()},
}


@pytest.mark.parametrize("what", WRONG)
def test_what_the_format_cannot_hold_leaves_no_file(spark, tmp_path, good, what):
    out = tmp_path / "out"
    with pytest.raises(Exception):
        TF.write_trace(path=str(out), **WRONG[what](tables_of(spark, f"{good}/a.trace")))
    assert not out.exists() or not list(out.iterdir())
