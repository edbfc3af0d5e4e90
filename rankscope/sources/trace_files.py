"""Trace files as DataFrames.

The data source ``trace`` reads what one look at each file gives: run metadata, process and
anchor tables and the index of rank sections. Records are then read from the index: sections are
cut into record ranges, ranges are spread over tasks, and every task decodes its ranges into
Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankscope import schema as S
from rankscope.operators import timeline
from rankscope.session import written
from rankscope.sources import trace_layout as L
from rankscope.sources.trace_writer import ROWS, TraceWriter, write_trace as _write_trace

RANGE_RECORDS = 1 << 20
SCAN_BYTES = 1 << 28
MEMBER_SCAN = 1 << 26  # bytes of a compressed file that one task searches for members
TASK_BYTES = 1 << 27
BATCH_RECORDS = 1 << 16
# Tasks of a pass over records by file; a task takes several files where there are more. A pass over headers and tables reads little of a
# file, so there a task takes up to INDEX_FILES.
MAX_INDEX_TASKS = 4096
INDEX_FILES = 64
PACKED = "read by its members"  # stands for the problem of a compressed file that a pass over plain ones has met

SECTIONS = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("compressed", T.BooleanType()), T.StructField("total_ranks", T.IntegerType()),
    T.StructField("problem", T.StringType()), T.StructField("first_byte", T.LongType()),
    T.StructField("end_byte", T.LongType()),
    T.StructField("section_pos", T.IntegerType()), T.StructField("rank", T.IntegerType()),
    T.StructField("small_offset", T.LongType()), T.StructField("n_small", T.LongType()),
    T.StructField("large_offset", T.LongType()), T.StructField("n_large", T.LongType()),
])
FILES = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("compressed", T.BooleanType())])
TABLES = {"files": FILES, "small": S.SMALL, "large": S.LARGE, "runs": S.RUNS, "processes": S.PROCESSES, "anchors": S.ANCHOR_ROWS, "sections": SECTIONS}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class TraceSource(DataSource):
    """``spark.read.format("trace").option("table", ...)`` with one task per group of files."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> T.StructType:
        return TABLES[self.options.get("table", "runs")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TraceReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> TraceWriter:
        """Files from rows in the layout and order of ``trace_writer.trace_rows``."""
        if overwrite:
            raise ValueError("trace files are added to a folder; choose another path instead of overwriting")
        if schema.names != ROWS.names:
            raise ValueError(f"a trace file is written from the columns {ROWS.names}")
        return TraceWriter(self.options)


class TraceReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.table = options.get("table", "runs")
        self.failfast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.packed_too = options.get("packed", "true").lower() == "true"
        self.least_tasks = int(options.get("leastTasks", MAX_INDEX_TASKS))

    def partitions(self) -> list[Files]:
        files = L.list_files(self.path)
        most = MAX_INDEX_TASKS if self.table in L.RECORDS else max(self.least_tasks, -(-len(files) // INDEX_FILES))
        n = min(len(files), most) or 1
        return [Files(files[i::n]) for i in range(n)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for run_id, path, size in partition.files:
            with L.open_trace(path) as (f, packed):
                if self.table == "files":
                    yield (run_id, path, size, packed)
                    continue
                if packed and not self.packed_too:
                    yield (run_id, path, packed, 0, PACKED, 0, size, *[None] * 6)
                    continue
                try:
                    header = L.read_header(f)
                except L.TraceError as e:
                    if self.failfast:
                        raise
                    if self.table == "sections":
                        yield (run_id, path, packed, 0, f"header: {e}", *[None] * 8)
                    continue
                yield from getattr(self, "_" + self.table)(run_id, path, f, packed, header)

    def _runs(self, run_id, path, f, packed, header):
        yield (run_id, *[header[c] for c in S.RUNS.names[1:]])

    def _processes(self, run_id, path, f, packed, header):
        for block in L.read_table(f, header["processes"], header["total_ranks"], L.PROCESS, "process table", 1024):
            for r in block:
                yield (run_id, *[int(r[c]) for c in ("rank", "pid", "core", "chip")], L.text(r["hostname"]))

    def _anchors(self, run_id, path, f, packed, header):
        if header["file_format_version"] < 2:
            return
        pos = 0
        for block in L.read_table(f, header["anchors"], header["total_ranks"], L.ANCHOR, "anchor table"):
            for r in block:
                yield (run_id, pos, header["total_ranks"], int(r["rank"]), float(r["mpi_time_zero"]),
                       int(r["unix_time_zero_ns"]))
                pos += 1

    def _sections(self, run_id, path, f, packed, header):
        yield from section_rows(run_id, path, f, packed, header, self.failfast)

    def _small(self, run_id, path, f, packed, header):
        yield from self._records("small", run_id, f, header)

    def _large(self, run_id, path, f, packed, header):
        yield from self._records("large", run_id, f, header)

    def _records(self, kind, run_id, f, header):
        """Records of an intact file, one task per file; ``read_small`` and ``read_large`` cut files and recover damaged ones."""
        for s in list(L.walk_sections(f, header)):
            r = {"run_id": run_id, "rank": s["rank"], "section_pos": s["section_pos"], "first": 0,
                 "offset": s[f"{kind}_offset"], "n": s[f"n_{kind}"]}
            yield from _decode_range(f, r, kind)


def section_rows(run_id, path, f, packed, header, failfast: bool) -> Iterator[tuple]:
    """All sections of an intact file, or a single row that tells what is wrong with it."""
    lead = (run_id, path, packed, header["total_ranks"])
    try:
        found = list(L.walk_sections(f, header))
    except L.TraceError as e:
        if failfast:
            raise
        yield (*lead, str(e), header["sections"], L.file_size(f), *[None] * 6)
        return
    for s in found:
        yield (*lead, None, None, None, *[s[c] for c in SECTIONS.names[7:]])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)


def write_trace(runs: DataFrame, processes: DataFrame, anchors: DataFrame, small: DataFrame, large: DataFrame, path: str, **options) -> None:
    """One trace file per run; see ``trace_writer.write_trace``."""
    register(runs.sparkSession)
    _write_trace(runs, processes, anchors, small, large, path, **options)


def _load(spark: SparkSession, path: str, table: str, mode: str = "PERMISSIVE", packed: bool = True) -> DataFrame:
    register(spark)
    return (spark.read.format("trace").option("table", table).option("mode", mode).option("packed", str(packed).lower())
            .option("leastTasks", spark.sparkContext.defaultParallelism).load(path))


def read_runs(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Metadata of every file. A damaged header is an error; ``PERMISSIVE`` leaves the file to ``salvage_report``."""
    return _load(spark, path, "runs", mode)


def read_processes(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return _load(spark, path, "processes", mode)


def read_anchors(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """One anchor per slot: the rank it names, or its place in the file when that is no rank."""
    rank = F.col("rank")
    slot = F.when((rank >= 0) & (rank < F.col("total_ranks")), rank).otherwise(F.col("pos"))
    last = F.max_by(F.struct("mpi_time_zero", "unix_time_zero_ns"), "pos")
    return (_load(spark, path, "anchors", mode).groupBy("run_id", slot.alias("rank")).agg(last.alias("a"))
            .select("run_id", "rank", "a.mpi_time_zero", "a.unix_time_zero_ns"))


# --- section index ------------------------------------------------------------

CANDIDATE = "run_id string, path string, compressed boolean, total_ranks int, rank int, start long, " \
            "stop long, small_offset long, n_small long, large_offset long, n_large long"
INDEX_DDL = ("run_id string, path string, compressed boolean, total_ranks int, section_pos int, rank int, "
             "small_offset long, n_small long, large_offset long, n_large long")
INDEX_COLUMNS = ["run_id", "path", "compressed", "total_ranks", "section_pos", "rank",
                 "small_offset", "n_small", "large_offset", "n_large"]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            with L.open_trace(r.path) as (f, _):
                rows = [{"run_id": r.run_id, "path": r.path, "compressed": r.compressed,
                         "total_ranks": r.total_ranks, **c}
                        for c in L.find_candidates(f, r.first_byte, r.low, r.high, r.end_byte)]
            if rows:
                yield pd.DataFrame(rows)


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _thinned(chain: type, ddl: str):
    """Rows of each file that its chain takes; rows come sorted by file and place, and only the chain's state is held."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            kept = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, state = r["path"], chain()
                if row := state.take(r):
                    kept.append({c: row[c] for c in schema.names})
            if kept:
                yield pa.RecordBatch.from_pylist(kept, schema=schema)
    return run


def _in_file_order(found: DataFrame, tasks: int) -> DataFrame:
    return found.repartition(tasks, "path").sortWithinPartitions("path", "start")


def _salvaged(index: DataFrame, tasks: int) -> DataFrame:
    """Sections found in damaged files: byte ranges are searched in parallel for labels, then each file's candidates,
    which hold no records, pass through one task in file order that carries the end of the last section and the ranks met."""
    broken = index.filter("problem is not null and end_byte > first_byte")
    step = F.when(F.col("compressed"), F.col("end_byte")).otherwise(F.lit(SCAN_BYTES))
    ranges = broken.select(
        "run_id", "path", "compressed", "total_ranks", "first_byte", "end_byte", step.alias("step"),
        F.explode(F.sequence(F.col("first_byte"), F.col("end_byte") - 1, step)).alias("low")) \
        .withColumn("high", F.least(F.col("low") + F.col("step"), F.col("end_byte")))
    found = ranges.repartition(tasks, "path", "low").mapInPandas(_scan, CANDIDATE)
    return _in_file_order(found, tasks).mapInArrow(_thinned(L.SectionChain, INDEX_DDL), INDEX_DDL)


def _tasks(spark: SparkSession, path: str) -> int:
    total = sum(size for _, _, size in L.list_files(path))
    return max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


FOUND_MEMBERS = "run_id string, path string, start long, stop long, plain_size long"
MEMBERS = FOUND_MEMBERS + ", plain_start long"


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of compressed files: ``run_id``, ``path``, ``start`` and ``stop`` in the file, ``plain_start`` and ``plain_size`` of the trace bytes they hold.

    Byte ranges are searched in parallel and every member is unpacked once, by the task of the range it starts in. A file of a single
    member is one task's work, as it can only be unpacked from its start.
    """
    return _members(_load(spark, path, "files").filter("compressed"), _tasks(spark, path))


def _members(files: DataFrame, tasks: int) -> DataFrame:
    ranges = files.filter("size > 0").select("run_id", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(MEMBER_SCAN).cast("long"))).alias("low")) \
        .withColumn("high", F.least(F.col("low") + MEMBER_SCAN, "size"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where, name = L.locate(r["path"])
                with where.open_input_file(name) as raw:
                    found = [{"run_id": r["run_id"], "path": r["path"], **m} for m in L.find_members(raw, r["low"], r["high"], r["size"])]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_arrow(FOUND_MEMBERS))

    found = ranges.repartition(tasks, "path", "low").mapInArrow(search, FOUND_MEMBERS)
    return _in_file_order(found, tasks).mapInArrow(_thinned(L.MemberChain, MEMBERS), MEMBERS)


def _walk_members(failfast: bool):
    """The section index of compressed files; members between two section heads are not unpacked."""
    schema = _arrow(", ".join(f"{f.name} {f.dataType.simpleString().replace('bigint', 'long')}" for f in SECTIONS.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with L.open_trace(r["path"], [(m["start"], m["plain_start"]) for m in r["members"] or []]) as (f, packed):
                    try:
                        rows = list(section_rows(r["run_id"], r["path"], f, packed, L.read_header(f), failfast))
                    except (L.TraceError, EOFError, OSError) as e:
                        if failfast:
                            raise
                        rows = [(r["run_id"], r["path"], packed, 0, f"header: {e}", *[None] * 8)]
                yield pa.RecordBatch.from_pylist([dict(zip(SECTIONS.names, row)) for row in rows], schema=schema)
    return run


def _index(spark: SparkSession, path: str, tasks: int, mode: str = "PERMISSIVE") -> tuple[DataFrame, DataFrame | None]:
    """Sections of intact files and the problems of others, plain files by one look each, compressed ones by their members; and those
    members, None where no file is compressed. All are written down, so that every file is looked at once, whatever is read of them."""
    met = written(_load(spark, path, "sections", mode, packed=False), "index")
    is_packed = F.coalesce(F.col("problem") == PACKED, F.lit(False))
    plain, packed = met.filter(~is_packed), met.filter(is_packed).select("run_id", "path", F.col("end_byte").alias("size"))
    if packed.isEmpty():
        return plain, None
    members = written(_members(packed, tasks), "members")
    held = members.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "plain_start"))).alias("members"))
    walked = packed.join(held, "path", "left").select("run_id", "path", "members").mapInArrow(_walk_members(mode.upper() == "FAILFAST"), SECTIONS)
    return plain.unionByName(written(walked, "index")), members


def read_sections(spark: SparkSession, path: str, mode: str = "PERMISSIVE", on_unreadable: str = "raise") -> DataFrame:
    """Index of the rank sections of every file; damaged files give what can be recovered.

    A file of which nothing can be recovered is an error; with ``on_unreadable="report"`` it gives no rows and stands in
    ``salvage_report``, as partly recovered files do. ``FAILFAST`` raises on the first damaged file instead.
    """
    return _sections(spark, path, _tasks(spark, path), mode, on_unreadable)[0]


def _sections(spark: SparkSession, path: str, tasks: int, mode: str, on_unreadable: str) -> tuple[DataFrame, DataFrame | None]:
    """``read_sections``, and the members of compressed files."""
    index, members = _index(spark, path, tasks, mode)
    intact = index.filter("problem is null").select(*INDEX_COLUMNS)
    if mode.upper() == "FAILFAST":
        return intact, members
    found = _salvaged(index, tasks).select(*INDEX_COLUMNS)
    out = intact.unionByName(found)
    if on_unreadable == "report":
        return out, members
    # The error depends on the join, so no filter can be evaluated ahead of it; whichever column a query looks at first raises it.
    met = found.groupBy(F.col("path").alias("met_path")).agg(F.count(F.lit(1)).alias("met"))
    fail = F.when(F.col("met").isNull(), F.raise_error(F.concat(F.lit("nothing can be recovered from "), "path", F.lit(": "), "problem")))
    lost = index.filter("problem is not null").join(met, F.col("path") == F.col("met_path"), "left").filter("met is null") \
                .select(*[fail.cast(found.schema[c].dataType).alias(c) for c in INDEX_COLUMNS]).filter("path is not null")
    return out.unionByName(lost), members


def salvage_report(spark: SparkSession, path: str) -> DataFrame:
    """Damaged files, what was wrong, and how many of their sections were recovered.

    A file without any valid section is unreadable.
    """
    tasks = _tasks(spark, path)
    index = _index(spark, path, tasks)[0].filter("problem is not null")
    found = _salvaged(index, tasks).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sections_recovered"))
    out = index.select("run_id", "problem", F.col("total_ranks").alias("sections_expected")) \
        .join(found, "run_id", "left").fillna(0, ["sections_recovered"])
    n = F.col("sections_recovered")
    return out.withColumn("status", F.when(n == 0, "unreadable")
                          .when(n < F.col("sections_expected"), "partial").otherwise("recovered"))


# --- records ------------------------------------------------------------------

def _ranges(sections: DataFrame, members: DataFrame | None, kind: str, tasks: int) -> DataFrame:
    """Record ranges of bounded size. A range of a compressed file knows the member it begins in; ranges of one member share a task."""
    n = F.col(f"n_{kind}")
    cut = sections.filter(n > 0).select(
        "run_id", "path", "compressed", "section_pos", "rank", F.col(f"{kind}_offset").alias("offset"),
        n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(RANGE_RECORDS).cast("long")))
        .alias("first"))
    size = L.RECORDS[kind].itemsize
    cut = cut.select("run_id", "path", "compressed", "section_pos", "rank", "first",
                     (F.col("offset") + F.col("first") * size).alias("offset"),
                     F.least(F.lit(RANGE_RECORDS).cast("long"), F.col("n") - F.col("first")).alias("n"))
    plain = cut.filter("not compressed").withColumns({"member": F.lit(None).cast("long"), "plain_start": F.lit(None).cast("long")})
    if members is None:
        return _dealt(plain, tasks)
    # Members and ranges of a file in the order of their bytes; each range takes the last member before it.
    marks = members.select("path", F.col("plain_start").alias("offset"), F.struct(F.col("start").alias("member"), "plain_start").alias("last"), F.lit(0).alias("mark"))
    packed = cut.filter("compressed").withColumns({"last": F.lit(None).cast("struct<member:bigint,plain_start:bigint>"), "mark": F.lit(1)})
    before = Window.partitionBy("path").orderBy("offset", "mark").rowsBetween(Window.unboundedPreceding, 0)
    packed = packed.unionByName(marks, allowMissingColumns=True).withColumn("last", F.last("last", ignorenulls=True).over(before)) \
        .filter("mark = 1").select(*cut.columns, "last.member", "last.plain_start")
    return _dealt(plain.unionByName(packed), tasks)


def _dealt(ranges: DataFrame, tasks: int) -> DataFrame:
    spread = F.coalesce("member", "first"), F.when(F.col("member").isNull(), F.col("section_pos"))
    return ranges.repartition(tasks, "path", *spread).sortWithinPartitions("path", "offset").drop("compressed")


def _ints(a: np.ndarray, kind) -> pa.Array:
    return pa.array(np.ascontiguousarray(a), type=pa.int32()).cast(kind)


def _small_batch(a: np.ndarray, lead: list) -> pa.RecordBatch:
    cols = [pa.array(np.ascontiguousarray(a["local_time"])), _ints(a["event_id"], pa.int64())]
    cols += [_ints(a[c], pa.int32()) for c in ("call_code", "comm", "tag", "sender", "receiver")]
    cols += [_ints(a[c], pa.int64()) for c in ("cnt", "bytes")]
    return pa.RecordBatch.from_arrays(lead + cols, names=S.SMALL.names)


def _large_batch(a: np.ndarray, lead: list) -> pa.RecordBatch:
    """Both directions of a record become a two-element list, interleaved in one child array."""
    n = len(a)
    fields = []
    for f in S.PART.fields:
        if f.name == "part":
            both = np.tile(np.array([1, 2], dtype=np.int32), n)
        else:
            both = np.empty(2 * n, dtype=np.int32)
            both[0::2], both[1::2] = a[f.name + "1"], a[f.name + "2"]
        fields.append(_ints(both, pa.int64() if f.dataType == T.LongType() else pa.int32()))
    parts = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)),
                                     pa.StructArray.from_arrays(fields, names=S.PART.names))
    cols = [pa.array(np.ascontiguousarray(a["local_time"])), _ints(a["event_id"], pa.int64()),
            _ints(a["call_code"], pa.int32()), _ints(a["comm"], pa.int32()), parts]
    return pa.RecordBatch.from_arrays(lead + cols, names=S.LARGE.names)


def _decoder(kind: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (path, member, plain), rows in groupby(batch.to_pylist(), lambda r: (r["path"], r["member"], r["plain_start"])):
                with L.open_trace(path, None if member is None else [(member, plain)]) as (f, _):
                    for r in rows:
                        yield from _decode_range(f, r, kind)

    return decode


def _decode_range(f, r: dict, kind: str) -> Iterator[pa.RecordBatch]:
    done, build = 0, _small_batch if kind == "small" else _large_batch
    for a in L.read_table(f, r["offset"], r["n"], L.RECORDS[kind], f"{kind} records", BATCH_RECORDS):
        k = len(a)
        lead = [pa.array([r["run_id"]] * k, type=pa.string()),
                pa.array(np.full(k, r["rank"], dtype=np.int32)),
                pa.array(np.full(k, r["section_pos"], dtype=np.int32)),
                pa.array(np.arange(r["first"] + done, r["first"] + done + k, dtype=np.int64))]
        done += k
        yield build(a, lead)


def _read_records(spark: SparkSession, path: str, kind: str, mode: str, on_unreadable: str) -> DataFrame:
    schema = S.SMALL if kind == "small" else S.LARGE
    tasks = _tasks(spark, path)
    ranges = _ranges(*_sections(spark, path, tasks, mode, on_unreadable), kind, tasks)
    return ranges.mapInArrow(_decoder(kind), schema)


def read_small(spark: SparkSession, path: str, mode: str = "PERMISSIVE", on_unreadable: str = "raise") -> DataFrame:
    return _read_records(spark, path, "small", mode, on_unreadable)


def read_large(spark: SparkSession, path: str, mode: str = "PERMISSIVE", on_unreadable: str = "raise") -> DataFrame:
    return _read_records(spark, path, "large", mode, on_unreadable)


def read_trace(spark: SparkSession, path: str, mode: str = "PERMISSIVE", on_unreadable: str = "raise") -> DataFrame:
    """The aligned event timeline of all trace files at a path."""
    events = timeline.build_timeline(read_small(spark, path, mode, on_unreadable), read_large(spark, path, mode, on_unreadable))
    return timeline.register_time(events, read_anchors(spark, path, "FAILFAST" if on_unreadable == "raise" else "PERMISSIVE"))
