"""Trace files written from DataFrames: one file per run, encoded in tasks and put in place by the driver.

A file is a header, two tables and the records of every rank, one behind the other. ``write_trace`` brings the rows of a run into that order
in one sorted partition; the writer turns Arrow batches into packed records as they come, so a task holds one batch, however
long the run. Files get hidden names until all tasks have succeeded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from rankscope import schema as S
from rankscope.sources import trace_layout as L

MEMBER_BYTES = 16 << 20  # of a compressed file that one member holds; members can be read by tasks of their own

# Blocks of a file in their order, and the kinds of rows of a rank's section in theirs.
HEAD, PROCESS, ANCHOR, SECTION = range(4)
N_SMALL, SMALL, N_LARGE, LARGE = range(4)
INTS = [f"i{k}" for k in range(13)]
ROWS = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("pos", T.IntegerType()),
    T.StructField("kind", T.IntegerType()), T.StructField("rec_pos", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("program", T.StringType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in INTS]])
PLACE = ["run_id", "block", "pos", "kind", "rec_pos"]


def _row(block: int, **values) -> list[Column]:
    given = {"block": F.lit(block), **values}
    return [(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in ROWS.fields]


def trace_rows(runs: DataFrame, processes: DataFrame, anchors: DataFrame, small: DataFrame, large: DataFrame) -> DataFrame:
    """Everything that the files of ``runs`` hold, as rows that sort into file order.

    Sections are in rank order, one per rank of the run, empty where a rank has no records. Records keep the order of ``rec_pos``.
    """
    size = runs.select("run_id", "total_ranks", "file_format_version")
    spine = size.select("run_id", F.explode(F.sequence(F.lit(0), F.col("total_ranks") - 1)).alias("rank"), "file_format_version") \
        .filter(F.col("rank") >= 0)
    counts = {"n_small": small, "n_large": large}
    sections = spine
    for name, records in counts.items():
        n = records.groupBy("run_id", F.col("rank_recording").alias("rank")).agg(F.count(F.lit(1)).alias(name))
        sections = sections.join(n, ["run_id", "rank"], "left").fillna(0, [name])
    first, second = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    direction = ("sender", "receiver", "cnt", "bytes", "tag")
    heads = [runs.select(*_row(HEAD, run_id=F.col("run_id"), text=F.col("date"), program=F.col("program"), n=F.col("total_ranks"), i0=F.col("file_format_version"))),
             processes.select(*_row(PROCESS, run_id=F.col("run_id"), pos=F.col("rank"), rank=F.col("rank"), text=F.col("hostname"),
                                    i0=F.col("pid"), i1=F.col("core"), i2=F.col("chip"))),
             anchors.select(*_row(ANCHOR, run_id=F.col("run_id"), pos=F.col("pos"), rank=F.col("rank"), seconds=F.col("mpi_time_zero"), n=F.col("unix_time_zero_ns")))]
    place = {"run_id": F.col("run_id"), "pos": F.col("rank"), "rank": F.col("rank")}
    heads += [sections.select(*_row(SECTION, **place, kind=F.lit(kind), n=F.col(name))) for kind, name in ((N_SMALL, "n_small"), (N_LARGE, "n_large"))]
    placed = {"run_id": F.col("run_id"), "pos": F.col("rank_recording"), "rank": F.col("rank_recording"), "rec_pos": F.col("rec_pos"), "seconds": F.col("local_time")}
    records = [small.select(*_row(SECTION, **placed, kind=F.lit(SMALL), **dict(zip(INTS, map(F.col, L.SMALL.names[1:]))))),
               large.select(*_row(SECTION, **placed, kind=F.lit(LARGE), **dict(zip(INTS, [
                   F.col("event_id"), F.col("call_code"), F.col("comm"), *[p[c] for p in (first, second) for c in direction]]))))]
    out = heads[0]
    for part in heads[1:] + records:
        out = out.unionByName(part)
    return out


def write_trace(runs: DataFrame, processes: DataFrame, anchors: DataFrame, small: DataFrame, large: DataFrame, path: str,
                compressed: bool = False, member_bytes: int = MEMBER_BYTES) -> None:
    """One trace file per run below ``path``, named by ``run_id`` (with ``.gz`` when compressed).

    ``runs``, ``processes``, ``small`` and ``large`` have the columns that the readers return, ``anchors`` those of the anchor table in file order
    (``run_id``, ``pos``, ``rank``, ``mpi_time_zero``, ``unix_time_zero_ns``). Runs of format version 1 have no anchors. A table of a run must have a
    row for every rank; records of ranks that the run has not, values that the format cannot hold, and a run in two tasks are errors, and no
    file appears. The format has one sequential file per run, so a run is encoded by one task, in a stream; runs are spread over tasks.
    """
    rows = trace_rows(runs, processes, anchors, small, large)
    (rows.repartition("run_id").sortWithinPartitions(*PLACE).write.format("trace").mode("append")
     .option("compressed", str(compressed).lower()).option("memberBytes", str(member_bytes)).save(path))


# --- in tasks -----------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    """Hidden files of a task and the names they shall get."""
    files: list[tuple[str, str]] = field(default_factory=list)


class _Plain:
    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()


class _Packed(_Plain):
    """Gzip in members of about ``size`` bytes of text each."""

    def __init__(self, out, size: int):
        super().__init__(out)
        self.size, self.held = size, 0
        self.packer = None

    def write(self, data: bytes) -> None:
        for at in range(0, len(data), self.size):
            part = data[at:at + self.size]
            if self.packer is None:
                self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            self.out.write(self.packer.compress(part))
            self.held += len(part)
            if self.held >= self.size:
                self._end()

    def _end(self) -> None:
        if self.packer is not None:
            self.out.write(self.packer.flush())
        self.packer, self.held = None, 0

    def close(self) -> None:
        self._end()
        super().close()


def _padded(text: str | None, size: int) -> bytes:
    raw = (text or "").encode()
    if len(raw) >= size:
        raise L.TraceError(f"text of {len(raw)} bytes does not fit into {size}")
    return raw.ljust(size, b"\0")


class _RunFile:
    """Encodes the rows of one run in file order and checks that they follow the format."""

    def __init__(self, run_id: str, out):
        self.run_id, self.out = run_id, out
        self.ranks = self.version = None
        self.rows = {PROCESS: 0, ANCHOR: 0}
        self.sections = {N_SMALL: 0, N_LARGE: 0}
        self.left = 0          # records that the open block still expects
        self.open = (-1, LARGE)  # section and kind that may come next

    def _fail(self, what: str):
        raise L.TraceError(f"run {self.run_id}: {what}")

    def add(self, block: int, kind: int | None, rows: dict[str, np.ndarray | list]) -> None:
        if block == HEAD:
            self._head(rows)
        elif self.ranks is None:
            self._fail("no row of the run table")
        elif block in (PROCESS, ANCHOR):
            self._table(block, rows)
        elif kind in (N_SMALL, N_LARGE):
            self._count(kind, rows)
        else:
            self._records(kind, rows)

    def _head(self, rows) -> None:
        if self.ranks is not None or len(rows["n"]) > 1:
            self._fail("several rows of the run table")
        self.ranks, self.version = int(rows["n"][0]), int(rows["i0"][0])
        if self.ranks < 0 or self.version not in (1, L.VERSION):
            self._fail(f"{self.ranks} ranks in format version {self.version}")
        start = L.MAGIC + struct.pack("<I", L.VERSION) if self.version == L.VERSION else b""
        self.out.write(start + struct.pack("<i", self.ranks) + _padded(rows["text"][0], L.DATE_BYTES) + _padded(rows["program"][0], L.PROGRAM_BYTES))

    def _table(self, block: int, rows) -> None:
        n = len(rows["rank"])
        if block == ANCHOR and self.version != L.VERSION:
            self._fail("anchors in format version 1")
        packed = np.zeros(n, L.PROCESS if block == PROCESS else L.ANCHOR)
        packed["rank"] = rows["rank"]
        if block == PROCESS:
            for name, column in (("pid", "i0"), ("core", "i1"), ("chip", "i2")):
                packed[name] = rows[column]
            packed["hostname"] = np.array([_padded(x, L.HOST_BYTES) for x in rows["text"]], f"V{L.HOST_BYTES}")
        else:
            packed["mpi_time_zero"], packed["unix_time_zero_ns"] = rows["seconds"], rows["n"]
        self.out.write(packed.tobytes())
        self.rows[block] += n

    def _tables_done(self) -> None:
        want = {PROCESS: self.ranks, ANCHOR: self.ranks if self.version == L.VERSION else 0}
        for block, name in ((PROCESS, "process"), (ANCHOR, "anchor")):
            if self.rows[block] != want[block]:
                self._fail(f"{self.rows[block]} rows of the {name} table, {want[block]} ranks")

    def _count(self, kind: int, rows) -> None:
        for rank, n in zip(rows["rank"], rows["n"]):
            if self.open == (-1, LARGE):
                self._tables_done()
            pos, last = self.open
            due = (pos + 1, N_SMALL) if last == LARGE else (pos, N_LARGE)
            if (int(rank), kind) != due or self.left:
                self._fail(f"rank {rank} out of order, or {self.left} records missing before it")
            label = L.SMALL_LABEL if kind == N_SMALL else L.LARGE_LABEL
            lead = struct.pack("<i", int(rank)) if kind == N_SMALL else b""
            self.out.write(lead + label.ljust(L.LABEL_BYTES, b"\0") + struct.pack("<i", int(n)))
            self.sections[kind] += 1
            self.left, self.open = int(n), (due[0], kind + 1)

    def _records(self, kind: int, rows) -> None:
        ranks = np.unique(rows["rank"])
        n = len(rows["rank"])
        if len(ranks) != 1 or (int(ranks[0]), kind) != self.open or n > self.left:
            self._fail(f"{n} records of rank {ranks[0]} that the run has not")
        packed = np.zeros(n, L.RECORDS["small" if kind == SMALL else "large"])
        names = [x for x in packed.dtype.names if x not in ("local_time", "pad")]
        packed["local_time"] = rows["seconds"]
        for name, column in zip(names, INTS):
            packed[name] = rows[column]
        self.out.write(packed.tobytes())
        self.left -= n

    def close(self) -> None:
        if self.ranks is None or self.left or (self.sections[N_SMALL], self.sections[N_LARGE]) != (self.ranks, self.ranks):
            self._fail("rows of the run are missing")
        if not self.ranks:
            self._tables_done()
        self.out.close()


class TraceWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.compressed = options.get("compressed", "false").lower() == "true"
        self.member_bytes = int(options.get("memberBytes", MEMBER_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = L.locate(self.path)
        made, run, current = Written(), None, None
        try:
            for batch in iterator:
                for run_id, block, kind, rows in _stretches(batch):
                    if run_id != current:
                        if run is not None:
                            run.close()
                        if run_id is None or run_id.rsplit("/", 1)[-1][:1] in ("", ".", "_") or ".." in run_id.split("/"):
                            raise L.TraceError(f"{run_id!r} cannot name a file")
                        hidden, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/{run_id}{'.gz' * (self.compressed and not run_id.endswith('.gz'))}"
                        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
                        made.files.append((hidden, name))
                        out = where.open_output_stream(hidden)
                        run, current = _RunFile(run_id, _Packed(out, self.member_bytes) if self.compressed else _Plain(out)), run_id
                    run.add(block, kind, rows)
            if run is not None:
                run.close()
        except BaseException:
            _remove(where, [hidden for hidden, _ in made.files])
            raise
        return made

    def commit(self, messages: list[Written | None]) -> None:
        where, root = L.locate(self.path)
        files = [pair for m in messages if m is not None for pair in m.files]
        names = [name for _, name in files]
        twice = {name for name in names if names.count(name) > 1} if len(set(names)) < len(names) else set()
        if twice:
            _remove(where, [hidden for hidden, _ in files])
            raise L.TraceError(f"rows of one run came to several tasks: {sorted(twice)[:3]}")
        where.create_dir(root, recursive=True)
        for hidden, name in files:
            where.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = L.locate(self.path)
        _remove(where, [hidden for m in messages if m is not None for hidden, _ in m.files])


def _remove(where, names: list[str]) -> None:
    for name in names:
        try:
            where.delete_file(name)
        except FileNotFoundError:
            pass


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int | None, dict]]:
    """Neighbouring rows of one run, block, section and kind."""
    if not batch.num_rows:
        return
    columns = {f: batch.column(f) for f in batch.schema.names}
    keys = [columns["run_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    keys += [columns[c].fill_null(-1).to_numpy(zero_copy_only=False) for c in ("block", "kind")]
    section = (keys[1] == SECTION) & np.isin(keys[2], (SMALL, LARGE))
    keys.append(np.where(section, columns["pos"].fill_null(-1).to_numpy(zero_copy_only=False), -1))
    change = np.zeros(batch.num_rows, bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        rows = {}
        for name, column in columns.items():
            part = column.slice(a, b - a)
            if pa.types.is_string(part.type):
                rows[name] = part.to_pylist()
            elif part.null_count == 0:
                rows[name] = part.to_numpy(zero_copy_only=False)
            elif part.null_count < len(part):
                raise L.TraceError(f"run {columns['run_id'][a]}: null in a row that the format needs")
        yield columns["run_id"][a].as_py(), int(keys[1][a]), int(keys[2][a]), rows
