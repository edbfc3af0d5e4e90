"""Table layouts, call codes and the timeline order shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Call codes as they appear in trace records.
CALLS = {
    13: "MPI_SEND", 14: "MPI_RECV", 15: "MPI_BSEND", 16: "MPI_SSEND", 17: "MPI_RSEND",
    18: "MPI_ISEND", 19: "MPI_IBSEND", 20: "MPI_ISSEND", 21: "MPI_IRSEND", 22: "MPI_IRECV",
    23: "MPI_SENDRECV", 24: "MPI_WAIT", 25: "MPI_WAITALL", 26: "MPI_BARRIER", 27: "MPI_BCAST",
    28: "MPI_REDUCE", 29: "MPI_ALLREDUCE", 30: "MPI_GATHER", 31: "MPI_SCATTER",
    32: "MPI_ALLGATHER", 33: "MPI_WAITANY", 34: "MPI_WAITSOME", 35: "MPI_TEST",
    36: "MPI_TESTANY", 37: "MPI_TESTALL", 38: "MPI_TESTSOME", 39: "MPI_INIT", 40: "MPI_FINALIZE",
}
CODE = {name: code for code, name in CALLS.items()}

RECV, SENDRECV, BARRIER, BCAST, REDUCE = 14, 23, 26, 27, 28
ALLREDUCE, GATHER, SCATTER, ALLGATHER = 29, 30, 31, 32
INIT, FINALIZE = 39, 40

# Call families, by which calls are counted and matched.
SEND_LIKE = [13, 15, 16, 17, 18, 19, 20, 21]
RECV_LIKE = [14, 22]
COMPLETION = [24, 25, 33, 34, 35, 36, 37, 38]
SYNC = [26, 39, 40]
ROOTED = [27, 28, 30, 31]
GLOBAL = [29, 32]

# Size-bin labels and their exclusive upper edges in bytes.
BINS = ["< 128B", "128B - 1KB", "1KB - 64KB", "64KB - 1MB", "1MB - 16MB", "> 16MB"]
BIN_EDGES = [128, 1024, 65536, 1048576, 16777216]

# Fixed value: two events further apart than this count as late, in seconds.
TIMING_THRESHOLD = 0.001

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("total_ranks", T.IntegerType()),
    T.StructField("date", T.StringType()),
    T.StructField("program", T.StringType()),
    T.StructField("system_name", T.StringType()),
    T.StructField("file_format", T.StringType()),
    T.StructField("file_format_version", T.IntegerType()),
    T.StructField("time_registration", T.StringType()),
])
PROCESSES = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("pid", T.IntegerType()),
    T.StructField("core", T.IntegerType()),
    T.StructField("chip", T.IntegerType()),
    T.StructField("hostname", T.StringType()),
])
ANCHOR_ROWS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("total_ranks", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("mpi_time_zero", T.DoubleType()),
    T.StructField("unix_time_zero_ns", T.LongType()),
])
SMALL = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("rank_recording", T.IntegerType()),
    T.StructField("section_pos", T.IntegerType()),
    T.StructField("rec_pos", T.LongType()),
    T.StructField("local_time", T.DoubleType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("call_code", T.IntegerType()),
    T.StructField("comm", T.IntegerType()),
    T.StructField("tag", T.IntegerType()),
    T.StructField("sender", T.IntegerType()),
    T.StructField("receiver", T.IntegerType()),
    T.StructField("cnt", T.LongType()),
    T.StructField("bytes", T.LongType()),
])
PART = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("sender", T.IntegerType()),
    T.StructField("receiver", T.IntegerType()),
    T.StructField("cnt", T.LongType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("tag", T.IntegerType()),
])
LARGE = T.StructType([
    *SMALL.fields[:8],
    T.StructField("parts", T.ArrayType(PART)),
])
NODES = T.StructType([
    T.StructField("hostname", T.StringType()),
    T.StructField("cab_id", T.StringType()),
    T.StructField("rack_id", T.StringType()),
    T.StructField("blade_id", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("cpus", T.IntegerType()),
    T.StructField("cores_per_cpu", T.IntegerType()),
])

EVENT_COLUMNS = [
    "run_id", "rank_recording", "section_pos", "rec_kind", "rec_pos", "part", "event_id",
    "call_code", "call", "comm", "tag", "sender", "receiver", "cnt", "bytes", "category",
    "synthetic_empty", "local_time", "epoch_ns", "time",
]

# Rows without an aligned clock come last; the trailing columns repeat append order.
ORDER_COLUMNS = [
    "epoch_ns", "time", "event_id", "rank_recording", "section_pos", "rec_kind", "rec_pos", "part",
]


def timeline_order(descending: bool = False) -> list[Column]:
    """Sort columns of the timeline order, or of its exact reverse."""
    if descending:
        return [F.col(c).desc_nulls_first() if c == "epoch_ns" else F.col(c).desc()
                for c in ORDER_COLUMNS]
    return [F.col(c).asc_nulls_last() if c == "epoch_ns" else F.col(c).asc()
            for c in ORDER_COLUMNS]


def order_key() -> Column:
    """The timeline order as one comparable struct, for min_by / max_by over few rows."""
    return F.struct(F.col("epoch_ns").isNull().alias("unaligned"),
                    *[F.col(c) for c in ORDER_COLUMNS])
