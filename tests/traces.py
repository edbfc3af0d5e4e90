"""Hand-made traces: bytes of trace files and event rows."""

import gzip
import struct

from rankscope import schema as S
from rankscope.operators import timeline

ANCHOR_NS = 1_700_000_000_000_000_000


def small(time, id, code, sender, receiver, count=0, nbytes=0, comm=0, tag=0):
    return struct.pack("<d8i", time, id, code, comm, tag, sender, receiver, count, nbytes)


def large(time, id, code, one, two, comm=0):
    """``one`` and ``two`` are (sender, receiver, count, bytes, tag)."""
    return struct.pack("<d13i4x", time, id, code, comm, *one, *two)


def section(rank, smalls, larges=()):
    return (struct.pack("<i24si", rank, b"P2P Small Type Messages", len(smalls)) + b"".join(smalls)
            + struct.pack("<24si", b"P2P Large Type Messages", len(larges)) + b"".join(larges))


def header(n, version=2, program=b"prog", anchors=None, hosts=None):
    out = b"MPICv002" + struct.pack("<I", 2) if version == 2 else b""
    out += struct.pack("<i64s1024s", n, b"2024-01-01", program)
    for r in range(n):
        out += struct.pack("<iiii1024s", r, 100 + r, 0, 0, (hosts or [f"node{r:03d}" for r in range(n)])[r].encode())
    if version == 2:
        for rank, zero in anchors if anchors is not None else [(r, ANCHOR_NS + r) for r in range(n)]:
            out += struct.pack("<i4xdq", rank, 0.5, zero)
    return out


def bookended(rank, smalls, larges=(), last=9000, end=9.0):
    init = small(0.0, 0, S.INIT, rank, rank)
    fin = small(end, last, S.FINALIZE, rank, rank)
    return section(rank, [init, *smalls, fin], larges)


def write(path, *blocks, packed=False):
    data = b"".join(blocks)
    path.write_bytes(gzip.compress(data) if packed else data)
    return str(path)


SMALL_DDL = ("run_id string, rank_recording int, section_pos int, rec_pos long, local_time double, event_id long, "
             "call_code int, comm int, tag int, sender int, receiver int, cnt long, bytes long")


def events(spark, rows, zero=0):
    """Aligned events from (rank, time, id, code, sender, receiver, count, bytes[, comm, tag])."""
    full = []
    for i, r in enumerate(rows):
        rank, t, eid, code, s, d = r[:6]
        cnt, nb, comm, tag = (*r[6:], *[0] * 4)[:4]
        full.append(("r", rank, rank, i, float(t), eid, code, comm, tag, s, d, cnt, nb))
    df = spark.createDataFrame(full, SMALL_DDL)
    from pyspark.sql import functions as F
    return timeline.small_to_events(df).withColumn(
        "epoch_ns", F.rint(F.col("local_time") * 1e9).cast("long") + zero)


def runs(spark, n, run_id="r"):
    return spark.createDataFrame([(run_id, n)], "run_id string, total_ranks int")


def rows(df, *cols):
    """Rows as sorted tuples."""
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)
