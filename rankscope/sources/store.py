"""Stored timelines: writing in chunks, reading back, and time-range scans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators import phases, timeline


def with_event_ts(events: DataFrame) -> DataFrame:
    """Add the microsecond timestamp used for time ranges and watermarks."""
    return events.withColumn("event_ts", F.timestamp_micros(F.expr("epoch_ns div 1000")))


def events_between(events: DataFrame, start: float, end: float) -> DataFrame:
    """Events of ``[start, end)`` in epoch seconds, cut to whole milliseconds.

    Half-open, so consecutive polls never repeat a row. Bounds are constants and reach the
    Parquet scan as pushed filters.
    """
    low, high = (F.timestamp_millis(F.lit(int(t * 1000))) for t in (start, end))
    return events.filter((F.col("event_ts") >= low) & (F.col("event_ts") < high))


# What a column mostly holds, told by other columns: its bit in ``_told``, the columns that tell it, and the value.
TOLD: dict[str, tuple[int, list[str], Callable[[], Column]]] = {
    "call": (1, ["call_code"], fx.call_name), "category": (2, ["call_code", "part"], fx.category), "section_pos": (4, ["rank_recording"], lambda: F.col("rank_recording")),
    "rec_pos": (8, ["event_id"], lambda: F.col("event_id")), "local_time": (16, ["time"], lambda: F.col("time")), "cnt": (32, ["bytes"], lambda: F.col("bytes")),
    "synthetic_empty": (64, ["part", "cnt", "bytes"], lambda: (F.col("part") > 0) & (F.col("cnt") <= 0) & (F.col("bytes") <= 0))}


def _told(rows: DataFrame) -> dict[str, tuple[Column, Column]]:
    """For the columns of ``rows`` that others tell: whether the bit is set, and the value."""
    return {c: (F.col("_told").bitwiseAND(bit) != 0, value().cast(rows.schema[c].dataType))
            for c, (bit, needs, value) in TOLD.items() if {c, *needs} <= set(rows.columns)}


def packed(events: DataFrame) -> DataFrame:
    """Events without the values that other columns tell. The bits of ``_told`` say where one was left out; any other value, nulls too, stays as it is."""
    flags = [F.lit(0)]
    for c, (_, value) in _told(events).items():
        same = F.col(c).eqNullSafe(value)
        if c == "local_time":  # a zero has a sign, which equality does not see
            same &= F.coalesce(F.col("time") != 0, F.lit(True))
        flags.append(F.when(same, TOLD[c][0]).otherwise(0))
    known = _told(events)
    return events.select("*", reduce(Column.bitwiseOR, flags).alias("_told")).select(
        *[F.when(~known[c][0], F.col(c)).alias(c) if c in known else c for c in events.columns], "_told")


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows that ``packed`` was given, and what was added to them."""
    if "_told" not in rows.columns:
        return rows
    known = _told(rows)
    last = "synthetic_empty"  # told by a count that may be told itself
    for names in (known.keys() - {last}, known.keys() & {last}):
        rows = rows.select(*[F.when(known[c][0], known[c][1]).otherwise(F.col(c)).alias(c) if c in names else c for c in rows.columns])
    return rows.drop("_told")


def packed_order(rows: DataFrame) -> list[Column]:
    """The timeline order of packed rows."""
    known = _told(rows)
    whole = {c: F.when(known[c][0], known[c][1]).otherwise(F.col(c)) for c in ("section_pos", "rec_pos") if c in known}
    return [whole[c] if c in whole else column for c, column in zip(S.ORDER_COLUMNS, S.timeline_order())]


def write_timeline(events: DataFrame, path: str, chunk_rows: int = timeline.CHUNK_ROWS) -> None:
    """Write the timeline in fixed-size chunks and their index.

    Numbered rows come sorted in pieces along run and position, so a chunk lies in few files, and files
    cover narrow ranges in each row group and page. The chunk is a column that these
    prune by: the number of files depends on the pieces, not on the chunks. On the way and in the files, values that other columns tell are left out.
    """
    rows = packed(events)
    chunked = with_event_ts(timeline.with_chunk_id(rows, chunk_rows, packed_order(rows)))
    (chunked.write.mode("overwrite").option("compression", "zstd")
     .partitionBy("run_id").parquet(f"{path}/events"))
    written = read_chunks(events.sparkSession, path)
    timeline.chunk_index(written).write.mode("overwrite").parquet(f"{path}/chunks")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The stored timeline with its chunk ids and positions."""
    return unpacked(spark.read.parquet(f"{path}/events"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A written timeline in the layout of the ``events`` table."""
    return read_chunks(spark, path).select(*S.EVENT_COLUMNS)


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def events_at(spark: SparkSession, path: str, run_id: str, t: float) -> DataFrame:
    """The one or two chunks around a moment; their ids prune the row groups and pages that are read."""
    wanted = phases.chunks_for_time(read_chunk_index(spark, path).filter(F.col("run_id") == run_id), t)
    ids = [r.chunk_id for r in wanted.select("chunk_id").collect()]  # at most two
    stored = spark.read.parquet(f"{path}/events")
    return unpacked(stored.filter((F.col("run_id") == run_id) & F.col("chunk_id").isin(ids)))


def frame_at(spark: SparkSession, path: str, run_id: str, t: float, speed: float = 0.0, k: int | None = None) -> DataFrame:
    """Active events of a stored run at a moment, all or the newest ``k``."""
    return phases.active_events(events_at(spark, path, run_id, t), t, speed, k)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per analysis section."""
    for name, df in sections.items():
        flat = df.withColumn("calls", F.to_json("calls")) if "calls" in df.columns else df
        flat.write.mode("overwrite").parquet(f"{path}/{name}")


def write_document(document: DataFrame, path: str) -> None:
    """The document's lines, one JSON object each, in its order."""
    document.select(F.to_json(F.struct("run_id", "section", "position", "json")).alias("value")).write.mode("overwrite").text(path)


# Fixed value: bytes of a line, its break included, that the feed's own sender has room for.
FEED_LINE_BYTES = 1023


def _line_head() -> Column:
    return F.concat(F.lit("mpi_call,host="), fx.escape_tag("host"), F.lit(" producer_world_rank="),
                    F.col("rank_recording"), F.lit("i,producer_subset_rank="), F.col("rank_recording"),
                    F.lit("i,message_type="), F.col("call_code"), F.lit("i,"))


def _line(fields: list[tuple[str, str]], is_large: int) -> Column:
    body = [x for name, source in fields for x in (F.lit(f"{name}="), F.col(source), F.lit("i,"))]
    return F.concat(_line_head(), *body, F.lit(f"is_large={is_large}i "), F.col("epoch_ns"))


def fits(max_bytes: int) -> Column:
    """True for lines that a sender with so large a buffer keeps, the line break included."""
    return F.octet_length("value") + 1 <= max_bytes


def rejected_lines(lines: DataFrame, max_bytes: int = FEED_LINE_BYTES) -> DataFrame:
    """The lines that such a sender drops."""
    return lines.filter(~fits(max_bytes))


def to_line_protocol_small(events: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Feed lines of small records; row by row, so streams can be written with it."""
    fields = [("sender", "sender"), ("receiver", "receiver"), ("bytes", "bytes"), ("count", "cnt"),
              ("id", "event_id")]
    lines = events.filter("part = 0").select("run_id", _line(fields, 0).alias("value"))
    return lines if max_bytes is None else lines.filter(fits(max_bytes))


def to_line_protocol(events: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Live-feed lines of events, one per record; needs a ``host`` column.

    The two parts of a large record share a line. All lines are kept unless ``max_bytes`` says what fits.
    """
    key = ["run_id", "rank_recording", "host", "call_code", "event_id", "section_pos", "rec_pos"]
    parts = [(c, n, p) for p in (1, 2) for c, n in (("sender", "sender"), ("receiver", "receiver"),
                                                    ("bytes", "bytes"), ("cnt", "count"))]
    two = events.filter("part > 0").groupBy(*key).agg(
        F.max("epoch_ns").alias("epoch_ns"),
        *[F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{c}{p}") for c, _, p in parts])
    fields = [(f"{n}{p}", f"{c}{p}") for c, n, p in parts] + [("id", "event_id")]
    large = two.select("run_id", _line(fields, 1).alias("value"))
    if max_bytes is not None:
        large = large.filter(fits(max_bytes))
    return to_line_protocol_small(events, max_bytes).unionByName(large)
