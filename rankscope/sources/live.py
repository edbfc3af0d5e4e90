"""The live feed as text: line protocol and exported series. Both work on batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankscope import functions as fx

LINE = r"^mpi_call,host=((?:\\.|[^\\ ])*) (\S+) (-?[0-9]+)$"
FIELD_NAMES = ["producer_world_rank", "message_type", "id", "is_large", "sender", "receiver", "bytes", "count",
               "sender1", "receiver1", "bytes1", "count1", "sender2", "receiver2", "bytes2", "count2"]
FIELDS = "struct<" + ",".join(f"{name}:bigint" for name in FIELD_NAMES) + ">"

# The integer fields of a record's line in the order in which they are written.
HEAD = ["producer_world_rank", "producer_subset_rank", "message_type"]
SMALL_FIELDS = [*HEAD, "sender", "receiver", "bytes", "count", "id", "is_large"]
LARGE_FIELDS = [*HEAD, *(f"{name}{part}" for part in (1, 2) for name in ("sender", "receiver", "bytes", "count")), "id", "is_large"]


def _numbers(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with what stands at the places of a line as it is usually written: ``tag``, ``n1`` to ``n13``, ``ns``, and ``large``."""
    # Equals signs part the numbers from the names; those of the host come before them, so that places are counted from the end.
    pieces = df.select("*", F.split(text, "=").alias("p")).select("*", F.element_at("p", -1).alias("last"), F.size("p").alias("size"))
    pieces = pieces.select("*", F.startswith("last", F.lit("1i ")).alias("large"))
    first = pieces.select("*", (F.col("size") - F.when(F.col("large"), len(LARGE_FIELDS)).otherwise(len(SMALL_FIELDS))).alias("first"))
    host = F.concat_ws("=", F.slice("p", F.lit(2), F.greatest(F.col("first") - 1, F.lit(0))))
    return first.select(*df.columns, "large", fx.unescape_tag(F.left(host, F.length(host) - len(f" {HEAD[0]}"))).alias("tag"),
                        F.substring("last", 4, 32).try_cast("long").alias("ns"), *[
                            F.substring_index(F.get("p", F.col("first") + i), "i", 1).try_cast("long").alias(f"n{i + 1}") for i in range(len(LARGE_FIELDS))])


def _as_written() -> Column:
    """The line that has these numbers at its places; null where one is missing."""
    def fields(names: list[str]) -> list[Column]:
        return [x for i, name in enumerate(names, 1) if i > len(HEAD) for x in (F.lit(f"i,{name}="), F.col(f"n{i}"))]

    head = [x for i, name in enumerate(HEAD, 1) for x in (F.lit(f"{'i,' if i > 1 else ' '}{name}="), F.col(f"n{i}"))]
    return F.concat(F.lit("mpi_call,host="), fx.escape_tag("tag"), *head,
                    F.when(F.col("large"), F.concat(*fields(LARGE_FIELDS))).otherwise(F.concat(*fields(SMALL_FIELDS))), F.lit("i "), F.col("ns"))


def parse_line_protocol(df: DataFrame, value: str = "value", run_id: str = "live") -> DataFrame:
    """Events of feed lines; other lines are those of ``unparsed_lines``.

    A small record gives one event and a large one two. The feed carries no communicator and no
    tag, so both are 0. Rows are in the layout of the ``events`` table plus ``host``. A line whose numbers, taken
    from their usual places and written again, give the same line is read so. Of any other one the integer fields are read in
    one pass, as the JSON object they almost are.
    """
    text = F.col(value)
    kept = [c for c in df.columns if c != value]
    plain = (_as_written() == text) & ~F.contains("tag", F.lit("\\"))
    judged = _numbers(df, text).withColumn("plain", F.coalesce(plain, F.lit(False)))
    judged = judged.withColumn("known", F.when(F.col("plain"), True).otherwise(F.coalesce(text.rlike(LINE), F.lit(False))))
    usual = F.struct(*[F.when(F.col("large"), F.col(f"n{LARGE_FIELDS.index(c) + 1}") if c in LARGE_FIELDS else F.lit(None)).otherwise(
        F.col(f"n{SMALL_FIELDS.index(c) + 1}") if c in SMALL_FIELDS else F.lit(None)).cast("long").alias(c) for c in FIELD_NAMES])
    fields = F.regexp_replace(F.regexp_extract(text, LINE, 2), r"(\w+)=(-?[0-9]+)i", r'"$1":$2')
    parsed = judged.select(
        *kept, "known", F.when(F.col("plain"), F.col("tag")).otherwise(fx.unescape_tag(F.regexp_extract(text, LINE, 1))).alias("host"),
        F.when(F.col("plain"), usual).otherwise(F.from_json(F.concat(F.lit("{"), fields, F.lit("}")), FIELDS)).alias("f"),
        F.when(F.col("plain"), F.col("ns")).when(F.col("known"), F.regexp_extract(text, LINE, 3).cast("long")).alias("epoch_ns"))

    def part(number: int, suffix: str) -> str:
        return (f"struct({number} as part, cast(f.sender{suffix} as int) as sender, "
                f"cast(f.receiver{suffix} as int) as receiver, f.bytes{suffix} as bytes, f.count{suffix} as cnt)")

    # A filter would be moved to where its column is made and make it once more: lines that are none give no rows here.
    rows = parsed.select(
        *kept, "host", "epoch_ns", F.col("f.producer_world_rank").cast("int").alias("rank_recording"),
        F.col("f.message_type").cast("int").alias("call_code"), F.col("f.id").alias("event_id"),
        F.expr(f"inline(if(known, if(f.is_large = 1, array({part(1, '1')}, {part(2, '2')}), array({part(0, '')})), null))"))
    return _as_events(rows, run_id, kept + ["host"])


def unparsed_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """The rows that ``parse_line_protocol`` gives no event for."""
    return df.filter(~F.coalesce(F.col(value).rlike(LINE), F.lit(False)))


def _as_events(rows: DataFrame, run_id: str, kept: list[str]) -> DataFrame:
    large = F.col("part") > 0
    time = F.col("epoch_ns") / F.lit(1e9)
    return rows.select(
        F.lit(run_id).alias("run_id"), "rank_recording", F.col("rank_recording").alias("section_pos"),
        large.cast("int").alias("rec_kind"), F.col("event_id").alias("rec_pos"), "part", "event_id",
        "call_code", fx.call_name().alias("call"), F.lit(0).alias("comm"), F.lit(0).alias("tag"),
        "sender", "receiver", "cnt", "bytes", fx.category().alias("category"),
        (large & (F.col("cnt") <= 0) & (F.col("bytes") <= 0)).alias("synthetic_empty"),
        time.alias("local_time"), "epoch_ns", time.alias("time"), *kept)


SERIES = "struct<metric:map<string,string>,values:array<double>,timestamps:array<bigint>>"


def unparsed_series(df: DataFrame, value: str = "value") -> DataFrame:
    """The rows that are no series; ``parse_series_export`` gives no event for them."""
    return df.filter(F.from_json(F.col(value), SERIES)["values"].isNull())


def parse_series_export(df: DataFrame, value: str = "value") -> DataFrame:
    """Events of exported series: one per sample, labels missing in the series read as 0.

    Labels named ``message_type`` are accepted next to ``type``, because the feed writes the
    first and the query layer reads the second.
    """
    # Filters, those of Spark's own before an explode too, move down to where a column is made and make it once more. None passes the
    # explode of a single element, so that a text is read once. Labels are those of a series: they are read before its samples are spread.
    series = df.select(F.explode(F.array(F.from_json(F.col(value), SERIES))).alias("s")) \
        .select("s.metric", F.arrays_zip("s.values", "s.timestamps").alias("samples")).filter(F.size("samples") > 0)

    def label(*names: str) -> Column:
        found = [F.try_element_at("metric", F.lit(n)).cast("long") for n in names]
        return F.coalesce(*found, F.lit(0).cast("long"))

    large = F.map_contains_key("metric", F.lit("bytes2"))
    code = label("type", "message_type").cast("int")
    labels = series.select(
        "samples", code.alias("call_code"), label("sender", "sender1").cast("int").alias("sender"),
        label("receiver", "receiver1").cast("int").alias("receiver"),
        large.cast("int").alias("is_large"),
        F.when(large, label("bytes1")).otherwise(label("bytes")).alias("bytes"),
        F.when(large, label("count1")).otherwise(label("count")).alias("cnt"),
        F.when(large, label("bytes2")).alias("bytes2"), F.when(large, label("count2")).alias("cnt2")) \
        .withColumn("call", fx.call_name())
    kept = [c for c in labels.columns if c != "samples"]
    return labels.select(F.explode("samples.timestamps").alias("ms"), *kept).select((F.col("ms") / 1000.0).alias("time"), *kept)
