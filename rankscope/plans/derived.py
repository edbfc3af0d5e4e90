"""A deterministic 64-rank trace computed from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankscope import functions as fx

RUN_ID = "derived"
RANKS = 64
ORIGIN_NS = 600_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_runs(spark: SparkSession) -> DataFrame:
    return spark.range(1).selectExpr(f"'{RUN_ID}' as run_id", f"{RANKS} as total_ranks")


# Records an order line can give: which rank records, who sends to whom, and when.
# 0 send, 1 receive, 2 wait, 3/4 and 5/6 the two sides of an exchange, 7/8 gather, 9/10 scatter.
_SLOTS = """case when code = 23 then array(3, 4, 5, 6) when code = 30 then array(7, 8)
  when code = 31 then array(9, 10)
  when h % 11 <> 0 and code >= 18 then array(0, 1, 2) when h % 11 <> 0 then array(0, 1)
  when code >= 18 then array(0, 2) else array(0) end"""


def _messages(lineitem: DataFrame) -> DataFrame:
    """Up to four records per order line, as a small slot number exploded in one scan.

    Record columns are computed from the slot after the explode, so a query that needs three
    of them computes three of them.
    """
    base = lineitem.selectExpr(
        "l_suppkey % 64 as s", "l_partkey % 64 as r",
        "(l_orderkey * 31 + l_linenumber * 17) % 101 as h",
        "cast(conv(substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 14), 16, 10) as bigint) as lid",
        "cast(l_quantity as bigint) as qty",
        "datediff(l_shipdate, date'1992-01-01') * 1000000L + (l_orderkey * 8 + l_linenumber) % 1000000 as us")
    msg = base.selectExpr(
        "s", "r", "h", "lid", "us", "us + ((h * 7) % 13 - 4) * 400 as us2",
        """case when h < 20 then 13 when h < 24 then 15 when h < 28 then 16 when h < 32 then 17
             when h < 60 then 18 when h < 64 then 19 when h < 68 then 20 when h < 72 then 21
             when h < 92 then 23 when h < 97 then 30 else 31 end as code""",
        "if(h % 11 = 0, 7, cast(h % 3 as int)) as mtag", "if(h % 5 = 0, 1, 0) as mcomm",
        """case when h % 10 = 0 then qty * qty * qty * 1000 when h % 10 < 5 then qty
             else qty * qty * 8 end as nb""",
        "if(s = r % 4, 64, 0) as fan")
    volume = "case when slot in (8, 9) then nb * fan else nb end"
    return msg.selectExpr("*", f"explode({_SLOTS}) as slot").selectExpr(
        "case when slot in (1, 5, 6) then us2 when slot = 2 then us + 900 else us end * 1000 as epoch_ns",
        "lid * 8 + case when slot = 1 then 1 when slot = 2 then 2 when slot in (5, 6) then 3 else 0 end as event_id",
        "cast(case when slot in (1, 5, 6) then r else s end as int) as rank_recording",
        """case when slot = 1 then if(h < 32, 14, 22)
             when slot = 2 then get(array(24, 25, 33, 34, 35, 36, 37, 38), cast(h % 8 as int))
             else code end as call_code""",
        "if(slot < 7, mcomm, 0) as comm", "if(slot < 7, mtag, 0) as tag",
        "cast(case when slot in (4, 5) then r when slot >= 8 then r % 4 else s end as int) as sender",
        """cast(case when slot in (0, 1, 3, 6) then r when slot in (7, 8, 9) then r % 4
             else s end as int) as receiver""",
        f"if(slot = 2, 1L, {volume}) as cnt", f"if(slot = 2, 0L, {volume}) as bytes",
        "case when slot <= 2 then 0 when slot in (3, 5, 7, 9) then 1 else 2 end as part")


def _collectives(orders: DataFrame) -> DataFrame:
    """Every order is the row of one rank; 64 keys in turn are one collective over all ranks."""
    return (orders.selectExpr("o_orderkey div 64 as ok", f"o_orderkey % {RANKS} as k")
            .selectExpr("ok", "k", "ok % 2400 * 1000000L as us", "ok % 5 as m", "ok % 4 as root", "1 + ok % 97 as c")
            .selectExpr("*", "explode(if(m = 4, array(1, 2), array(0))) as part")
            .selectExpr("*", "case when m = 0 then 0L when part = 2 then c * 64 else c end as size")
            .selectExpr(
                "(us + ((ok * 13 + k * 29) % 23) * 200) * 1000 as epoch_ns", "ok * 64 + k as event_id",
                "cast(k as int) as rank_recording",
                "get(array(26, 27, 28, 29, 32), cast(m as int)) as call_code", "0 as comm", "0 as tag",
                "cast(if(m = 1, root, k) as int) as sender", "cast(if(m = 2, root, k) as int) as receiver",
                "size as cnt", "size * 8 as bytes", "part"))


def _bookends(spark: SparkSession) -> DataFrame:
    return spark.range(RANKS).selectExpr("id as k", "explode(array(39, 40)) as call_code").selectExpr(
        "if(call_code = 39, 600000000 + k * 37, 4000000000 + k * 53) * 1000 as epoch_ns",
        "if(call_code = 39, -1L, 9000000000000000000L) as event_id", "cast(k as int) as rank_recording",
        "call_code", "0 as comm", "0 as tag", "cast(k as int) as sender", "cast(k as int) as receiver",
        "0L as cnt", "0L as bytes", "0 as part")


def derive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with an aligned clock but without names, categories and flags."""
    return (_messages(table(spark, sf_dir, "lineitem"))
            .unionByName(_collectives(table(spark, sf_dir, "orders")))
            .unionByName(_bookends(spark)))


def derive_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived trace in the layout of the ``events`` table."""
    time = F.expr(f"(epoch_ns - {ORIGIN_NS}L) / 1e9D")
    return derive_records(spark, sf_dir).select(
        F.expr(f"'{RUN_ID}' as run_id"), "rank_recording", F.col("rank_recording").alias("section_pos"),
        F.expr("if(part > 0, 1, 0) as rec_kind"), F.col("event_id").alias("rec_pos"), "part",
        "event_id", "call_code", fx.call_name().alias("call"), "comm", "tag", "sender", "receiver",
        "cnt", "bytes", fx.category().alias("category"),
        F.expr("part > 0 and cnt <= 0 and bytes <= 0 as synthetic_empty"),
        time.alias("local_time"), "epoch_ns", time.alias("time"))
