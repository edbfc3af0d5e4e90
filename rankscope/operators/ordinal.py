"""Row numbers in timeline order that survive a key holding most of the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rankscope import schema as S
from rankscope.session import shuffles_dropped, written

# What a task adds to the rows of its piece: the piece, the number within key and piece, whether the row has the key that the
# piece begins with, and 1 for the piece's first row, 2 for its last, 3 for a single one.
MARKS = [T.StructField("_piece", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_lead", T.BooleanType()),
         T.StructField("_edge", T.IntegerType())]


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays are equal, nulls to nulls."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


class _Counter:
    """Numbers rows that come sorted by their keys; carries the open key and its count from batch to batch."""

    def __init__(self, part: list[str]):
        self.part, self.last, self.count, self.leading = part, None, 0, True

    def add(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = batch.num_rows
        begins = np.zeros(n, bool)
        begins[0] = self.last is not None
        for i, name in enumerate(self.part):
            column = batch.column(name)
            begins[1:] |= ~_same(column.slice(1), column.slice(0, n - 1))
        if self.last is not None:
            begins[0] = not all(_same(batch.column(name).slice(0, 1), last)[0] for name, last in zip(self.part, self.last))
        places = np.arange(n)
        start = np.maximum.accumulate(np.where(begins, places, -1))
        local = np.where(start < 0, places + self.count, places - start)
        lead = (start < 0) & self.leading
        self.leading = bool(lead[-1])
        self.count = int(local[-1]) + 1
        self.last = [batch.column(name).slice(n - 1, 1) for name in self.part]
        return local, lead


def _count_in_pieces(part: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, piece, held, first = _Counter(part), TaskContext.get().partitionId(), None, True

        def marked(batch, local, lead, last):
            nonlocal first
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] += first
            edge[-1] += 2 * last
            first = False
            added = [pa.array(np.full(batch.num_rows, piece, np.int32)), pa.array(local), pa.array(lead), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *(f.name for f in MARKS)])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield marked(*held, False)
            held = (batch, *counter.add(batch))
        if held is not None:
            yield marked(*held, True)
    return run


def ranged(df: DataFrame, part: list[str], order: list[Column]) -> DataFrame:
    """Rows dealt into pieces of about equal size along keys and order, numbered within key and piece (``MARKS``).

    The order is total, so a piece may begin anywhere inside a key, at an instant shared by many rows too. A task counts its rows as they
    come, in batches. The pieces are written down: numbers stay what they are when an executor is lost, and the files of the shuffle can go.
    """
    along = [*[F.col(c) for c in part], *order]
    rows = df.repartitionByRange(*along).sortWithinPartitions(*along)
    with shuffles_dropped(df.sparkSession):
        return written(rows.mapInArrow(_count_in_pieces(part), T.StructType([*df.schema.fields, *MARKS])), "ranged")


def _carried(rows: DataFrame, part: list[str]) -> DataFrame:
    """``(_of, _before)``: how many rows of the key that a piece begins with lie in earlier pieces. At most one row per piece.

    A key that goes on into a piece is the last key of every earlier piece that has it.
    """
    edges = rows.filter("_edge > 0").select(*part, "_piece", "_local", F.explode(F.array_compact(F.array(
        F.when(F.col("_edge") != 2, 0), F.when(F.col("_edge") != 1, 1)))).alias("_end"))
    before = Window.partitionBy(*part).orderBy("_piece", "_end").rowsBetween(Window.unboundedPreceding, -1)
    count = F.when(F.col("_end") == 1, F.col("_local") + 1).otherwise(0)
    return edges.withColumn("_before", F.sum(count).over(before)).filter("_end = 0 and _before > 0").select(F.col("_piece").alias("_of"), "_before")


def number_rows(df: DataFrame, keys: list[str],
                finish: Callable[[DataFrame], DataFrame] = lambda d: d,
                within: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Add ``ordinal`` (from 0) per ``keys + within`` in timeline order, then apply ``finish``.

    Rows are range-partitioned along keys and order, so no key needs a task of its own, and numbered where they lie. Only the one
    key that is open where a piece begins needs the count of earlier pieces: a table of at most one row a piece, which is
    broadcast. ``order`` may replace the timeline order.
    """
    part = keys + (within or [])
    rows = ranged(df, part, S.timeline_order() if order is None else order)
    carried = F.broadcast(_carried(rows, part))
    ordinal = F.col("_local") + F.when(F.col("_lead"), F.coalesce("_before", F.lit(0))).otherwise(0)
    return finish(rows.join(carried, F.col("_piece") == F.col("_of"), "left").withColumn("ordinal", ordinal).select(*df.columns, "ordinal"))


def dealt(df: DataFrame) -> DataFrame:
    """``df``, which ends in a shuffle, as rows that stay in the partitions in which they lie now.

    All that is made of it reads the files of one shuffle, whose bounds are drawn once, so a row's partition is the same in each; a plan that is run
    again would draw others. What an executor has lost is dealt again by the same bounds.
    """
    spark = df.sparkSession
    lying = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return DataFrame(lying, spark)


def number_keys(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Add ``ordinal`` (from 0) per ``keys`` in timeline order, for keys that are few, as runs are.

    Rows are dealt into pieces as by ``number_rows``, but nothing is written down: a first look at the pieces counts the rows of each
    key in them, which makes a table of at most one row per piece and one per key, and the second one sorts and numbers. The rows take the disk once.
    """
    along = [*[F.col(c) for c in keys], *(S.timeline_order() if order is None else order)]
    pieces = dealt(df.repartitionByRange(*along))
    piece = F.spark_partition_id().alias("_piece")
    counts = pieces.select(*keys, piece).groupBy("_piece", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    first = F.sum("_rows").over(Window.partitionBy("_piece").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(F.col("_piece").alias("_of"), *[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)],
                           (F.coalesce(before, F.lit(0)) - F.coalesce(first, F.lit(0))).alias("_shift"))
    # The low 33 bits of this id count the rows of a partition as they come.
    rows = pieces.sortWithinPartitions(*along).select("*", piece, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    own = F.col("_piece") == F.col("_of")
    for i, c in enumerate(keys):
        own &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(F.broadcast(begins), own).select(*df.columns, (F.col("_place") + F.col("_shift")).alias("ordinal"))
