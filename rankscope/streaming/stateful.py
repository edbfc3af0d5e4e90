"""Keyed state: rows put into event order, completion of nonblocking requests, accounting of dropped events.

Rows of a key may arrive in any order within the lateness of the stream. A key's state holds those that the watermark has not passed; what it
has passed is complete, is put in order and handed on. So results do not depend on arrival, and a key holds no more than its rows of the lateness.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankscope.operators.pairing import actual_transfer, with_world_source

ABANDONED_MS = 24 * 3600 * 1000
EPOCH_US = 24 * 3600 * 1_000_000

_REQUEST = ("call_code int, comm int, tag int, sender int, receiver int, cnt long, type_size int, "
            "is_recv boolean, wildcard boolean")
REQUEST_FIELDS = [f.split()[0] for f in _REQUEST.split(", ")]
PENDING = "posted_time double, " + _REQUEST
MATCHED = (f"run_id string, rank int, handle long, posted_time double, local_time double, {_REQUEST}, "
           "status_source int, status_count long, cancelled boolean")
MATCHED_FIELDS = [f.split()[0] for f in MATCHED.split(", ")]
_NULLABLE = {"string": "string", "int": "Int32", "long": "Int64", "double": "float64", "boolean": "boolean"}
MATCHED_TYPES = {name: _NULLABLE[kind] for name, kind in map(str.split, MATCHED.split(", "))}


# --- rows in event order ------------------------------------------------------

LATENESS = "3 seconds"
STATE = "held binary, carry binary"


def _packed(frame: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    frame.to_pickle(out, compression=None)
    return out.getvalue()


def _in_event_order(order: list[str], step: Callable, ahead_ms: int = 0, keep_ms: int | None = None):
    """State function that hands a key's rows to ``step`` in order, once the watermark plus ``ahead_ms`` has passed them.

    ``step(key, rows, carry)`` takes the rows that are due, sorted by ``order``, and the rows that it returned last time; it returns output and
    the rows to carry. A key whose carried rows wait longer than ``keep_ms`` for others is forgotten.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() + ahead_ms
        held, carry = (pd.read_pickle(io.BytesIO(part), compression=None) for part in map(bytes, state.get)) if state.exists else (None, None)
        if state.hasTimedOut and len(held) == 0:  # only carried rows are left, and too old
            state.remove()
            return
        parts = [*([held] if held is not None and len(held) else []), *(batches if not state.hasTimedOut else ())]
        rows = pd.concat(parts, ignore_index=True) if parts else held
        at = rows["event_ts"].to_numpy("datetime64[us]").astype("int64")
        due = at <= passed * 1000
        if due.any():
            out, carry = step(key, rows[due].sort_values(order, kind="stable"), carry if carry is not None else rows.iloc[:0])
            if len(out):
                yield out
            rows, at = rows[~due], at[~due]
        carry = rows.iloc[:0] if carry is None else carry
        if len(rows) == 0 and len(carry) == 0:
            if state.exists:
                state.remove()
            return
        state.update((_packed(rows), _packed(carry)))
        now = state.getCurrentWatermarkMs()
        if len(rows):
            state.setTimeoutTimestamp(max(int(at.min()) // 1000 + 1 - ahead_ms, now + 1))
        elif keep_ms is not None:
            newest = int(carry["event_ts"].to_numpy("datetime64[us]").astype("int64").max()) // 1000
            state.setTimeoutTimestamp(max(newest + keep_ms, now + 1))

    return run


def in_event_order(rows: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str, lateness: str = LATENESS,
                   ahead_ms: int = 0, keep_ms: int | None = None) -> DataFrame:
    """``step`` over every key's rows in ``order``, whatever order they arrive in; ``rows`` has ``event_ts``. See ``_in_event_order``."""
    return (rows.withWatermark("event_ts", lateness).groupBy(*keys)
            .applyInPandasWithState(_in_event_order(order, step, ahead_ms, keep_ms), schema, STATE, "append", GroupStateTimeout.EventTimeTimeout))


def held_back(events: DataFrame, keys: list[str], delay_ms: int = 2000, prune_ms: int = 3000) -> DataFrame:
    """Events of each key in time order, released once the newest event is ``delay_ms`` later.

    The released moment is the newest time less the delay. A row that comes up to ``prune_ms`` behind that moment is still released,
    a later one is dropped, and counted by the query. Rows equal in time keep their event order.
    """
    def release(key: tuple, rows: pd.DataFrame, carry: pd.DataFrame):
        return rows, carry

    return in_event_order(events, keys, ["event_ts", "event_id"], release, events.schema.simpleString().removeprefix("struct<").removesuffix(">"),
                          f"{delay_ms + prune_ms} milliseconds", prune_ms)


# --- requests -----------------------------------------------------------------

def _match(key: tuple, uses: pd.DataFrame, carry: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Completions right after a post of the handle; a post that ends the rows waits for the next ones."""
    if len(carry):
        uses = pd.concat([carry, uses])
    done = uses["done"].to_numpy(bool)
    end = np.flatnonzero(done[1:] & ~done[:-1]) + 1
    post, completion = uses.iloc[end - 1], uses.iloc[end]
    out = pd.DataFrame({**{c: [k] * len(end) for c, k in zip(MATCHED_FIELDS, key)},
                        "posted_time": post["t"].to_numpy(), "local_time": completion["t"].to_numpy(), **{c: post[c].to_numpy() for c in REQUEST_FIELDS},
                        **{c: completion[c].to_numpy() for c in ("status_source", "status_count", "cancelled")}}, columns=MATCHED_FIELDS)
    # Rows of several triggers meet here, some with nulls: whole columns get the types of the result again.
    return out.astype(MATCHED_TYPES), uses.iloc[-1:] if not done[-1] else uses.iloc[:0]


def complete_requests_stream(posted: DataFrame, completions: DataFrame, lateness: str = LATENESS,
                             comm_members: DataFrame | None = None) -> DataFrame:
    """Transfer events of nonblocking requests from a stream of posts and one of completions.

    The rows are those of ``pairing.complete_requests`` up to the watermark. Posts and completions may arrive in any order within
    ``lateness`` of the newest time ``t``. Cancelled requests give no event; a post without completion is forgotten after a day.
    """
    ids = ["run_id", "rank", "handle", "t"]
    status = {"status_source": "int", "status_count": "bigint", "cancelled": "boolean"}
    p = posted.select(*ids, *REQUEST_FIELDS, F.lit(False).alias("done"),
                      *[F.lit(None).cast(t).alias(c) for c, t in status.items()])
    types = dict(f.split() for f in _REQUEST.split(", "))
    c = completions.select(*ids, *[F.lit(None).cast(types[x]).alias(x) for x in REQUEST_FIELDS],
                           F.lit(True).alias("done"), *[F.col(x).cast(t).alias(x) for x, t in status.items()])
    # A stream's watermark begins at the epoch and nothing at or before it counts; a run's clock may begin at or below 0, so it is put a day later.
    uses = p.unionByName(c).withColumn("event_ts", F.timestamp_micros(F.floor(F.col("t") * 1e6).cast("long") + EPOCH_US))
    matched = in_event_order(uses, ["run_id", "rank", "handle"], ["t", "done"], _match, MATCHED, lateness, keep_ms=ABANDONED_MS)
    matched = matched.filter(~F.coalesce("cancelled", F.lit(False)))
    if comm_members is not None:
        matched = with_world_source(matched, comm_members)
    return matched.select(
        "run_id", F.col("rank").alias("rank_recording"), "handle", "posted_time", "local_time",
        "call_code", "comm", "tag", *actual_transfer(F.col("status_source")))


# --- dropped events -----------------------------------------------------------

DELTAS = "producer long, poll_ts timestamp, delta long, dropped_total long"


def _count(key: tuple, polls: pd.DataFrame, carry: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Changes of a producer's total; its last poll is carried."""
    total = polls["dropped_total"].astype("int64")
    delta = total - total.shift(fill_value=int(carry["dropped_total"].iloc[-1]) if len(carry) else 0)
    changed = delta != 0
    out = pd.DataFrame({"producer": key[0], "poll_ts": polls["event_ts"][changed], "delta": delta[changed], "dropped_total": total[changed]})
    return out, polls.iloc[-1:]


def drop_deltas_stream(counters: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Dropped events per producer since its last report, only when the total changed; polls may arrive in any order within ``lateness``."""
    rows = counters.select(F.col("producer").cast("long").alias("producer"), F.col("poll_ts").alias("event_ts"),
                           F.col("dropped_total").cast("long").alias("dropped_total"))
    return in_event_order(rows, ["producer"], ["event_ts", "dropped_total"], _count, DELTAS, lateness)


def drop_deltas(counters: DataFrame) -> DataFrame:
    """The same over a table of all polls."""
    w = Window.partitionBy("producer").orderBy("poll_ts", "dropped_total")
    before = F.lag("dropped_total", 1, 0).over(w)
    return (counters.withColumn("delta", F.col("dropped_total") - before)
            .filter(F.col("delta") != 0).select("producer", "poll_ts", "delta", "dropped_total"))
