"""Named queries over the given tables and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankscope import schema as S
from rankscope.plans.derived import derive_trace, derived_runs
from rankscope.plans.metrics import Trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TRACE_SQL = """
with base as (
  select l_suppkey % 64 as s, l_partkey % 64 as r,
         (l_orderkey * 31 + l_linenumber * 17) % 101 as h,
         ('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 14))::bigint as lid,
         cast(l_quantity as bigint) as qty,
         date_diff('day', timestamp '1992-01-01', l_shipdate) * 1000000 + (l_orderkey * 8 + l_linenumber) % 1000000 as us
  from lineitem),
msg as (
  select *, us + ((h * 7) % 13 - 4) * 400 as us2,
         case when h < 20 then 13 when h < 24 then 15 when h < 28 then 16 when h < 32 then 17
              when h < 60 then 18 when h < 64 then 19 when h < 68 then 20 when h < 72 then 21
              when h < 92 then 23 when h < 97 then 30 else 31 end as code,
         case when h % 11 = 0 then 7 else h % 3 end as tag,
         case when h % 5 = 0 then 1 else 0 end as comm,
         case when h % 10 = 0 then qty * qty * qty * 1000
              when h % 10 < 5 then qty else qty * qty * 8 end as nb,
         case when s = r % 4 then 64 else 0 end as fan
  from base),
p2p as (
  select us * 1000 as epoch_ns, lid * 8 as event_id, s as rank_recording, code as call_code, comm, tag,
         s as sender, r as receiver, nb as cnt, nb as bytes, 0 as part
  from msg where code between 13 and 21
  union all
  select us2 * 1000, lid * 8 + 1, r, case when h < 32 then 14 else 22 end, comm, tag, s, r, nb, nb, 0
  from msg where code between 13 and 21 and h % 11 <> 0
  union all
  select (us + 900) * 1000, lid * 8 + 2, s,
         case h % 8 when 0 then 24 when 1 then 25 when 2 then 33 when 3 then 34
                    when 4 then 35 when 5 then 36 when 6 then 37 else 38 end,
         comm, tag, s, s, 1, 0, 0
  from msg where code between 18 and 21
  union all select us * 1000,  lid * 8,     s, 23, comm, tag, s, r, nb, nb, 1 from msg where code = 23
  union all select us * 1000,  lid * 8,     s, 23, comm, tag, r, s, nb, nb, 2 from msg where code = 23
  union all select us2 * 1000, lid * 8 + 3, r, 23, comm, tag, r, s, nb, nb, 1 from msg where code = 23
  union all select us2 * 1000, lid * 8 + 3, r, 23, comm, tag, s, r, nb, nb, 2 from msg where code = 23
  union all select us * 1000, lid * 8, s, 30, 0, 0, s, r % 4, nb, nb, 1 from msg where code = 30
  union all select us * 1000, lid * 8, s, 30, 0, 0, r % 4, r % 4, nb * fan, nb * fan, 2 from msg where code = 30
  union all select us * 1000, lid * 8, s, 31, 0, 0, r % 4, r % 4, nb * fan, nb * fan, 1 from msg where code = 31
  union all select us * 1000, lid * 8, s, 31, 0, 0, r % 4, s, nb, nb, 2 from msg where code = 31),
ranks as (select cast(range as bigint) as k from range(64)),
grp as (
  select o_orderkey // 64 as ok, o_orderkey % 64 as k, (o_orderkey // 64) % 2400 * 1000000 as us, (o_orderkey // 64) % 5 as m,
         (o_orderkey // 64) % 4 as root, 1 + (o_orderkey // 64) % 97 as c
  from orders),
coll as (
  select (us + ((ok * 13 + k * 29) % 23) * 200) * 1000 as epoch_ns, ok * 64 + k as event_id,
         k as rank_recording,
         case m when 0 then 26 when 1 then 27 when 2 then 28 when 3 then 29 else 32 end as call_code,
         0 as comm, 0 as tag,
         case when m = 1 then root else k end as sender,
         case when m = 2 then root else k end as receiver,
         case when m = 0 then 0 else c end as cnt, case when m = 0 then 0 else 8 * c end as bytes,
         case when m = 4 then 1 else 0 end as part
  from grp
  union all
  select (us + ((ok * 13 + k * 29) % 23) * 200) * 1000, ok * 64 + k, k, 32, 0, 0, k, k, 64 * c, 512 * c, 2
  from grp where m = 4
  union all select (600000000 + k * 37) * cast(1000 as bigint), -1, k, 39, 0, 0, k, k, 0, 0, 0 from ranks
  union all select (4000000000 + k * 53) * cast(1000 as bigint), 9000000000000000000, k, 40, 0, 0, k, k, 0, 0, 0 from ranks),
raw as (select * from p2p union all select * from coll),
trace as (
  select raw.*, (epoch_ns - 600000000000) / 1e9 as time,
         part > 0 and cnt <= 0 and bytes <= 0 as synthetic_empty
  from raw)"""

_NAMES = " ".join(f"when {code} then '{name}'" for code, name in S.CALLS.items())


def _codes(codes) -> str:
    return "(" + ", ".join(map(str, codes)) + ")"


EVENTS_SQL = TRACE_SQL + f""",
ev as (
  select *, case call_code {_NAMES} else 'UNKNOWN_' || call_code end as call,
         call_code in {_codes(S.COMPLETION)} as completion,
         call_code = 26 as barrier,
         call_code in {_codes(S.ROOTED + S.GLOBAL)} as coll,
         call_code in {_codes(S.ROOTED)} as rooted,
         call_code in {_codes(S.GLOBAL)} as globl,
         case when bytes < 0 then null when bytes < 128 then 0 when bytes < 1024 then 1
              when bytes < 65536 then 2 when bytes < 1048576 then 3 when bytes < 16777216 then 4
              else 5 end as bin,
         bytes > 0 and not synthetic_empty and (
           call_code in {_codes(S.SEND_LIKE)} or (call_code = 23 and part = 1)
           or (sender <> receiver and (call_code in (27, 28) or (call_code = 30 and part = 1)
                                       or (call_code = 31 and part = 2)))) as canon,
         case when call_code in (27, 31) then sender when call_code in (28, 30) then receiver end as root
  from trace)"""

LINKS_SQL = EVENTS_SQL + """,
link_calls as (
  select comm, sender, receiver, call, count(*) as n, cast(sum(bytes) as bigint) as b,
         min(time) as f, max(time) as l, min((epoch_ns, time, event_id, rank_recording, part)) as seen
  from ev where canon group by all),
links as (
  select comm, sender, receiver, cast(sum(n) as bigint) as messages, cast(sum(b) as bigint) as bytes,
         string_agg(call || '=' || n, ',' order by call) as calls,
         min(f) as first_time, max(l) as last_time, min(seen) as seen
  from link_calls group by all),
roots as (
  select root, cast(sum(n) as bigint) as events, cast(sum(b) as bigint) as bytes,
         string_agg(call || '=' || n, ',' order by call) as calls, min(seen) as seen
  from (select root, call, count(*) as n, sum(bytes) as b,
               min((epoch_ns, time, event_id, rank_recording, part)) as seen
        from ev where canon and rooted group by all) group by all)"""

RANKS_SQL = LINKS_SQL + """,
spine as (select cast(range as bigint) as rank from range(64)),
sent as (select sender as rank, cast(sum(bytes) as bigint) as b, count(*) as m, count(distinct receiver) as p
         from ev where canon group by 1),
got as (select receiver as rank, cast(sum(bytes) as bigint) as b, count(*) as m, count(distinct sender) as p
        from ev where canon group by 1),
acts as (
  select rank_recording as rank, count(*) as events, count(*) filter (completion) as completion_events,
         count(*) filter (barrier) as barrier_events, count(*) filter (coll) as collective_events,
         count(*) filter (globl) as global_collective_events,
         count(*) filter (rooted) as rooted_collective_events,
         cast(coalesce(sum(greatest(cnt, 0)) filter (completion), 0) as bigint) as completion_request_count
  from ev group by 1),
ranks_t as (
  select rank, coalesce(sent.b, 0) as canonical_bytes_out, coalesce(sent.m, 0) as canonical_messages_out,
         coalesce(sent.p, 0) as distinct_out_peers, coalesce(got.b, 0) as canonical_bytes_in,
         coalesce(got.m, 0) as canonical_messages_in, coalesce(got.p, 0) as distinct_in_peers,
         coalesce(sent.b, 0) + coalesce(got.b, 0) as touch_bytes
  from spine left join sent using (rank) left join got using (rank))"""

TO = "epoch_ns, time, event_id, rank_recording, part"

PAIRS_SQL = f""",
sides as (
  select *, case when call_code in {_codes(S.SEND_LIKE)} or (call_code = 23 and part = 1) then 0
                 when call_code in (14, 22) or (call_code = 23 and part = 2) then 1 end as side
  from ev),
numbered as (
  select *, row_number() over (partition by comm, sender, receiver, tag, side order by {TO}) - 1 as i
  from sides where side is not null),
pairs as (
  select comm, sender, receiver, tag, i, max(time) filter (side = 0) as ts, max(time) filter (side = 1) as tr,
         max(epoch_ns) filter (side = 0) as es, max(epoch_ns) filter (side = 1) as er,
         max(cnt) filter (side = 0) as cs, max(cnt) filter (side = 1) as cr,
         max(bytes) filter (side = 0) as bs, max(bytes) filter (side = 1) as br
  from numbered group by comm, sender, receiver, tag, i having count(distinct side) = 2),
bc as (
  select comm, sender as root, receiver as local, time, epoch_ns,
         row_number() over (partition by comm, receiver order by {TO}) - 1 as i
  from ev where call_code = 27),
bcast as (
  select m.comm, m.root, m.i, m.local, m.time - r.time as diff, m.epoch_ns - r.epoch_ns as diff_ns
  from bc m join bc r on m.comm = r.comm and m.root = r.root and m.i = r.i and r.local = r.root
  where m.local <> m.root),
rd as (
  select comm, receiver as root, sender as local, time, epoch_ns,
         row_number() over (partition by comm, sender order by {TO}) - 1 as i
  from ev where call_code = 28),
reduces as (
  select m.comm, m.root, m.i, m.local, m.time - r.time as diff, m.epoch_ns - r.epoch_ns as diff_ns
  from rd m join rd r on m.comm = r.comm and m.root = r.root and m.i = r.i and r.local = r.root
  where m.local <> m.root),
br as (
  select rank_recording as rank, time, epoch_ns,
         row_number() over (partition by rank_recording order by {TO}) - 1 as k
  from ev where barrier),
spreads as (
  select k as barrier_index, min(time) as t_min, max(time) as t_max, max(time) - min(time) as spread,
         max(epoch_ns) - min(epoch_ns) as spread_ns
  from br group by k having count(*) = 64)"""

METRICS_SQL = RANKS_SQL + PAIRS_SQL + """,
tot as (
  select count(*) as total_events, count(*) filter (canon) as canonical_events,
         cast(sum(bytes) filter (canon) as bigint) as canonical_bytes,
         count(*) filter (completion) as completion_events, count(*) filter (barrier) as barrier_events,
         count(*) filter (coll) as collective_events, count(*) filter (globl) as global_collective_events,
         count(*) filter (canon and bytes < 128) as small128_events,
         count(*) filter (canon and bytes < 1024) as small1k_events,
         greatest(0, arg_max(time, (epoch_ns, time, event_id, rank_recording, part))
                     - arg_min(time, (epoch_ns, time, event_id, rank_recording, part))) as runtime
  from ev),
m as (
  select tot.*, (select count(*) from links) as pairs_observed,
         (select count(*) from links) / (64.0 * 63.0) as pair_density,
         (select max(bytes) from links) / cast(canonical_bytes as double) as top_link_share,
         (select count(*) from roots) as roots,
         (select cast(sum(bytes) as bigint) from roots) as root_bytes,
         (select root from roots order by bytes desc, seen limit 1) as top_root,
         (select max(bytes) / cast(sum(bytes) as double) from roots) as top_root_share,
         (select avg(distinct_out_peers) from ranks_t) as avg_out_peers,
         (select avg(distinct_in_peers) from ranks_t) as avg_in_peers,
         (select stddev_pop(touch_bytes) / avg(touch_bytes) from ranks_t) as touch_cv,
         small1k_events / cast(canonical_events as double) as small1k_ratio,
         completion_events / cast(canonical_events as double) as completion_ratio,
         barrier_events / cast(total_events as double) as barrier_fraction,
         (select count(*) from spreads) as barrier_instances,
         (select max(spread) from spreads) as max_barrier_spread,
         (select avg(spread) from spreads) as avg_barrier_spread,
         (select count(*) from pairs where tr - ts < -0.001) as ls_n,
         (select coalesce(sum(ts - tr), 0) from pairs where tr - ts < -0.001) as ls_t,
         (select count(*) from pairs where tr - ts > 0.001) as lr_n,
         (select coalesce(sum(tr - ts), 0) from pairs where tr - ts > 0.001) as lr_t,
         (select count(*) from bcast where diff < -0.001) as lb_n,
         (select coalesce(sum(-diff), 0) from bcast where diff < -0.001) as lb_t,
         (select count(*) from reduces where diff < -0.001) as er_n,
         (select coalesce(sum(-diff), 0) from reduces where diff < -0.001) as er_t
  from tot)"""


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL it must agree with when there is one."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def trace(spark: SparkSession, sf_dir: str, share: bool = False) -> Trace:
    return Trace(derive_trace(spark, sf_dir), derived_runs(spark), share)


def calls_text(column: str = "calls") -> Column:
    """A call map as sorted ``key=value`` text."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")


def r6(value) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)
