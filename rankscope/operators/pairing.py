"""Matching sends with receives and collective calls with their roots, and what it reveals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.operators.ordinal import number_rows

P2P_KEYS = ["run_id", "comm", "sender", "receiver", "tag"]
TIME_COLUMNS = S.ORDER_COLUMNS


# Kinds of calls that are matched by their turn: sends, receives, and the three collectives whose k-th calls belong together.
SEND, RECEIVE, BROADCAST, REDUCTION, WAITING = range(5)
TURN_KEYS = ["run_id", "kind", "key1", "key2", "key3", "key4"]


def p2p_side() -> Column:
    """0 for rows that send, 1 for rows that receive, null for all others."""
    code, part = F.col("call_code"), F.col("part")
    return (F.when(fx.is_send_like() | ((code == S.SENDRECV) & (part == 1)), SEND)
            .when(fx.is_recv_like() | ((code == S.SENDRECV) & (part == 2)), RECEIVE))


def p2p_sides(events: DataFrame) -> DataFrame:
    """Rows that take part in point-to-point matching: side 0 sends, side 1 receives."""
    return events.select(*P2P_KEYS, *TIME_COLUMNS, "cnt", "bytes", p2p_side().alias("side")) \
                 .filter(F.col("side").isNotNull())


def _of_kinds(kinds: tuple[int, ...]) -> Column:
    """True for rows of some kinds, told by the call and the part alone.

    Spark evaluates a filter where the call code is made. A filter on the nested ``kind`` repeats that expression for every branch, and
    the generated method gets too long for the virtual machine to compile.
    """
    codes = {SEND: S.SEND_LIKE, RECEIVE: S.RECV_LIKE, BROADCAST: [S.BCAST], REDUCTION: [S.REDUCE], WAITING: [S.BARRIER]}
    code, parts = F.col("call_code"), [part for kind, part in ((SEND, 1), (RECEIVE, 2)) if kind in kinds]
    plain = code.isin(sorted({c for k in kinds for c in codes[k]}))
    return plain | ((code == S.SENDRECV) & F.col("part").isin(parts)) if parts else plain


def calls_in_turn(events: DataFrame, kinds: tuple[int, ...] = (SEND, RECEIVE, BROADCAST, REDUCTION, WAITING), payload: bool = False) -> DataFrame:
    """The calls of some kinds with their ``ordinal`` within kind and key, all numbered in one exchange.

    Keys are (comm, sender, receiver, tag) for the sides of a transfer, (comm, member) for broadcasts and reductions with the call's
    ``root`` beside, and the recording rank for barriers. A row is of one kind at most.
    """
    code = F.col("call_code")
    kind = F.coalesce(p2p_side(), F.when(code == S.BCAST, BROADCAST).when(code == S.REDUCE, REDUCTION).when(fx.is_barrier(), WAITING))
    two_sided, k = F.col("kind") <= RECEIVE, F.col("kind")
    keyed = events.filter(_of_kinds(kinds)).withColumn("kind", kind)
    rows = keyed.select(
        "run_id", "kind", F.when(k == WAITING, F.col("rank_recording")).otherwise(F.col("comm")).alias("key1"),
        F.when(two_sided | (k == REDUCTION), F.col("sender")).when(k == BROADCAST, F.col("receiver")).alias("key2"),
        F.when(two_sided, F.col("receiver")).alias("key3"), F.when(two_sided, F.col("tag")).alias("key4"),
        F.when(k == BROADCAST, F.col("sender")).when(k == REDUCTION, F.col("receiver")).alias("root"), *TIME_COLUMNS,
        *(["cnt", "bytes"] if payload else []))
    return number_rows(rows, TURN_KEYS)


def _transfers(turns: DataFrame) -> DataFrame:
    names = dict(zip(TURN_KEYS[2:], P2P_KEYS[1:]))
    return turns.filter(F.col("kind") <= RECEIVE).withColumnsRenamed({**names, "kind": "side"}).drop("root")


def p2p_ordinals(events: DataFrame) -> DataFrame:
    """Position of every send and receive within its side of its key."""
    return _transfers(calls_in_turn(events, (SEND, RECEIVE), payload=True))


def pair_p2p(events: DataFrame, keep_unmatched: bool = False,
             payload: bool = False, turns: DataFrame | None = None) -> DataFrame:
    """The i-th send of a key with its i-th receive; zero-byte rows take part. ``turns`` may give ``calls_in_turn`` of the events.
    """
    send, recv = F.col("side") == SEND, F.col("side") == RECEIVE
    values = ["time", "epoch_ns"] + (["cnt", "bytes"] if payload else [])
    rows = _transfers(calls_in_turn(events, (SEND, RECEIVE), payload) if turns is None else turns)
    aggs = [F.max(F.when(side, F.col(v))).alias(f"{name}_{v}")
            for name, side in (("send", send), ("recv", recv)) for v in values]
    out = rows.groupBy(*P2P_KEYS, "ordinal").agg(F.max(send).alias("has_send"), F.max(recv).alias("has_recv"), *aggs)
    if not keep_unmatched:
        out = out.filter("has_send and has_recv").drop("has_send", "has_recv")
    return out


def unmatched_p2p(events: DataFrame) -> DataFrame:
    """Surplus sends and receives per key; needs counts only, not the matching itself."""
    n = (p2p_sides(events).groupBy(*P2P_KEYS)
         .agg(F.count_if(F.col("side") == 0).alias("sends"),
              F.count_if(F.col("side") == 1).alias("receives")))
    zero = F.lit(0).cast("long")
    return (n.withColumn("surplus_sends", F.greatest(F.col("sends") - F.col("receives"), zero))
             .withColumn("surplus_receives", F.greatest(F.col("receives") - F.col("sends"), zero))
             .filter("sends <> receives"))


def _members(turns: DataFrame, kind: int) -> DataFrame:
    return turns.filter(F.col("kind") == kind).select("run_id", F.col("key1").alias("comm"), "root", F.col("key2").alias("local"), *TIME_COLUMNS, "ordinal")


def bcast_ordinals(events: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Position of a broadcast row among all broadcasts its receiver took part in."""
    return _members(calls_in_turn(events, (BROADCAST,)) if turns is None else turns, BROADCAST)


def reduce_ordinals(events: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    return _members(calls_in_turn(events, (REDUCTION,)) if turns is None else turns, REDUCTION)


def _against_root(numbered: DataFrame) -> DataFrame:
    """Time of every member relative to the root's own row of the same call.

    A group is one collective call, so it has at most one row per rank.
    """
    call = Window.partitionBy("run_id", "comm", "root", "ordinal")
    own = F.max(F.when(F.col("local") == F.col("root"), F.col("time"))).over(call)
    return (numbered.withColumn("root_time", own)
            .filter(F.col("root_time").isNotNull() & (F.col("local") != F.col("root")))
            .select("run_id", "comm", "root", "ordinal", "local", "time", "root_time",
                    (F.col("time") - F.col("root_time")).alias("diff")))


def pair_bcast(events: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    return _against_root(bcast_ordinals(events, turns))


def pair_reduce(events: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    return _against_root(reduce_ordinals(events, turns))


def _late(diff: Column, prefix: str, later: bool) -> list[Column]:
    beyond = diff > S.TIMING_THRESHOLD if later else diff < -S.TIMING_THRESHOLD
    amount = diff if later else -diff
    return [F.count_if(beyond).alias(f"{prefix}_count"),
            F.coalesce(F.sum(F.when(beyond, amount)), F.lit(0.0)).alias(f"{prefix}_time")]


def p2p_lateness(pairs: DataFrame) -> DataFrame:
    """Late senders and late receivers of a run from its matched pairs."""
    diff = F.col("recv_time") - F.col("send_time")
    return pairs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pairs"), *_late(diff, "late_sender", False),
        *_late(diff, "late_receiver", True))


def late_senders(pairs: DataFrame) -> DataFrame:
    return p2p_lateness(pairs).select("run_id", "late_sender_count", "late_sender_time")


def late_receivers(pairs: DataFrame) -> DataFrame:
    return p2p_lateness(pairs).select("run_id", "late_receiver_count", "late_receiver_time")


def late_broadcasters(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("run_id").agg(*_late(F.col("diff"), "late_broadcaster", False))


def early_reducers(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("run_id").agg(*_late(F.col("diff"), "early_reduce", False))


# --- barriers -----------------------------------------------------------------

def barrier_ordinals(events: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Position of every barrier row among its rank's barriers, all communicators mixed."""
    turns = calls_in_turn(events, (WAITING,)) if turns is None else turns
    return turns.filter(F.col("kind") == WAITING).select("run_id", *TIME_COLUMNS, "ordinal")


def barrier_spreads(events: DataFrame, runs: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Arrival spread of the k-th barrier; only barriers that every rank of the run reached."""
    size = runs.select("run_id", "total_ranks")
    return (barrier_ordinals(events, turns)
            .join(size, "run_id").filter(F.col("rank_recording").between(0, F.col("total_ranks") - 1))
            .groupBy("run_id", "ordinal", "total_ranks")
            .agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("t_min"), F.max("time").alias("t_max"))
            .filter(F.col("n") == F.col("total_ranks"))
            .select("run_id", F.col("ordinal").alias("barrier_index"), "t_min", "t_max",
                    (F.col("t_max") - F.col("t_min")).alias("spread")))


def spread_summary(spreads: DataFrame) -> DataFrame:
    return spreads.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("barrier_instances"), F.max("spread").alias("max_barrier_spread"),
        F.avg("spread").alias("avg_barrier_spread"))


# --- communicators and requests -----------------------------------------------

def translate_ranks(events: DataFrame, comm_members: DataFrame,
                    ends: tuple[str, ...] = ("sender", "receiver"), peer: Column | None = None) -> DataFrame:
    """World ranks for communicator ranks; negative and unknown ranks pass through.

    ``comm_members`` has ``run_id``, ``comm``, ``comm_rank`` and ``world_rank``. An intercommunicator joins two groups that count their ranks apart; its members
    also have a ``side``, 0 or 1, which is null elsewhere. The recording rank's own end of an event is then a rank of its
    group, the other end one of the remote group. ``peer`` names the other end, by default the sender of a receive and else the receiver.
    """
    key = ["run_id", "comm"]
    if "side" not in comm_members.columns:
        out = events
        for end in ends:
            members = comm_members.select(*key, F.col("comm_rank").alias(end), "world_rank")
            out = _translated(out.join(members, [*key, end], "left"), end)
        return out.select(*events.columns)
    peer = F.when(fx.is_recv_like(), F.lit("sender")).otherwise(F.lit("receiver")) if peer is None else peer
    own = comm_members.filter(F.col("side").isNotNull()).select(*key, F.col("world_rank").alias("rank_recording"), F.col("side").alias("_own")) \
        .dropDuplicates([*key, "rank_recording"])
    out = events.withColumn("_peer", peer).join(own, [*key, "rank_recording"], "left")
    for end in ends:
        # Groups that are no part of an intercommunicator count as side -1 on both sides of the join.
        wanted = F.coalesce(F.when(F.col("_peer") == end, 1 - F.col("_own")).otherwise(F.col("_own")), F.lit(-1))
        members = comm_members.select(*key, F.col("comm_rank").alias(end), F.coalesce("side", F.lit(-1)).alias("_side"), "world_rank")
        out = _translated(out.withColumn("_side", wanted).join(members, [*key, end, "_side"], "left").drop("_side"), end)
    return out.select(*events.columns)


def _translated(joined: DataFrame, end: str) -> DataFrame:
    rank = F.when(F.col(end) < 0, F.col(end)).otherwise(F.coalesce("world_rank", end))
    return joined.withColumn(end, rank).drop("world_rank")


def complete_requests(posted: DataFrame, completions: DataFrame, comm_members: DataFrame | None = None) -> DataFrame:
    """Transfer events of nonblocking requests, stamped with the time they completed.

    A completion belongs to the latest post of its handle that is not completed yet. A handle is not posted
    again while it is pending, so that is the row right before it among all posts and completions of the handle; an
    abandoned post takes no later completion. Requests that were cancelled or never completed leave no event.
    """
    key = ["run_id", "rank", "handle"]
    uses = posted.withColumn("done", F.lit(False)).unionByName(completions.withColumn("done", F.lit(True)), allowMissingColumns=True)
    turns = number_rows(uses, key, order=[F.col("t"), F.col("done")])
    status = [c for c in completions.columns if c not in (*key, "t")]
    p = turns.filter("not done").drop(*status, "done").withColumn("ordinal", F.col("ordinal") + 1).withColumnRenamed("t", "posted_time")
    c = turns.filter("done").select(*key, "ordinal", F.col("t").alias("local_time"), *status)
    done = p.join(c, [*key, "ordinal"]).filter(~F.coalesce("cancelled", F.lit(False)))
    if comm_members is not None:
        done = with_world_source(done, comm_members)
    return done.select(
        "run_id", F.col("rank").alias("rank_recording"), "handle", "posted_time", "local_time",
        "call_code", "comm", "tag", *actual_transfer(F.col("status_source")))


def with_world_source(done: DataFrame, comm_members: DataFrame) -> DataFrame:
    """``status_source`` as a world rank where the communicator's members are known."""
    members = comm_members.select("run_id", "comm", F.col("comm_rank").alias("status_source"), "world_rank")
    return (done.join(members, ["run_id", "comm", "status_source"], "left")
            .withColumn("status_source", F.coalesce("world_rank", "status_source")).drop("world_rank"))


def actual_transfer(source: Column) -> list[Column]:
    """Sender, receiver, count and bytes of a completed request."""
    wild = F.col("is_recv") & F.col("wildcard") & F.col("status_source").isNotNull()
    counted = F.col("is_recv") & (F.col("status_count") >= 0)
    cnt = F.when(counted, F.col("status_count")).otherwise(F.col("cnt"))
    return [F.when(wild, source).otherwise(F.col("sender")).alias("sender"), F.col("receiver"),
            cnt.alias("cnt"), fx.nbytes(cnt, "type_size").alias("bytes")]


def unanimous_control(requests: DataFrame) -> DataFrame:
    """Communicator and tag shared by all requests of a wait or test, else 0."""
    one = (F.min("comm") == F.max("comm")) & (F.min("tag") == F.max("tag"))
    return requests.groupBy("run_id", "rank", "wait_id").agg(
        F.when(one, F.min("comm")).otherwise(0).alias("comm"),
        F.when(one, F.min("tag")).otherwise(0).alias("tag"),
        F.count(F.lit(1)).alias("requests"))
