"""Exact search for the traffic profiles with the largest inner products, pruned by length and coordinate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rankscope.llm.stage import written

BUCKETS = 16        # ranges of length
SLICE = 4096        # profiles of a bucket that one task holds
QUERIES = 8192      # queries that meet a slice in one task
BATCH = 256         # queries multiplied at once
STEEP = 0.7         # local cosine from which coordinates prune better than lengths

Arrays = tuple[np.ndarray, np.ndarray]


def _packed(profiles: DataFrame, scale: int) -> DataFrame:
    """``profile_id``, whole-numbered vector as bytes, its width and length; rows with null or non-finite components go."""
    whole = F.transform("profile", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.col("profile").isNotNull() & F.forall("profile", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            values, bounds = column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
            rows = [values[a:z] for a, z in zip(bounds, bounds[1:])]
            length = [float(np.sqrt((x.astype(np.float64) ** 2).sum())) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("profile_id"), pa.array([x.tobytes() for x in rows], pa.binary()),
                                              pa.array([len(x) for x in rows], pa.int32()), pa.array(length, pa.float64())],
                                             ["profile_id", "vector", "width", "length"])
    return (profiles.filter(F.col("profile_id").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
            .select(F.col("profile_id").cast("long").alias("profile_id"), whole.alias("v"))
            .mapInArrow(run, "profile_id long, vector binary, width int, length double"))


def similar_profiles(profiles: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """For every query profile the ``k`` other profiles with the largest inner products.

    ``profiles`` has ``profile_id`` long and ``profile`` array of numbers, as ``records.traffic_profiles`` makes them; a component x counts
    as floor(``scale`` * x). ``is_query`` marks the queries among them. Ties go to the smaller ``profile_id``.

    Profiles are put into ``BUCKETS`` ranges of length and these into slices of bounded size. The longest bucket is searched first; its k-th best
    product is a bound for the rest. In another bucket a query needs a local cosine of bound / (query length * longest length).
    From ``STEEP`` on, the query's largest coordinate leaves a narrow range for that coordinate of candidates; below, lengths alone prune.
    What is left is multiplied out. Slices meet queries in blocks, so no task holds all of either.

    Returns ``query_id``, ``rank`` (from 1), ``profile_id``, ``score`` long; fewer than ``k`` rows where there are fewer profiles. Profiles that are null or hold null or non-finite
    components take no part; of different widths only equal ones are compared. Rows that repeat a ``profile_id`` are separate candidates, but
    never meet a query of their own number. No rows give no rows; other columns are not read.
    """
    rows = written(_packed(profiles.select("profile_id", "profile"), scale), "profiles")
    asking = profiles.filter(F.coalesce(is_query, F.lit(False))).select(F.col("profile_id").cast("long").alias("profile_id")).distinct()
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = rows.agg(F.percentile_approx("length", F.array(*map(F.lit, shares)), 1000)).first()[0] or []
    bucket = sum((F.col("length") <= edge).cast("int") for edge in edges) if edges else F.lit(0)
    held = {r.b: (-(-r.n // SLICE), r.longest) for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()}
    slices = F.lit(1)
    for b, (n, _) in held.items():
        slices = F.when(bucket == b, n).otherwise(slices)
    placed = rows.withColumn("bucket", bucket.cast("int")).withColumn("slice", F.pmod(F.xxhash64("profile_id"), slices).cast("int"))
    first = min(held, default=0)
    queries = written(rows.join(asking, "profile_id", "left_semi"), "queries")
    groups = 1 + queries.count() // QUERIES
    asked = queries.select(F.col("profile_id").alias("query_id"), "vector", "width", "length",
                           F.pmod(F.xxhash64("profile_id"), F.lit(groups)).cast("int").alias("part"))
    best = _best(asked.withColumn("bound", F.lit(None).cast("double")), placed.filter(F.col("bucket") == first), {first: held.get(first, (1, 0.0))}, groups, k)
    best = written(best, "best")
    bounds = best.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")) \
                 .select("query_id", F.try_element_at("s", F.lit(k)).cast("double").alias("bound"))
    others = {b: x for b, x in held.items() if b != first}
    if others:
        more = _best(asked.join(bounds, "query_id", "left"), placed.filter(F.col("bucket") != first), others, groups, k)
        best = best.unionByName(more)
    return best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "profile_id"))), 1, k).alias("top")) \
               .select("query_id", F.posexplode("top").alias("at", "t")) \
               .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "t.profile_id", (-F.col("t.less")).alias("score"))


def _best(asked: DataFrame, placed: DataFrame, held: dict[int, tuple[int, float]], groups: int, k: int) -> DataFrame:
    """The ``k`` best of every slice for every query, none that cannot beat the query's bound.

    ``held`` has the slices and the longest length of each bucket. A query goes to the slices of those buckets alone in which a product can reach its bound.
    """
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("slices"), F.lit(longest).alias("longest")) for b, (n, longest) in held.items()])
    reach = F.filter(buckets, lambda c: F.col("bound").isNull() | (F.col("bound") <= F.col("length") * c["longest"] * (1 + 1e-9)))
    left = (asked.select("*", F.explode(reach).alias("cell")).select("*", "cell.bucket", F.explode(F.sequence(F.lit(0), F.col("cell.slices") - 1)).alias("slice"))
            .drop("cell"))
    right = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def run(queries: pa.Table, slice_: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        for width in set(queries.column("width").to_pylist()):
            out += _search(_table(queries, width, "query_id"), _table(slice_, width, "profile_id"), k)
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({n: pa.array(x.astype(np.int64)) for n, x in zip(("query_id", "profile_id", "score"), parts)})

    keys = ("bucket", "slice", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, profile_id long, score long")


def _table(table: pa.Table, width: int, name: str) -> dict[str, np.ndarray]:
    rows = table.filter(pc.equal(table.column("width"), width)).sort_by(name)
    out = {"id": rows.column(name).to_numpy(), "length": rows.column("length").to_numpy(),
           "whole": np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.int64).reshape(rows.num_rows, width)}
    out["v"] = out["whole"].astype(np.float64)
    if "bound" in rows.column_names:
        out["bound"] = rows.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
    return out


def _search(queries: dict[str, np.ndarray], held: dict[str, np.ndarray], k: int) -> list[Arrays]:
    """Query, profile and product of the best of one slice; profiles are sorted by number, so ties keep the smaller."""
    out: list[Arrays] = []
    if not len(held["id"]) or not len(queries["id"]):
        return out
    longest = held["length"].max()
    # A bound beyond 2^53 was rounded; the next number below it never drops a tie.
    bound = np.where(np.isnan(queries["bound"]), -np.inf, np.nextafter(queries["bound"], -np.inf))
    reach = queries["length"] * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(reach > 0, bound / reach, np.where(bound > 0, np.inf, -np.inf))
    for low in range(0, len(queries["id"]), BATCH):
        some = np.arange(low, min(low + BATCH, len(queries["id"])))
        some = some[cosine[some] <= 1 + 1e-9]  # a query that asks for more finds nothing here
        flat, steep = some[cosine[some] < STEEP], some[cosine[some] >= STEEP]
        if len(flat):
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(bound[flat] > 0, bound[flat] / queries["length"][flat], 0)
            keep = np.flatnonzero(held["length"] >= need.min() * (1 - 1e-9))
            _take(queries, held, flat, keep, _products(queries, flat, held, keep), bound, k, out)
        for q in steep:
            v, size = queries["v"][q], queries["length"][q]
            at, c = int(np.argmax(np.abs(v))), min(1.0, float(cosine[q]))
            share = v[at] / size
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - share * share))) + 1e-9
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(held["length"] > 0, held["v"][:, at] / held["length"], 0)
            # An angle within arccos(c) of the query leaves this range for the coordinate, on the side away from the query only beyond c.
            ok = (own >= share * c - spread) if share >= 0 else (own <= share * c + spread)
            keep = np.flatnonzero(ok & (held["length"] * size >= bound[q] * (1 - 1e-9)))
            _take(queries, held, np.array([q]), keep, _products(queries, np.array([q]), held, keep), bound, k, out)
    return out


def _products(queries: dict, some: np.ndarray, held: dict, keep: np.ndarray) -> np.ndarray:
    """Exact products: in doubles where lengths tell that no sum passes 2^52, else in 64-bit integers."""
    if len(keep) and queries["length"][some].max() * held["length"][keep].max() >= 2.0 ** 52:
        return queries["whole"][some] @ held["whole"][keep].T
    return queries["v"][some] @ held["v"][keep].T


def _take(queries: dict, held: dict, some: np.ndarray, keep: np.ndarray, products: np.ndarray, bound: np.ndarray, k: int, out: list) -> None:
    for q, scores in zip(some, products):
        ok = np.flatnonzero((scores >= bound[q]) & (held["id"][keep] != queries["id"][q]))
        if len(ok) > k:
            least = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
            ok = ok[scores[ok] >= least]
            ok = ok[np.argsort(-scores[ok], kind="stable")[:k]]
        if len(ok):
            out.append((np.full(len(ok), queries["id"][q]), held["id"][keep[ok]], scores[ok].astype(np.int64)))
