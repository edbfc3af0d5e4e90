"""Where ranks run: topology rows, host occupancy and core slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F



def build_topology(processes: DataFrame, nodes: DataFrame,
                   anchors: DataFrame | None = None) -> DataFrame:
    """Process rows with the position of their host and the clock anchor of their rank."""
    place = nodes.select("hostname", "cab_id", "rack_id", "blade_id", "x", "y", "z")
    known = F.col("x").isNotNull()
    out = processes.join(place, "hostname", "left").select(
        *processes.columns,
        F.coalesce("x", F.col("rank") * 15.0).alias("x"),
        F.when(known, F.coalesce("y", F.lit(0.0))).otherwise(0.0).alias("y"),
        F.when(known, F.coalesce("z", F.lit(0.0))).otherwise(0.0).alias("z"),
        "cab_id", "rack_id", "blade_id")
    if anchors is None:
        return out
    return out.join(anchors.select("run_id", "rank", "mpi_time_zero", "unix_time_zero_ns"),
                    ["run_id", "rank"], "left")


def _at_least_one(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c)).otherwise(1)


def node_occupancy(topology: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ranks, capacity and idle cores per host of a run, hosts without ranks included.

    ``nodes`` carries the ``run_id`` of the run whose hardware map it comes from.
    """
    ranks = topology.groupBy("run_id", F.coalesce("hostname", F.lit("unknown")).alias("hostname")) \
        .agg(F.count_distinct("rank").alias("used"))
    out = ranks.join(nodes.select("run_id", "hostname", "cpus", "cores_per_cpu"),
                     ["run_id", "hostname"], "full")
    used = F.coalesce("used", F.lit(0).cast("long"))
    capacity = (_at_least_one("cpus") * _at_least_one("cores_per_cpu")).cast("long")
    return out.select(
        "run_id", "hostname", used.alias("ranks"), capacity.alias("capacity"),
        F.greatest(capacity - used, F.lit(0).cast("long")).alias("idle_cores"),
        F.when(used > 0, "active").otherwise("idle").alias("state"))


def run_size(topology: DataFrame) -> DataFrame:
    return topology.groupBy("run_id").agg(F.count_distinct("rank").alias("ranks"),
                                          F.count_distinct("hostname").alias("hosts"))


def core_slots(topology: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chip and core shown for each rank: ranks fill their host's cores in rank order.

    A rank beyond the capacity of its host has no slot and is left out.
    """
    cores = nodes.select("run_id", "hostname", "cpus", "cores_per_cpu")
    w = Window.partitionBy("run_id", "hostname").orderBy("rank")
    placed = (topology.select("run_id", "hostname", "rank").distinct()
              .withColumn("i", F.row_number().over(w) - 1)
              .join(cores, ["run_id", "hostname"], "left")
              .withColumn("cpus", _at_least_one("cpus"))
              .withColumn("cores", _at_least_one("cores_per_cpu")))
    return (placed.filter(F.col("i") < F.col("cpus") * F.col("cores"))
            .select("run_id", "hostname", "rank", F.expr("i div cores").alias("chip_slot"),
                    (F.col("i") % F.col("cores")).alias("core_slot")))


def place_events(events: DataFrame, slots: DataFrame) -> DataFrame:
    """Host, chip and core of both ends; events with an unplaced end are left out."""
    out = events
    for end in ("sender", "receiver"):
        place = slots.select("run_id", F.col("rank").alias(end), F.col("hostname").alias(f"{end}_host"),
                             F.col("chip_slot").alias(f"{end}_chip"),
                             F.col("core_slot").alias(f"{end}_core"))
        out = out.join(place, ["run_id", end])
    return out
