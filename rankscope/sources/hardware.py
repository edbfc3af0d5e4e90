"""Hardware maps and scheduler topology as node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankscope import functions as fx
from rankscope import schema as S
from rankscope.sources import trace_layout

_NODE = "hostname string, slot double, x_offset double, cpus int, cores_per_cpu int"
_RACK = (f"id string, x_offset double, z_offset double, nodes array<struct<{_NODE}>>, "
         f"blades array<struct<id string, y_offset double, nodes array<struct<{_NODE}>>>>")
MAP_SCHEMA = (f"metadata struct<system_name: string>, "
              f"cabinets array<struct<id string, x double, z double, racks array<struct<{_RACK}>>>>")


def _exists(path: str) -> bool:
    where, name = trace_layout.locate(path)
    return where.get_file_info(name).type != trace_layout.fs.FileType.NotFound


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def read_hardware_map(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of nested hardware maps; the last of several entries for a host wins.

    A rack lists its nodes in blades, or directly when it has no ``blades``. A missing file gives
    no nodes.
    """
    if not _exists(path):
        return spark.createDataFrame([], S.NODES)
    maps = spark.read.schema(MAP_SCHEMA).json(path, multiLine=True)
    racks = (maps.select(F.posexplode("cabinets").alias("c", "cab"))
             .select("c", "cab", F.posexplode("cab.racks").alias("r", "rack")))
    node_x = F.coalesce("node.x_offset", _zero("node.slot") * 12)
    base_x, base_z = _zero("cab.x") + _zero("rack.x_offset"), _zero("cab.z") + _zero("rack.z_offset")
    common = [F.col("node.hostname").alias("hostname"), F.col("cab.id").alias("cab_id"),
              F.col("rack.id").alias("rack_id")]
    sizes = [F.col("node.cpus").alias("cpus"), F.col("node.cores_per_cpu").alias("cores_per_cpu")]
    in_blades = (racks.filter("rack.blades is not null")
                 .select("*", F.posexplode("rack.blades").alias("b", "blade"))
                 .select("*", F.posexplode("blade.nodes").alias("n", "node"))
                 .select(*common, F.col("blade.id").alias("blade_id"), (base_x + node_x).alias("x"),
                         _zero("blade.y_offset").alias("y"), base_z.alias("z"), *sizes,
                         F.struct("c", "r", "b", "n").alias("at")))
    in_racks = (racks.filter("rack.blades is null")
                .select("*", F.posexplode("rack.nodes").alias("n", "node"))
                .select(*common, F.lit(None).cast("string").alias("blade_id"), base_x.alias("x"),
                        (_zero("node.slot") * 15).alias("y"), base_z.alias("z"), *sizes,
                        F.struct("c", "r", F.lit(0).alias("b"), "n").alias("at")))
    named = in_blades.unionByName(in_racks).filter(F.coalesce(F.col("hostname"), F.lit("")) != "")
    rest = [c for c in S.NODES.names if c != "hostname"]
    return (named.groupBy("hostname").agg(F.max_by(F.struct(*rest), "at").alias("node"))
            .select("hostname", *[F.col(f"node.{c}").alias(c) for c in rest]))


def read_hardware_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The cluster name and the original text of each hardware map."""
    return spark.read.text(path, wholetext=True).select(
        F.get_json_object("value", "$.metadata.system_name").alias("map_system_name"),
        F.col("value").alias("hardware_blueprint"))


def with_system_name(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Runs with the cluster name and blueprint of their hardware map.

    ``metadata`` carries the ``run_id`` of the runs its map belongs to.
    """
    return (runs.join(metadata, "run_id", "left")
            .withColumn("system_name", F.coalesce("map_system_name", "system_name"))
            .drop("map_system_name"))


# Distances between neighbours in the generated layout.
CABINET_X, RACK_X, BLADE_Y, NODE_X = 60, 12, 12, 8


def read_slurm_topology(spark: SparkSession, path: str, racks_per_cabinet: int = 4,
                        nodes_per_blade: int = 4, cpus: int = 2, cores: int = 32) -> DataFrame:
    """Nodes of a scheduler topology listing: one rack per leaf switch, in file order.

    The listing has one line per switch, so numbering its leaf switches is a small sort.
    """
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line"), "value",
        F.regexp_extract("value", r"SwitchName=(\S+)", 1).alias("switch"),
        F.regexp_extract("value", r"Nodes=(\S+)", 1).alias("hosts"))
    leaf = lines.filter(F.contains("value", F.lit("Level=0")) & (F.col("switch") != "") & (F.col("hosts") != ""))
    order = Window.partitionBy(F.lit(0)).orderBy("line")
    racks = leaf.withColumn("rack", F.row_number().over(order) - 1)
    nodes = racks.select("rack", "switch", F.posexplode(fx.expand_hostlist("hosts")).alias("slot", "hostname"))
    cabinet, place = F.expr(f"rack div {racks_per_cabinet}"), F.col("rack") % racks_per_cabinet
    blade, seat = F.expr(f"slot div {nodes_per_blade}"), F.col("slot") % nodes_per_blade
    return nodes.select(
        "hostname", F.format_string("CAB-%02d", cabinet + 1).alias("cab_id"),
        F.concat(F.lit("RACK-"), "switch").alias("rack_id"),
        F.format_string("BLADE-%s-%02d", F.col("switch"), blade).alias("blade_id"),
        (cabinet * CABINET_X + place * RACK_X + seat * NODE_X).cast("double").alias("x"),
        (blade * BLADE_Y).cast("double").alias("y"), F.lit(0.0).alias("z"),
        F.lit(cpus).alias("cpus"), F.lit(cores).alias("cores_per_cpu"),
        F.col("rack").cast("int").alias("rack_pos"), F.col("slot").alias("slot"))


def nested_map(nodes: DataFrame, system_name: str) -> DataFrame:
    """Nodes folded back into one nested map, level by level; a map is bounded by its cluster.

    Positions are absolute, so cabinets and racks carry zero offsets and nodes the whole one.
    """
    def listed(*fields: Column) -> Column:
        return F.array_sort(F.collect_list(F.struct(*fields)))

    node = listed("slot", "hostname", F.col("x").alias("x_offset"), "cpus", "cores_per_cpu")
    level = nodes if "slot" in nodes.columns else nodes.withColumn("slot", F.lit(0))
    blades = level.groupBy("cab_id", "rack_id", "blade_id", F.col("y").alias("y_offset"), "z").agg(node.alias("nodes"))
    racks = blades.groupBy("cab_id", "rack_id", F.col("z").alias("z_offset")).agg(
        listed(F.col("blade_id").alias("id"), "y_offset", "nodes").alias("blades"))
    cabs = racks.groupBy("cab_id").agg(
        listed(F.col("rack_id").alias("id"), F.lit(0.0).alias("x_offset"), "z_offset", "blades").alias("racks"))
    return cabs.agg(listed(F.col("cab_id").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"),
                           "racks").alias("cabinets")) \
        .select(F.struct(F.lit(system_name).alias("system_name")).alias("metadata"), "cabinets")


def write_hardware_map(nodes: DataFrame, path: str, system_name: str = "Unknown Cluster") -> None:
    nested_map(nodes, system_name).write.mode("overwrite").json(path)
