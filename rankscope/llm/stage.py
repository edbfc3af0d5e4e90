"""Steps shared by the operators: written intermediate tables, connected components, carried columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankscope.session import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, so that a lost executor costs no earlier step."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carried(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of ``df`` that go through an operator: all whose names it does not give to a result of its own."""
    taken = {name.lower() for name in made}
    return [c for c in df.columns if c.lower() not in taken]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every end of the links ``(a, b)``; a component is named by its smallest id.

    Every round takes the smallest label of the neighbours and then the label's own label, and is written
    down. Links that point to local roots need three or four rounds; a chain needs the logarithm of its length.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
                     .select("id", F.least("id", "least").alias("component")), "labels")
    for _ in range(rounds):
        near = (both.join(labels.withColumnRenamed("id", "b"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        met = labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("old"))
        roots = labels.select(F.col("id").alias("to"), F.col("component").alias("further"))
        step = written(met.join(roots, "to").select("id", F.least("to", "further").alias("component"),
                                                    (F.least("to", "further") < F.col("old")).alias("moved")), "labels")
        labels = step.select("id", "component")
        if step.filter("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
