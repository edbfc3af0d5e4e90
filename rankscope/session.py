"""Session settings and tables in the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "rankscope") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_made: list[list[str]] = []  # folders made inside each open ``temporary_tables``, innermost last


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that every executor can reach.

    The session's ``spark.checkpoint.dir`` is used. Only a session whose tasks all run in this process may go
    without; it gets a temporary folder. Inside ``temporary_tables`` the folder is removed at the end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rankscope-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove all tables that are written down on the way to a result, once the block that made and stored the result is left.

    A result that was not stored cannot be read afterwards: its plan reads those tables.
    """
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is executed in the block leaves no shuffle files: each is removed with its query, not when its plan is collected at some time. One that is
    asked for again is made again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder, so that a lost executor costs no earlier step."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
