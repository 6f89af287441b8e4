"""Let executors import this package where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARES = 4  # tasks for each core of what is spread
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send the package's sources along with the session, once; Spark serves the archive to the executors."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(context, "_hearthline_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="hearthline-")) / "hearthline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._hearthline_shipped = True


def folder(spark: SparkSession) -> str:
    """The folder for intermediate results that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset a session of one process gets a temporary one, as in tests, and a cluster an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hearthline-"))
    return context.getCheckpointDir()


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """A query made and run inside leaves no shuffle files; else they stay until the driver's garbage is collected."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; what was shuffled for it is released."""
    folder(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, as a plan keeps its shuffle files or not from its making


def numbered(df: DataFrame, order: list[Column], name: str, kind: str = "int") -> DataFrame:
    """df with each row's place (from 1) in an order of all rows; ranges are counted first, so no window holds them all."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as partitions
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(parts), "_part").withColumn(name, (F.col("_before") + inside).cast(kind)).drop("_part", "_before")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to several tasks for each core, for work that is long for each row of a small file (which one task may hold)."""
    return df.repartition(SHARES * df.sparkSession.sparkContext.defaultParallelism, *keys)
