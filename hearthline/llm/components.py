"""Connected components by alternating large-star and small-star steps.

Large: an edge's lesser end gives way to that end's own least neighbour (a
pre-aggregated minimum and a join). Small: what a node has of lesser neighbours is
joined to the least of them (a running minimum, once the edges are dealt by that
node). Neither the driver nor one task holds a component; the edges shrink to stars
in a number of rounds that grows with the logarithm of the size. A round shuffles
three times and ends in the shared checkpoint folder.

No step adds an edge, and one that leaves their number as it was makes the sum of
all ends less, unless the edges are stars: so number and sum tell when to stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import cut

ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    upto = Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # holds no rows
    least = edges.repartition("u").distinct().withColumn("m", F.min("v").over(upto))
    return least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def members(stars: DataFrame) -> DataFrame:
    """(id, component) of every node of stars (u, v) around their least nodes v."""
    both = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))
    return stars.select(F.explode(both).alias("x")).select("x.id", "x.component").distinct()


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, component) of every node of the edges (u, v): component is the least id that links reach.

    Loops and repeated edges change nothing; rows with a null end are left out.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v")
    now = cut(_small(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.col("u").cast("decimal(20,0)") + F.col("v").cast("decimal(20,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, now = mark, cut(_small(_large(now)))
    else:
        raise RuntimeError("components have not settled")
    return members(now)
