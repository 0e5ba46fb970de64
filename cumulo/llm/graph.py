"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cumulo.llm.common import few_tasks, stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least v of each u; adaptive execution splits the join of a u with very many."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("least")), "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is the smallest node it reaches.

    Ids are longs; links may repeat, run either way or join a node to itself.
    Rows with a null end are left out. No links give no rows. A round shuffles six
    times, so its tasks go by the counted edges.
    """
    ends = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    # Always from the larger node to the smaller one.
    edges = stored(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen, rows = now, 2 * now[0]
        both = few_tasks(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows)
        large = few_tasks(_with_least(both), rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        small = few_tasks(_with_least(few_tasks(large.where("u <> v").distinct(), rows)), rows)
        small = small.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e"))
        edges = stored(few_tasks(small.select("e.*").where("u <> v").distinct(), rows))
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    alone = ends.where("x = y").select(F.col("x").alias("u"), F.col("y").alias("v"))
    return edges.where("u <> v").unionByName(roots).unionByName(alone).groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.col("v").alias("component"))
