"""Connected components over an edge table, by alternating large-star and small-star steps.

The method of Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each step is one
window pass, every step's edges are written to the shared folder, and the number of steps
grows with the logarithm of the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_written, written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): each node of `edges` with the least node of its component.

    Loops and edges with a null end are ignored; repeated edges count once; no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    edges = written(edges.where("ok and u <> v").select("u", "v").distinct())
    before = _mark(edges)
    of_u = Window.partitionBy("u")
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(of_u), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.withColumn("m", F.min("v").over(of_u))
        pairs = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = written(pairs.select("e.u", "e.v").where("u <> v").distinct())
        drop_written(edges)
        edges, now = nxt, _mark(nxt)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def sure_links(members: DataFrame, limit: int) -> DataFrame:
    """(id, n): by weight, how many others y of its group each x of members (label, id, w, q) has with q of x + q of y <= limit.

    Counted by a histogram of q for each label, of at most limit + 1 values, so no task takes a whole group.
    """
    counts = members.where(F.col("q") <= limit).groupBy("label", "q").agg(F.sum("w").alias("w"))
    asked = counts.select("label", (limit - F.col("q")).alias("q"), F.lit(0).cast("bigint").alias("w"))
    upto = Window.partitionBy("label").orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.select("label", "q", "w").union(asked).groupBy("label", "q").agg(F.sum("w").alias("w")).select("label", F.col("q").alias("at"), F.sum("w").over(upto).alias("upto"))
    rows = members.where(F.col("q") <= limit).withColumn("at", limit - F.col("q")).join(sums, ["label", "at"])
    own = F.when(2 * F.col("q") <= limit, F.col("w")).otherwise(0)
    return rows.select("id", (F.col("upto") - own).cast("bigint").alias("n"))
