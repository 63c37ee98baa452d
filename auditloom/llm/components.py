"""Connected components of a link table, in rounds of joins over the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.store import discard, shuffles_dropped, stored


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Each node links its larger (or its not larger) neighbours, and itself, to its least neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if larger:
        linked = linked.where("v > u")
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that a link (u, v: long) names.

    Alternating large and small stars until nothing changes: a number of rounds that grows with the logarithm of the
    nodes. Neighbours are never gathered, so a node may have any number of links.
    """
    now = stored(links.where("u != v").select("u", "v").distinct(), "components")
    state = None
    while True:
        before, now = now, stored(_star(_star(now, True), False), "components")
        discard(before)
        with shuffles_dropped(links.sparkSession):
            facts = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (facts["n"], facts["x"]) == state:
            break
        state = (facts["n"], facts["x"])
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
