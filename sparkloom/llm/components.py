"""Connected components of links, by contraction: each round, nodes join their smallest neighbour and the graph shrinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import HOT, few, join_hot
from .runtime import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); a component's name is one of its nodes. No row is collected.

    Nodes of many links (the centres of stars) are joined by a broadcast of those few nodes. Each round's tables are
    dropped as soon as the next are written.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "edges")
    names = written(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node")), "names")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"), F.count(F.lit(1)).alias("links")), "parents")
        hot = few(up.where(F.col("links") * HOT > edges.agg(F.count(F.lit(1)).alias("n")).scalar()), ["a"])  # fewer than 2 * HOT nodes
        far = up
        for _ in range(2):  # pointers skip ahead; every step stays within the component
            onward = far.select(F.col("a").alias("x"), F.col("p").alias("q"))
            far = far.join(onward, F.col("p") == F.col("x"), "left").select("a", F.coalesce("q", "p").alias("p"))
        far = written(far, "parents")
        old = names
        names = written(names.join(far, names["component"] == far["a"], "left").select("node", F.coalesce("p", "component").alias("component")), "names")
        to = lambda c: far.select(F.col("a").alias(c), F.col("p").alias(f"{c}1"))
        moved = join_hot(join_hot(edges, to("a"), ["a"], hot=hot), to("b"), ["b"], hot=hot)
        less = written(moved.select(F.col("a1").alias("a"), F.col("b1").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop(edges, up, far, old)
        edges = less
    drop(edges)
    return names
