"""Connected components of an undirected graph, distributed.

Alternating large-star and small-star steps: each step links nodes to the least node they
know of, by a minimum per node that is combined map-side and a join that adaptive
execution may split where a node has very many edges. Every step's edges are written to
the shared folder, which cuts the lineage. Steps repeat until the edges stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.runtime import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (else smaller) neighbours to its least neighbour, itself included."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        # The minima are written, so the join is between two plain exchanges and a node of very many edges is split.
        out = both.join(written(least, "least"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b of one ordered type. Gives node, label: the least node of its component. Nodes without an edge have no row."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
        edges = written(_star(written(_star(edges, True), "stars"), False), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
