"""Connected components on Spark by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import intermediate_tables, join_groups, materialize, record_tables, remove_tables, salted, salts_seen


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the component's smallest node.

    Each round writes its edges to the shared folder and removes those of the round before.  A large-star step
    links every larger neighbour of a node to the smallest node around it, a small-star step does so for the
    smaller ones; the graph is done when every node points at its root, however many rounds that takes.  A hub's
    edges are joined with one row (its minimum) in both steps; they are salted by the neighbour, so that no task
    gets them all.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    with intermediate_tables() as old:
        edges = materialize(edges, "components")
    settled = False
    while not settled:
        with intermediate_tables() as made:
            both = salted(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v")
            least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), salts_seen())
            large = join_groups(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = salted(materialize(large, "components-large"), "v")
            m = large.groupBy("u").agg(F.min("v").alias("m"), salts_seen())
            small = join_groups(large, m, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v")
            edges = materialize(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "components")
        # done: every node has one parent, and no parent has a parent
        parents = edges.groupBy("u").agg(F.count("*").alias("n"))
        open_nodes = parents.where("n > 1").select("u").unionByName(edges.join(parents.select(F.col("u").alias("p")), F.col("v") == F.col("p"), "left_semi").select("u"))
        settled = open_nodes.isEmpty()
        remove_tables(spark, [*old, made[0]])
        old = made[1:]
    record_tables(old)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
