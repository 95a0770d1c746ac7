"""Connected components of a graph by minimum labels and pointer jumps, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import looked_up, removed, written


def components(edges: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """node, component and root: the smallest rank that each node with an edge reaches, its own included, and the least node that has it there.

    edges: a long, b long, any direction, repeats and loops allowed. nodes: node long (unique), rank long;
    ranks may tie, so only root tells components apart. Each round takes the least label of the neighbours, then the label of the label, so long
    chains take a logarithm of their length in rounds. Only the newest round's table is kept.
    """
    spark = edges.sparkSession
    both = edges.where("a != b").select("a", "b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, f"{folder}/edges")
    if not both.head(1):
        return nodes.sparkSession.createDataFrame([], "node long, component long, root long")
    label = written(
        both.select(F.col("a").alias("node")).distinct().join(nodes, "node").select("node", F.struct("rank", "node").alias("label")),
        f"{folder}/labels-0",
    )
    step, nodes_there = 0, label.count()
    while True:
        step += 1
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        least = written(least, f"{folder}/near-{step}")
        # a large component has one label, so its nodes are looked up as hot keys are
        wanted = least.groupBy(F.col("next.node").alias("at")).agg(F.count("*").alias("n"))
        jump = wanted.join(least.select(F.col("node").alias("at"), F.col("next").alias("jump")), "at")
        asked = looked_up(least.withColumn("at", F.col("next.node")), jump, "at", "n", nodes_there)
        new = written(asked.select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") != F.col("old")).alias("moved")), f"{folder}/labels-{step}")
        moved = bool(new.where("moved").head(1))
        removed(spark, f"{folder}/labels-{step - 1}")
        removed(spark, f"{folder}/near-{step}")
        label = new.drop("moved")
        if not moved:
            return label.select("node", F.col("label.rank").alias("component"), F.col("label.node").alias("root"))
