"""Connected components of a graph given as a table of links.

Each round every node points at the neighbour (or itself) that comes first
in that round's order; nodes are drawn to what they point at, and the links
are rewritten between what is left. Even rounds take the nodes' own order,
which closes a star around its least node at once; odd rounds take a random
order, which removes a constant share of the nodes that still have links,
whatever the graph, so rounds grow with the logarithm of its size. Rounds are
cut with ``checkpoint()`` into the folder that the cluster names; nothing is gathered
in one place, and a node with very many links is pre-aggregated before its
minimum is taken.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Hand the session's spark.checkpoint.dir to its context. Where it is unset, a session of one machine (as in
    tests) gets a folder of its own; a cluster must name one that all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexprep-checkpoints-")
        sc.setCheckpointDir(folder)


def components(links: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another; ``component`` is the smallest node it reaches.

    Links may repeat, run both ways or join a node to itself; rows with a null end are left out."""
    use_checkpoint_dir(links.sparkSession)
    a, b = F.col("a"), F.col("b")
    edges = (links.select(F.col(left).alias("a"), F.col(right).alias("b")).where(a != b)
             .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().checkpoint())
    moves = None  # (node, at): where each original node has been drawn so far
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.select("a", "b").union(edges.select(b, a))
        order = lambda c: F.xxhash64(F.lit(k), c) if k % 2 else c
        step = (ends.groupBy(a.alias("node")).agg(F.min(F.struct(order(b).alias("h"), b.alias("v"))).alias("m"))
                .select("node", F.when(F.struct(order(F.col("node")).alias("h"), F.col("node").alias("v")) <= F.col("m"),
                                       F.col("node")).otherwise(F.col("m")["v"]).alias("to")).checkpoint())
        if moves is None:
            moves = step.select("node", F.col("to").alias("at"))
        else:
            moves = (moves.join(step.select(F.col("node").alias("at"), "to"), "at", "left")
                     .select("node", F.coalesce("to", "at").alias("at")))
        x, y = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = (edges.join(x, "a").join(y, "b").where(F.col("x") != F.col("y"))
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint())
    else:
        raise RuntimeError("the components did not close")
    if moves is None:
        return edges.select(a.alias("node"), a.alias("component"))
    moves = moves.checkpoint()
    least = moves.groupBy("at").agg(F.min("node").alias("component")).checkpoint()
    return moves.join(least, "at").select("node", "component")
