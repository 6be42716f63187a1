"""Connected components of a large undirected graph, by joins alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a long, b long) edges -> (v long, root long): root is the smallest vertex reachable from v.

    Every round each vertex takes the smallest label of itself and its neighbours, then the label of that
    label (pointer jumping), so paths shorten geometrically. Labels and edges stay distributed; each round is
    cut by a checkpoint. Null ends and self-loops are ignored; repeated edges count once; no edges, no rows.
    """
    both = edges.where("a <> b")
    both = cut(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")))
    for _ in range(rounds):
        near = (
            both.join(labels, both["b"] == labels["v"])
            .groupBy("a")
            .agg(F.min("root").alias("near"))
        )
        step = labels.join(near, labels["v"] == near["a"]).select("v", "root", F.least("root", "near").alias("to"))
        up = labels.select(F.col("v").alias("to"), F.col("root").alias("top"))
        low = F.least("to", "top")
        step = cut(step.join(up, "to").select("v", low.alias("new"), (low != F.col("root")).alias("moved")))
        moved = step.agg(F.count_if("moved")).first()[0]
        labels = step.select("v", F.col("new").alias("root"))
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
