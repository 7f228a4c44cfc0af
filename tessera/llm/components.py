"""Connected components of a table of edges, by rounds of joins.

Each round gives every node the least label among itself and its neighbours and
then the label of its label, so chains shorten by half.  The state is written as
a table in each round: lineage stays short and a lost executor is made good.
Nothing is collected but whether a label has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) for all nodes of edges (a, b).

    The hub of a star is one key of the joins; no aggregate follows a join on its
    own key, so that Spark can split such a key over several tasks.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = stored(near.join(up, "label", "left").select("node", "old", F.least("label", "above").alias("label")), "labels")
        changed = not after.where("label <> old").isEmpty()
        discard(labels)
        labels = after.select("node", "label")
        if not changed:
            discard(both)
            return labels.withColumnRenamed("label", "component")
