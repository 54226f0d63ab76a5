"""Connected components of links, without gathering the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millweir.session import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each node's connected component; edges (a, b), nodes of any ordered type.

    Least labels spread along edges and jump along labels, so rounds grow with the logarithm of a component's width. Each round is
    written to the shared folder, where it replaces the one before; nothing of the graph goes to the driver but whether labels changed.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(edges.select(F.inline(ways)).distinct(), "edges")
    labels = last = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("other"))
        moved = labels.join(spread.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "other").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        new = materialize(moved.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("above", "comp")).alias("comp")), "labels")
        release(last)
        last, labels = new, new.select("node", "comp")
        if not new.where("comp <> old").limit(1).count():
            release(both)
            return labels
