"""Connected components of a graph kept in DataFrames: minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abyssal.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node on an edge (a, b); comp is the least node reachable.

    Each round joins labels to edges with partial aggregation and is written to the shared folder; a star of any size
    needs two rounds. Nodes without an edge are not listed: they are their own component.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    written = labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("comp").alias("c"))
        near = both.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hop = labels.join(near, "node").select("node", "comp", F.least("comp", "c").alias("c"))
        up = labels.select(F.col("node").alias("c"), F.col("comp").alias("cc"))
        new = materialise(hop.join(up, "c").select("node", F.least("c", "cc").alias("comp"), (F.least("c", "cc") < F.col("comp")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        discard(written)
        written, labels = new, new.select("node", "comp")
        if not moved:
            discard(both)
            return labels
