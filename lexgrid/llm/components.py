"""Connected components of a link table, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.common import Scratch, dealt, hot_keys

#: Rows of one node or one component that go to one task.
HOT = 4096


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b): comp is the smallest node that links
    reach. Each round takes the smallest label among neighbours and then the label's own label, so that
    rounds grow with the logarithm of a component's width. A node of many links and a component of many nodes are
    dealt over tasks, and minima are combined before they move; every round is a written table."""
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    hubs = hot_keys(scratch, both, "b", HOT)
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")))
    while True:
        near = dealt(both, labels.select(F.col("node").alias("b"), "comp"), "b", "a", hubs).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = scratch.keep(labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")))
        of = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = scratch.keep(dealt(step, of, "comp", "node", hot_keys(scratch, step, "comp", HOT)).select("node", "was", F.least("comp", "top").alias("comp")))
        scratch.drop(step, labels)
        labels = new
        if labels.filter("was <> comp").isEmpty():
            scratch.drop(both)
            return labels.select("node", "comp")
