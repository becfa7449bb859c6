"""Connected components of an undirected graph of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstack.llm.common import Table


def connected_components(edges: DataFrame, rows: int | None = None) -> Table:
    """(id, component) for every end of ``edges`` (a, b); the component is its smallest id.

    Each round takes the smallest label among neighbours and then the label of
    that label, so long chains halve.  Rounds are tables of the shared folder;
    ``rows`` is about the number of ends at most.
    """
    both = Table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links", rows=rows)
    labels = Table(both.df.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", rows=rows)
    while True:
        old = labels.df.withColumnRenamed("component", "c")
        near = both.df.join(old, both.df.b == old.id).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.df.join(near, labels.df.id == near.a).select("id", "component", F.least("component", "m").alias("m"))
        up = labels.df.select(F.col("id").alias("m"), F.col("component").alias("top"))
        new = Table(step.join(up, "m", "left").select("id", F.least("m", F.coalesce("top", "m")).alias("component"), F.col("component").alias("was")), "labels", rows=rows)
        changed = new.df.where("component <> was").limit(1).count()
        labels.drop()
        labels, labels.df = new, new.df.drop("was")
        if not changed:
            both.drop()
            return labels
