"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasemill.llm.shared import Work


def components(links: DataFrame, work: Work | None = None) -> DataFrame:
    """links (u, v) -> (id, component): the smallest id that each linked id reaches, itself included.

    Each round takes the smallest label among a node and its neighbours and then the label of that
    label, so distances halve; it ends with the round that changes nothing. Minima are combined
    before their shuffle, and both joins read written tables by shuffles of their own, so that
    adaptive execution can split the rows of a hub or of a large component among tasks. Self-links
    count as nodes, repeated and reversed links change nothing, rows with a null are dropped. No
    links give no rows.
    """
    work = work or Work(links.sparkSession, "components")
    clean = links.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL")
    edges = work.settled(clean.union(clean.select("v", "u")).distinct(), "edges")
    labels = work.settled(edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("low")).select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("low"))
        lower = work.settled(labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "low").alias("component")), "lower")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        stepped = work.settled(lower.join(jump, "component", "left").select("id", "was", F.coalesce("further", "component").alias("component")), "labels")
        labels = stepped.select("id", "component")
        if stepped.filter("component <> was").isEmpty():
            return labels
