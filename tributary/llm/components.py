"""Connected components of a table of links, by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """(v, label), a written table, for every end of ``links`` (long columns a, b): label is the least node of its component.

    Each round takes the least label among the neighbours and then the label of that
    label, so rounds grow with the logarithm of a component's width.  Every round is
    a join and a combined minimum over a written table; only a count comes back.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select("v", "label"), both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels["v"] == near["a"], "left").select("v", "label", F.least("label", "m").alias("to"))
        step = materialize(step, "labels-step")
        up = step.select(F.col("v").alias("u"), F.col("to").alias("top"))
        new = materialize(step.join(up, step["to"] == up["u"], "left").select("v", F.least("to", "top").alias("label"), (F.least("to", "top") < F.col("label")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        release(spark, labels, step)
        labels = new
        if not moved:
            release(spark, both)
            out = labels.select("v", "label")
            out._written = new._written
            return out
