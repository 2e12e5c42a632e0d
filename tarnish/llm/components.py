"""Connected components of a graph of links, label by label, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnish.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b), for every id that has a link.

    Each round takes the least label among neighbours, then the label of that label, so a chain of n links needs about
    log n rounds and a star two. Messages to a hub are combined before the shuffle; each round is stored.
    """
    both = materialize(links.selectExpr("a u", "b v").unionByName(links.selectExpr("b u", "a v")).where("u <> v").distinct(),
                       "component_links")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "id"),
                         "component_labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "id"), "id").selectExpr("id", "label old", "least(label, near) label")
        jump = labels.selectExpr("id label", "label further")
        labels = materialize(lower.join(jump, "label").selectExpr("id", "old", "least(label, further) label"), "component_labels")
        if labels.where("label <> old").isEmpty():
            return labels.selectExpr("id", "label component")
        labels = labels.select("id", "label")
