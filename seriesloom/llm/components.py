"""Connected components of a table of links, by rounds of joins; nothing is gathered on the driver but a flag per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link the least node that links reach; kept in `tables`.

    Each round every node takes the least label among its own and its neighbours', then the label of that label; labels only fall,
    and rounds end when none falls. Stars take two rounds, long chains a number that grows with the logarithm of their length.
    """
    both = tables.keep(links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "links")
    labels = tables.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        # the labels' owners hear it too, so a whole tree falls at once
        told = tables.keep(labels.join(near, "node").select("node", "component", F.least("component", "near").alias("least")), "told")
        heard = told.where("least < component").groupBy(F.col("component").alias("node")).agg(F.min("least").alias("heard"))
        own = told.join(heard, "node", "left").select("node", F.col("component").alias("old"), F.least("least", "heard").alias("mid"))
        jump = own.select(F.col("node").alias("mid"), F.col("mid").alias("jump"))
        fallen = tables.keep(own.join(jump, "mid", "left").select("node", F.least("mid", "jump").alias("component"), (F.col("old") != F.least("mid", "jump")).alias("fell")), "labels")
        tables.drop(labels, told)
        if fallen.where("fell").isEmpty():
            tables.drop(both)
            return fallen
        labels = fallen
