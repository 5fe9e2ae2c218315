"""Connected components of a link table, as a Spark loop of min-label passing and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import saved


def connected_components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``(node, component)`` of every node that has a link: the smallest node reachable.

    Each round passes the smallest label over every link (aggregated on the map side, so a hub is no
    hot task) and then replaces each label by its label's label, which halves the remaining
    distance; long chains need a logarithmic number of rounds. Every round is written to the
    checkpoint folder. Only the count of changed labels reaches the driver. Links with a null end
    and links of a node with itself are ignored.
    """
    ends = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    ways = F.array(F.struct(F.col(left).alias("src"), F.col(right).alias("dst")), F.struct(F.col(right).alias("src"), F.col(left).alias("dst")))
    both = saved(ends.select(F.inline(ways)).distinct())
    labels = saved(both.groupBy("src").agg(F.min("dst").alias("near")).select(F.col("src").alias("node"), F.least("src", "near").alias("label")))
    while True:
        heard = both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("heard"))
        passed = saved(labels.join(heard, labels["node"] == heard["dst"], "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("was")))
        up = passed.select(F.col("node").alias("label"), F.col("label").alias("above"))
        fresh = saved(passed.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), "was"))
        changed = fresh.where(F.col("label") != F.col("was")).limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
