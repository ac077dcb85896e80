"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.llm.common import shared_table


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    Each round a node takes the smallest label next to it, passes it to the node its old
    label names, and follows the label of its label, so distances shrink by a factor a round
    and not by one edge.  Each round's labels are written to the shared folder; only the
    number of changes reaches the driver.  Minimums are taken before a shuffle, so a node
    with very many edges or followers stays cheap."""
    u, v = F.col(left), F.col(right)
    both = shared_table(
        edges.where((u != v) & u.isNotNull() & v.isNotNull())
        .select(F.explode(F.array(F.struct(u.alias("node"), v.alias("other")),
                                  F.struct(v.alias("node"), u.alias("other")))).alias("e"))
        .select("e.*").distinct(), "edges")
    labels = shared_table(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other")
                .select("node", "seen"))
        taken = (near.unionByName(labels.select("node", F.col("root").alias("seen")))
                 .groupBy("node").agg(F.min("seen").alias("seen")))
        old = labels.join(taken, "node")
        passed = old.select(F.col("root").alias("node"), "seen")
        hooked = (taken.unionByName(passed).groupBy("node").agg(F.min("seen").alias("seen")))
        hooked = shared_table(hooked, "hooked")
        followed = hooked.select(F.col("node").alias("seen"), F.col("seen").alias("next"))
        new = shared_table(
            hooked.join(followed, "seen").select("node", F.least("seen", "next").alias("root"))
            .join(labels.select("node", F.col("root").alias("was")), "node"), "labels")
        changed = new.where("root <> was").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
