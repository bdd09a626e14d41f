"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from circuitlens.llm.common import Rounds, checkpointed


def components(links: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """The component of every node that has a link: (node, component).

    ``component`` is the smallest node that can be reached. A round takes the
    smallest label among the neighbours (a join on the links and a minimum that
    is combined before the shuffle), then jumps to the label's own label, so
    chains shorten by more than half each time. Each round is cut off by a
    table in the shared folder; the driver sees one count a round. Both joins have a
    shuffle on either side, so a hub's rows can be split.

    Links may repeat, point either way or to themselves; links with a null end
    are no links. Raises if ``max_rounds`` don't suffice, never stops short.
    """
    ends = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = checkpointed(ends.union(ends.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label"))
    keep = Rounds(links.sparkSession)
    labels = keep(labels)
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        lower = labels.union(near).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        jumped = lower.join(up, lower.label == up.at, "left").select("node", F.least("label", "jump").alias("label"))
        before = labels
        labels = keep(jumped)
        if not before.exceptAll(labels).limit(1).count():
            return keep.close(labels.select("node", F.col("label").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
