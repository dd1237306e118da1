"""Connected components of a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def components(links: DataFrame) -> DataFrame:
    """v, label of every end of links (a, b, of one type that can be ordered): label is the smallest v
    reachable. Each round takes the smallest label among the neighbours and then the label of that
    label, so that the rounds grow with the logarithm of the longest path for most graphs. A hub is
    no hot task: its rows are summed up before they are shuffled, and the join by neighbour can be split.

    Defined results: links from a v to itself, repeated links and null ends add nothing; a null end's
    other end is left out too if it has no other link; an empty table gives no rows; other columns are ignored."""
    links = links.where("a != b")
    edges = stash(links.select("a", "b").union(links.select("b", "a")).toDF("v", "w").dropDuplicates())
    held = labels = stash(edges.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("label")))
    while True:
        near = edges.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        jump = stash(labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        hop = jump.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = stash(jump.join(hop, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        discard(held, jump)
        held, labels = new, new.select("v", "label")
        if not new.where("label != old").limit(1).count():
            discard(edges)
            return labels
