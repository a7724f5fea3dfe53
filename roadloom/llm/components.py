"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import checkpointed

#: Vertices with more neighbours are looked up in a table of their own, so that no task gets all their links.
HUB = 1000
#: Most rows of two longs that are broadcast.
SMALL = 100_000


def connected_components(links: DataFrame, hub: int = HUB) -> DataFrame:
    """``(id, label)`` for each id in ``links(a, b)``; the label is the smallest id that can be reached.

    Each round takes the smallest label among a vertex and its neighbours, then
    the label's own label (pointer jumping), so chains shorten by more than half.
    Self-links and repeated links are allowed; no links give no rows. Every round
    is written to the shared checkpoint folder: a lost executor costs one round.

    Links to vertices with over ``hub`` neighbours meet those vertices' labels apart from the others, and labels that
    have a smaller label above them are a table of their own. Both tables are counted, and up to ``SMALL``
    rows they are broadcast, so that no task gets all that a hub or a label has.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label"))
    labels = checkpointed(labels)
    hubs = checkpointed(both.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("b"))
    n_hubs = hubs.count()
    if not n_hubs:
        parts = [(both, None)]
    else:
        parts = [(checkpointed(both.join(hubs, "b", "left_anti")), None), (checkpointed(both.join(hubs, "b", "left_semi")), hubs)]
    while True:
        seen = None
        for part, own in parts:
            of = labels.withColumnRenamed("id", "b")
            met = part.join(of if own is None else _sent(own.join(of, "b"), n_hubs), "b").select("a", "label")
            seen = met if seen is None else seen.union(met)
        seen = seen.groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, F.col("id") == F.col("a"), "left").select(
            "id", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        # a vertex's new label is one that it or a neighbour had
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("above")).where("above <> label")
        above = checkpointed(labels.select("label").distinct().join(above, "label"))
        n_above = above.count()
        if n_above:
            step = step.join(_sent(above, n_above), "label", "left").select("id", "before", F.least("label", "above").alias("label"))
        step = checkpointed(step)
        labels = step.select("id", "label")
        if step.where("label <> before").isEmpty():
            return labels


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SMALL else table
