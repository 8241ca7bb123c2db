"""Connected components of an edge table by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmetrics.llm.common import default_partitions, written

FEWER = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of edges (a, b): label is the smallest id of the component.

    In a round every id takes the smallest of itself and its neighbours, then the label of its label
    until it stands on a root; ids with one root become one, and edges inside it go. Minima
    combine before they move, so an id with many edges costs one row per task. Rounds and jumps
    grow with the logarithm of the component, and each result is in the shared folder.
    """
    pairs = distinct_pairs(edges.select("a", "b"))
    labels = None
    while labels is None or not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = on_roots(
            kept(
                both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id"), "roots"
            )
        )
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            above = roots.withColumnRenamed("id", "label")
            labels = kept(
                labels.join(above, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels"
            )
        left = roots.select(F.col("id").alias("a"), F.col("root").alias("left"))
        right = roots.select(F.col("id").alias("b"), F.col("root").alias("right"))
        pairs = distinct_pairs(pairs.join(left, "a").join(right, "b").select(F.col("left").alias("a"), F.col("right").alias("b")))
    return labels


def kept(frame: DataFrame, label: str) -> DataFrame:
    """A table of a round, in an eighth of the session's shuffle partitions.

    Its rows are two or three numbers, while partitions are sized for texts; a round writes several tables, and each
    partition is a file.
    """
    return written(frame.coalesce(max(2, default_partitions(frame) // FEWER)), label)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair of different ids once, the smaller one first."""
    return kept(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def on_roots(roots: DataFrame) -> DataFrame:
    """Every id with the root that its chain of roots ends at."""
    while True:
        above = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        jumped = kept(roots.join(above, "root").select("id", "root", "above"), "roots")
        roots = jumped.select("id", F.col("above").alias("root"))
        if jumped.where("root <> above").isEmpty():
            return roots
