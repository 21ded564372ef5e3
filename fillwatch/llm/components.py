"""Connected components by hooking and contraction; links and labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import stored


def _ends(links: DataFrame) -> DataFrame:
    return stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """``v, c`` for each end of ``links(a, b)``; ``c`` is the least vertex that can be reached.

    Each vertex hooks onto its least neighbour if that is less; jumps shrink the trees to stars, by halves. Then links
    are taken between the roots, and those within a tree go, so that each level has at most half the vertices of
    the one before and only the first sees all links. Minima are merged before the shuffle.
    """
    ends, out = _ends(links), None
    while True:
        label = stored(ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
        while True:
            jump = stored(label.join(label.select(F.col("v").alias("c"), F.col("c").alias("j")), "c").select("v", "c", "j"), "labels")
            label = jump.select("v", F.col("j").alias("c"))
            if jump.where("c <> j").isEmpty():
                break
        out = label if out is None else merged(out, label)
        root = ends.join(label.select(F.col("v").alias("a"), F.col("c").alias("x")), "a").join(label.select(F.col("v").alias("b"), F.col("c").alias("y")), "b")
        ends = stored(root.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if ends.isEmpty():
            return out


def merged(label: DataFrame, roots: DataFrame) -> DataFrame:
    """``label(v, c)`` after its roots ``c`` got the labels ``roots(v, c)``."""
    new = roots.select(F.col("v").alias("c"), F.col("c").alias("r"))
    return stored(label.join(new, "c", "left").select("v", F.coalesce("r", "c").alias("c")), "labels")


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that ``label(v, c)`` was made of together with ``links``, which are few: only they are walked."""
    links = links.where("a <> b")
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(label.select(F.col("v").alias(end), "c"), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    met = stored(ends.where("a <> b"), "links")
    fresh = links.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(label, "v", "left_anti").select("v", F.col("v").alias("c"))
    label = label.unionByName(fresh)
    return stored(label, "labels") if met.isEmpty() else merged(label, components(met))
