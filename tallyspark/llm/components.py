"""Connected components of an edge table by contraction.

Each round points every node at its smallest neighbour if that is smaller,
follows the pointers to their roots, and contracts the edges to the roots.
Rounds and pointer steps are tables in the shared folder; nothing but row
counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, label) for every node of ``edges`` (columns a, b: long): label is
    one node of the component, the same for all its nodes; read from tables of
    ``scratch``.  Nulls and loops
    are ignored; an empty edge table gives an empty result."""
    table = scratch.table
    edges = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    live = table(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = None
    while not live.isEmpty():
        up = table(live.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")), "cc-up")
        while True:
            nxt = up.alias("x").join(up.select(F.col("a").alias("k"), F.col("up").alias("upup")), F.col("x.up") == F.col("k"))
            nxt = table(nxt.select("a", "up", "upup"), "cc-jump")
            done = nxt.where("up <> upup").isEmpty()
            up = nxt.select("a", F.col("upup").alias("up"))
            if done:
                break
        if label is None:
            label = up.select(F.col("a").alias("c"), F.col("up").alias("label"))
        else:
            step = up.select(F.col("a").alias("k"), "up")
            label = label.join(step, label.label == step.k, "left").select("c", F.coalesce("up", "label").alias("label"))
            label = table(label, "cc-label")
        a, b = up.select("a", F.col("up").alias("ra")), up.select(F.col("a").alias("b"), F.col("up").alias("rb"))
        live = live.join(a, "a").join(b, "b").where("ra <> rb")
        live = table(live.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-edges")
    if label is None:
        return live.select(F.col("a").alias("c"), F.col("b").alias("label"))
    return label
