"""Connected components by contraction, entirely in DataFrame joins and aggregates.

Each round hooks every node onto its smallest smaller neighbour (a partial aggregate, so a hub's
edges are combined before they move), shortens the hooks to roots by pointer jumping, and rewrites
the edges between roots. Edges inside a component vanish, so the edge table shrinks every round and
a star, however large, is done in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.scratch import Scratch


def _roots(scratch: Scratch, parent: DataFrame) -> DataFrame:
    """(node, root) from (node, root) where a root may itself be a node: pointer jumping."""
    while True:
        up = parent.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        jumped = scratch.save(
            parent.join(up, F.col("root") == F.col("__n"), "left").select(
                "node", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")
            ),
            "jump",
        )
        parent = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parent


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its own component's smallest node.

    edges: columns a and b of one type, in any direction, repeats and loops allowed. Nodes that are
    absent from the result are roots. An empty edge table gives an empty result.
    """
    edges = scratch.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    done: DataFrame | None = None
    while not edges.isEmpty():
        hooks = scratch.save(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        roots = _roots(scratch, hooks)
        if done is None:
            done = roots
        else:  # what earlier rounds hooked onto a node that now has a root of its own
            up = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
            moved = done.join(up, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))
            done = scratch.save(moved.unionByName(roots), "done")
        hi = roots.select(F.col("node").alias("hi"), F.col("root").alias("__hi"))
        lo = roots.select(F.col("node").alias("lo"), F.col("root").alias("__lo"))
        ends = edges.join(hi, "hi", "left").join(lo, "lo", "left").select(
            F.coalesce("__hi", "hi").alias("x"), F.coalesce("__lo", "lo").alias("y")
        )
        edges = scratch.save(
            ends.filter("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges"
        )
    if done is None:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return done
