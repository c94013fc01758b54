"""Consolidating pairwise matches into groups: deterministic Borůvka hooking.

Each round works on the graph of components.  Every component selects its smallest
outgoing edge, which for edges ordered by (smaller end, larger end) is the edge to its
smallest neighbour.  As the edges are totally ordered, the selected edges form trees
whose only cycle is the one edge that two components both select; the smaller of those
two is the root, and it is also the smallest member of its tree: above any component
that points to a larger one stands one that is smaller than both.  Trees collapse by
pointer doubling, edges are relabelled by their roots and deduplicated, and a round
leaves at most half of the components that still have edges.  A component's label is
therefore its smallest member throughout, and the result is the same on every run.

Cost: O(log n) rounds, each a map-side combined minimum and two joins on unique keys
over edges that shrink.  Every round's tables are written to the shared folder, so the
lineage stays short and a lost executor costs one step.  A component that holds a third
of all nodes is one key of the joins' *many* side only, which adaptive execution splits;
its minimum is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuschain.runtime import Scratch, shuffled


def components(pairs: DataFrame, left: str, right: str, vertices: DataFrame | None = None, vertex: str = "id") -> DataFrame:
    """One row ``(id, group_id)`` for each id in a group of two or more; group_id is the smallest id of the group.

    ``pairs`` may hold repeats, either direction, self pairs and nulls; self pairs and
    pairs with a null connect nothing.  With ``vertices`` only pairs whose both ids stand in
    its column ``vertex`` count.  Other columns of either table are ignored, whatever their
    names.  No pairs give no rows.
    """
    spark = pairs.sparkSession
    edges = _ordered(pairs.select(F.col(left).alias("u"), F.col(right).alias("v")))
    if vertices is not None:
        known = vertices.select(F.col(vertex).alias("id")).where(F.col("id").isNotNull())
        for end in ("u", "v"):
            edges = edges.join(shuffled(known.withColumnRenamed("id", end)), end, "left_semi")
    scratch = Scratch(spark, "components")
    edges = scratch.cut(edges, "edges")
    left_over = edges.count()
    rounds: list[DataFrame] = []
    while left_over:
        parent = _collapse(_select(edges), scratch, f"parent-{len(rounds)}")
        rounds.append(parent)
        edges = scratch.cut(_relabel(edges, parent), "edges")
        left_over = edges.count()
        scratch.drop("edges")
    if not rounds:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    # From the last, smallest map of components to the first, which holds all ids.
    final = rounds.pop()
    while rounds:
        upper = final.select(F.col("u").alias("p"), F.col("p").alias("top"))
        final = rounds.pop().join(shuffled(upper), "p", "left").select("u", F.coalesce("top", "p").alias("p"))
    return final.select(F.col("u").alias("id"), F.col("p").alias("group_id"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges between different nodes, once each, smaller end first."""
    return edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _select(edges: DataFrame) -> DataFrame:
    """(u, p): each component and the other end of its smallest edge; roots point to themselves."""
    ends = F.array(F.struct(F.col("u"), F.col("v").alias("p")), F.struct(F.col("v").alias("u"), F.col("u").alias("p")))
    chosen = edges.select(F.inline(ends)).groupBy("u").agg(F.min("p").alias("p"))
    back = chosen.select(F.col("u").alias("p"), F.col("p").alias("pp"))
    root = (F.col("pp") == F.col("u")) & (F.col("u") < F.col("p"))
    return chosen.join(shuffled(back), "p").select("u", F.when(root, F.col("u")).otherwise(F.col("p")).alias("p"))


def _collapse(parent: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Pointer doubling until every node points to its root; ``name`` is that of the tables written, of which the last stays."""
    parent = scratch.cut(parent, name)
    while True:
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        step = parent.join(shuffled(above), "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
        step = scratch.cut(step, name)
        scratch.drop(name)
        moved = step.where("moved").limit(1).count()
        parent = step.select("u", "p")
        if not moved:
            return parent


def _relabel(edges: DataFrame, parent: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        edges = edges.join(shuffled(parent.select(F.col("u").alias(end), F.col("p").alias(f"{end}_root"))), end)
    return _ordered(edges.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
