"""Networks from ordered chains, their neighbourhoods, and fixpoints over them.

A chain is rows (chain, pos, name), position 1 next to the reader: the row after a narrator is
the teacher.  Windows run inside one chain, which is short; everything else is aggregation on
edges and nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuschain.runtime import Scratch


def links(chains: DataFrame, chain: str, pos: str, name: str, route_start: str | None = None) -> DataFrame:
    """(chain, pos, student, teacher) of adjacent names; none to a null name, to itself, or across a route start."""
    along = Window.partitionBy(chain).orderBy(pos)
    seam = F.coalesce(F.lead(route_start).over(along), F.lit(False)) if route_start else F.lit(False)
    pairs = chains.select(F.col(chain), F.col(pos), F.col(name).alias("student"), F.lead(name).over(along).alias("teacher"), seam.alias("seam"))
    return pairs.where(~F.col("seam") & (F.col("student") != F.col("teacher"))).drop("seam")


def edge_weights(adjacent: DataFrame) -> DataFrame:
    """(teacher, student, weight): how often each pair is adjacent."""
    return adjacent.groupBy("teacher", "student").agg(F.count(F.lit(1)).alias("weight"))


def node_frequencies(chains: DataFrame, key: Column, name: str, chain: str, pos: str) -> DataFrame:
    """(node, freq, name): occurrences of each node, and the first name seen for it."""
    return chains.select(key.alias("node"), name, chain, pos).where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("freq"), F.min_by(F.col(name), F.struct(chain, pos)).alias("name")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): the sorted distinct neighbours of each node in both directions."""
    both = F.array(F.struct(F.col("teacher").alias("node"), F.col("student").alias("other")), F.struct(F.col("student").alias("node"), F.col("teacher").alias("other")))
    return edges.select(F.inline(both)).where(F.col("node").isNotNull() & F.col("other").isNotNull()).distinct().groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("neighbours"))


def neighbours(edges: DataFrame, nodes: DataFrame, node: str, name: str, of: Column, as_teacher: bool, limit: int | None = None) -> DataFrame:
    """(id, name, weight): the students of a node (or its teachers), by weight."""
    here, there = ("teacher", "student") if as_teacher else ("student", "teacher")
    found = edges.where(F.col(here) == of).join(nodes, edges[there] == nodes[node]).select(F.col(node).alias("id"), F.col(name).alias("name"), "weight").orderBy(F.desc("weight"), "id")
    return found.limit(limit) if limit else found


def continuity(adjacent: DataFrame, known: DataFrame, chain: str) -> DataFrame:
    """(chain, n_links, n_seen): of the links of each chain, those that the network knows."""
    seen = known.select("teacher", "student").distinct().withColumn("seen", F.lit(1))
    return adjacent.join(seen, ["teacher", "student"], "left").groupBy(chain).agg(F.count(F.lit(1)).alias("n_links"), F.count("seen").alias("n_seen"))


def context_map(chains: DataFrame, chain: str, pos: str, name: str, least: int = 2) -> DataFrame:
    """(prev, next, full, n): for each pair of neighbours, the one longest name that stands between them.

    A name counts with at least two words; of the names of the most words it must be the only one, and stand
    there at least ``least`` times.
    """
    along = Window.partitionBy(chain).orderBy(pos)
    seen = chains.select(F.lag(name).over(along).alias("prev"), F.col(name).alias("full"), F.lead(name).over(along).alias("next")).where(F.col("prev").isNotNull() & F.col("next").isNotNull() & F.col("full").isNotNull())
    counted = seen.groupBy("prev", "next", "full").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.size(F.split("full", " ")))
    here = Window.partitionBy("prev", "next")
    longest = counted.where(F.col("size") >= 2).withColumn("most", F.max("size").over(here)).where(F.col("size") == F.col("most"))
    return longest.withColumn("rivals", F.count(F.lit(1)).over(here)).where((F.col("rivals") == 1) & (F.col("n") >= least)).select("prev", "next", "full", "n")


def apply_context(chains: DataFrame, chain: str, pos: str, name: str, known: DataFrame) -> DataFrame:
    """(…, resolved): short names between two known neighbours become the name that the map has there, if it continues them."""
    along = Window.partitionBy(chain).orderBy(pos)
    placed = chains.withColumn("_prev", F.lag(name).over(along)).withColumn("_next", F.lead(name).over(along))
    rules = known.select(F.col("prev").alias("_prev"), F.col("next").alias("_next"), F.col("full").alias("_full"))
    joined = placed.join(rules, ["_prev", "_next"], "left")
    short = F.size(F.split(name, " ")) <= 2
    extends = F.startswith("_full", F.concat(F.col(name), F.lit(" ")))
    return joined.withColumn("resolved", F.when(short & extends, F.col("_full")).otherwise(F.col(name))).drop("_prev", "_next", "_full")


def propagate(positions: DataFrame, network: DataFrame) -> DataFrame:
    """(chain, pos, resolved): ambiguous positions resolved from resolved neighbours until nothing changes.

    ``positions`` has chain, pos, candidates (array of names) and route_start; one candidate is resolved.
    ``network`` has (teacher, student).  In each round every unresolved position keeps the candidates
    that are a documented student of its resolved next or teacher of its resolved previous position on the same
    route; exactly one left resolves it.  All positions of a round see the round before, so the result doesn't
    depend on any order; a chain of n positions needs at most n rounds.
    """
    scratch = Scratch(positions.sparkSession, "propagate")
    known = network.select("teacher", "student").where(F.col("teacher").isNotNull() & F.col("student").isNotNull()).distinct()
    state = positions.select("chain", "pos", F.array_distinct("candidates").alias("candidates"), F.coalesce("route_start", F.lit(False)).alias("route_start"))
    state = scratch.cut(state.withColumn("resolved", F.when(F.size("candidates") == 1, F.col("candidates")[0])), "state")
    along = Window.partitionBy("chain").orderBy("pos")
    while True:  # each round resolves a position or is the last
        near = state.select(
            "*",
            F.when(~F.col("route_start"), F.lag("resolved").over(along)).alias("before"),
            F.when(~F.coalesce(F.lead("route_start").over(along), F.lit(False)), F.lead("resolved").over(along)).alias("after"),
        )
        open_ = near.where(F.col("resolved").isNull()).select("chain", "pos", "before", "after", F.explode("candidates").alias("c"))
        as_student = open_.join(known, (open_["c"] == known["student"]) & (open_["after"] == known["teacher"]), "left_semi")
        as_teacher = open_.join(known, (open_["c"] == known["teacher"]) & (open_["before"] == known["student"]), "left_semi")
        kept = as_student.unionByName(as_teacher).select("chain", "pos", "c").distinct().groupBy("chain", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).where("n = 1")
        found = scratch.cut(kept.select("chain", "pos", "c"), "found")
        if not found.limit(1).count():
            break
        state = scratch.cut(state.join(found, ["chain", "pos"], "left").select("chain", "pos", "candidates", "route_start", F.coalesce("resolved", "c").alias("resolved")), "state")
        scratch.drop("state", "found")
    return state.select("chain", "pos", "resolved")


def connected(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): the smallest id that each id is linked with, directly or through others.

    Alternating large-star and small-star steps: every node points its larger neighbours to its smallest one,
    then the smaller ones, until no edge changes; O(log^2 n) rounds, each one aggregation and one join.
    """
    scratch = Scratch(pairs.sparkSession, "connected")
    edges = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).where(F.col("u") != F.col("v"))
    edges = scratch.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        star = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        star = scratch.cut(star.where("u > v"), "edges")
        same = edges.join(star, ["u", "v"], "left_anti").limit(1).count() + star.join(edges, ["u", "v"], "left_anti").limit(1).count()
        edges = star
        scratch.drop("edges")
        if not same:
            break
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def company_tokens(adjacent_names: DataFrame, node: str, neighbours_: str) -> DataFrame:
    """(node, tokens): the words of all neighbours' names."""
    return adjacent_names.select(F.col(node).alias("node"), F.explode(neighbours_).alias("n")).select("node", F.explode(F.split("n", " ")).alias("t")).where("t <> ''").distinct().groupBy("node").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def company_overlap(a: Column, b: Column) -> Column:
    """(jaccard, verdict) of two companies: the same from 0.50, unclear from 0.20, else different."""
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return F.struct(share.alias("jaccard"), F.when(share >= 0.5, "same").when(share >= 0.2, "unclear").otherwise("different").alias("verdict"))


def weakest(matches: DataFrame, chain: str, rank: str, unnamed: str | None = None, opinions: str | None = None) -> DataFrame:
    """(chain, weakest, n_known, n_unknown, n_unnamed): a chain is as good as its worst narrator, and a narrator as the worst opinion."""
    own = F.least(F.col(rank), F.array_min(F.filter(opinions, lambda o: o.isNotNull()))) if opinions else F.col(rank)
    hidden = F.coalesce(F.col(unnamed), F.lit(False)) if unnamed else F.lit(False)
    return matches.groupBy(chain).agg(
        F.min(F.when(~hidden, own)).alias("weakest"),
        F.count(F.when(~hidden, own)).alias("n_known"),
        F.count_if(~hidden & own.isNull()).alias("n_unknown"),
        F.count_if(hidden).alias("n_unnamed"),
    )


def ruling(weakest_: Column, unknown: Column, unnamed: Column, heard: Column) -> Column:
    """What a chain's worst rank, gaps and manner of transmission allow: the ladder, then its exceptions in order."""
    ladder = F.when(weakest_.isNull(), "not ruled").when(weakest_ <= 1, "very weak").when(weakest_ <= 3, "weak").when(weakest_ <= 6, "supporting").when(weakest_ <= 8, "good").otherwise("sound")
    held = F.when((unknown > 0) & ladder.isin("sound", "good"), "suspended").otherwise(ladder)
    forced = F.when((unnamed > 0) & (held != "very weak"), "weak").otherwise(held)
    return F.when((forced == "sound") & ~heard, "sound if hearing is confirmed").otherwise(forced)


def strength(matches: DataFrame, variant: Sequence[str], route: str, rank: str) -> DataFrame:
    """(variant, strength): the best of the worst ranks of its routes."""
    worst = matches.groupBy(*variant, route).agg(F.min(rank).alias("worst"))
    return worst.groupBy(*variant).agg(F.max("worst").alias("strength"))
