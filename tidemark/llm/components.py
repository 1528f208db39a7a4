"""Connected components of links, and links from shared lists without all pairs.

``connect`` takes lists (nodes that share a key, so may be linked), the nodes' details
and a condition that tells from two details whether they are linked.  It never writes
out the pairs of a list.  First every node is held against one leader per list, the node
with the greatest weight, which joins most of a group in as many pairs as it has nodes.
Only lists whose nodes then still lie in different components are looked at again: each
node outside the list's largest component against the nodes of other components, with
the condition inside the join, so that only links come out of it.  A pair inside one
component can't change the components, so no link is lost that matters to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import Workspace


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """``node component`` (the least node reachable) for every node of ``links`` (a, b).

    Alternates large-star and small-star steps (logarithmically many in practice) until
    every component is a star around its least node; each step is a staged table.
    """
    edges = space.stage(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                            F.col("m").alias("v")).where("u != v").distinct()
        edges = space.stage(small, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at most, which itself has none."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connect(lists: DataFrame, details: DataFrame, linked: Callable[[Column, Column], Column], space: Workspace,
            survivors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``node component`` of every node with a link.

    ``lists``: key, node, weight.  ``details``: node and what ``linked`` reads.
    ``survivors`` may return the nodes (of some details) that can have a link among them.
    """
    lists = space.stage(lists, "lists")
    details = details.select("node", F.struct(*[c for c in details.columns if c != "node"]).alias("d"))
    leaders = lists.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = (lists.join(leaders, "key").where(F.col("node") != F.col("lead.node"))
             .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct())
    side = lambda s: details.select(F.col("node").alias(s), F.col("d").alias(f"d_{s}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(linked(F.col("d_a"), F.col("d_b"))).select("a", "b")
    near = space.stage(components(links, space), "near")

    placed = lists.join(near, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = space.stage(_mixed(placed), "mixed")
    own = details.join(mixed.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys")), "node")
    if survivors is not None:
        own = space.stage(own, "own")
        own = own.join(survivors(own.select("node", "d.*")), "node", "left_semi")
        mixed = space.stage(_mixed(mixed.join(own.select("node"), "node", "left_semi").select("key", "node", "component")), "mixed")
    full = mixed.join(own, "node")
    odd = full.where(F.col("component") != F.col("home")).select("key", *[
        F.col(c).alias(f"x_{c}") for c in ("node", "component", "d", "keys")])
    first = F.element_at(F.array_intersect("x_keys", "keys"), 1) == F.col("key")  # a pair is tried in one list only
    links = odd.join(full, "key").where(
        (F.col("component") != F.col("x_component")) & ((F.col("component") == F.col("home")) | (F.col("x_node") < F.col("node")))
        & first & linked(F.col("x_d"), F.col("d"))).select(F.col("x_component").alias("a"), F.col("component").alias("b"))
    over = space.stage(components(links, space).select(F.col("node").alias("component"), F.col("component").alias("top")), "over")
    merged = near.join(over, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    lone = over.select(F.col("component").alias("node"), F.col("top").alias("component")).join(near, "node", "left_anti")
    return merged.unionAll(lone)


def _mixed(placed: DataFrame) -> DataFrame:
    """The lists (key, node, component) with several components, with the largest one as ``home``."""
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    homes = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("home"),
                                     F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "home")
    return placed.join(homes, "key")
