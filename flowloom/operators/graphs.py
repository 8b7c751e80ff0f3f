"""Queries on graphs as tables: nodes (id, kind) and edges (src, dst). One join for each step, until no row is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.sources.staging import staged

ROWS = 1 << 20  # of a task where both sides of a join may be large


def layers(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(node, layer): least number of edges from a root, by breadth-first search."""
    seen = staged(roots.select("node").distinct().withColumn("layer", F.lit(0).cast("long")), "layers")
    front = seen
    k = 0
    while most is None or k < most:
        k += 1
        step = edges.join(front.select("node"), edges.src == F.col("node")).select(F.col("dst").alias("node")).distinct()
        front = staged(step.join(seen.select("node"), "node", "left_anti").withColumn("layer", F.lit(k).cast("long")), "layers-front")
        if front.isEmpty():
            break
        seen = staged(seen.unionByName(front), "layers")
    return seen


def reachable(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst): all pairs with a path of one edge or more; path lengths double with each join."""
    pairs = staged(edges.select("src", "dst").distinct(), "reach")
    length, n = 1, pairs.count()
    while most is None or length < most:
        further = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        pairs = staged(pairs.unionByName(further).distinct(), "reach")
        length, was, n = 2 * length, n, pairs.count()
        if n == was:
            break
    return pairs


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes with a path of one edge or more from a node of start, each once, by a frontier."""
    seen = front = staged(edges.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "reached")
    while not front.isEmpty():
        step = edges.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        front = staged(step.join(seen, "node", "left_anti"), "reached-front")
        seen = staged(seen.unionByName(front), "reached")
    return seen


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def cyclic_part(edges: DataFrame) -> DataFrame:
    """The edges that are left when edges from nodes that none leads to, or to nodes that none leaves, are taken out until there are none such:
    those on cycles and on paths between them."""
    left = staged(edges.select("src", "dst").distinct(), "cyclic")
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = staged(inner.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cyclic")
        was, n = n, left.count()
        if n == was:
            break
    return left


def on_cycle(edges: DataFrame) -> DataFrame:
    return reachable(cyclic_part(edges)).where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def unknown_endpoints(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """(id, end: source or target), each once. Both sides are dealt by id over a partition for each `rows` rows at least: packed by their bytes, as ids
    compress well, very many would meet in one task. Repeated nodes stay, as an anti join reads past them and a task of the first pass need not hold its ids."""
    ends = edges.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(end).alias("end")) for c, end in (("src", "source"), ("dst", "target"))])).alias("e")).select("e.*")
    known, n = nodes.select("id"), -(-(nodes.count() + 2 * edges.count()) // rows)
    return ends.join(known.repartition(n, "id") if n > 1 else known, "id", "left_anti").distinct()  # the join deals the other side alike


def trigger_errors(nodes: DataFrame) -> DataFrame:
    """A flow has exactly one trigger: a row for each flow that hasn't."""
    return nodes.groupBy("flow").agg(F.count_if(F.col("kind") == "trigger").alias("triggers")).where("triggers <> 1")


def condition_port_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges out of a condition by another port than true or false."""
    return edges.join(nodes.where("kind = 'condition'").select(F.col("id").alias("src")), "src", "left_semi").where(~F.col("port").isin("true", "false"))


def merges_on_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.where("kind = 'merge'").join(on_cycle(edges).withColumnRenamed("node", "id"), "id", "left_semi")


def edited_above(edges: DataFrame, edited: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed nodes that an edited node lies above of, or is; where there is none, a run may continue."""
    return failed.join(reached(edges, edited).unionByName(edited.select("node")).distinct(), "node", "left_semi")


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    if not new.join(nodes.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("a node with that id is there already")
    return nodes.unionByName(new)


def renamed_node(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """The node and the ends of its edges; texts that name it stay."""
    named = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    return nodes.withColumn("id", named("id")), edges.withColumn("src", named("src")).withColumn("dst", named("dst"))


def removed_node(nodes: DataFrame, edges: DataFrame, gone: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("id") != gone), edges.where((F.col("src") != gone) & (F.col("dst") != gone))


def connected_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Adds edges; an edge that is there already stays single."""
    return edges.unionByName(new).distinct()


def disconnected_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, edges.columns, "left_anti")


def patched_configs(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """patches (id, patch): merge patches of the nodes' config (JSON text); null takes a key out."""
    from flowloom.operators.state import merge_patched

    joined = nodes.join(patches, "id", "left")
    return joined.withColumn("config", F.when(F.col("patch").isNotNull(), merge_patched("config", "patch")).otherwise(F.col("config"))).drop("patch")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst", "port").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def unbounded_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on a cycle that no loop node lies on: they reach themselves, and no loop node both ways."""
    pairs = reachable(cyclic_part(edges))
    loops = nodes.where("kind = 'loop'").select(F.col("id").alias("dst"))
    there = pairs.join(loops, "dst", "left_semi")
    both = there.join(turned(pairs), ["src", "dst"], "left_semi").select(F.col("src").alias("node"))
    return pairs.where("src = dst").select(F.col("src").alias("node")).join(both, "node", "left_anti")


def ungathered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Scatter nodes from which no gather node is reached."""
    closed = reached(turned(edges), nodes.where("kind = 'gather'").select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    return nodes.where("kind = 'scatter'").join(closed, "id", "left_anti")


def nested_scatters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of scatter nodes of which the first reaches the second before any gather: edges out of gathers don't count. A frontier for each scatter node."""
    gathers, scatters = nodes.where("kind = 'gather'").select(F.col("id").alias("src")), nodes.where("kind = 'scatter'")
    inside = staged(edges.select("src", "dst").distinct().join(gathers, "src", "left_anti"), "inside")
    front = seen = staged(inside.join(scatters.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("origin"), F.col("dst").alias("node")), "nested")
    while not front.isEmpty():
        step = front.join(inside, front.node == inside.src).select("origin", F.col("dst").alias("node")).distinct()
        front = staged(step.join(seen, ["origin", "node"], "left_anti"), "nested-front")
        seen = staged(seen.unionByName(front), "nested")
    return seen.join(scatters.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("origin").alias("src"), F.col("node").alias("dst"))


def upstream(edges: DataFrame, nodes: DataFrame, start: DataFrame, kind: str) -> DataFrame:
    """For each start node the nearest node of a kind above it (the smallest id of equally near ones). A start node goes up until it finds one or
    meets no new node."""
    wanted = nodes.where(F.col("kind") == kind).select(F.col("id").alias("node"))
    up = staged(edges.select("src", "dst").distinct(), "up")
    front = seen = staged(start.select(F.col("node").alias("origin"), "node").distinct(), "upstream")
    found: list[DataFrame] = []
    while not front.isEmpty():
        step = front.join(up, front.node == up.dst).select("origin", F.col("src").alias("node")).distinct()
        front = staged(step.join(seen, ["origin", "node"], "left_anti"), "upstream-front")
        here = front.join(wanted, "node", "left_semi").groupBy("origin").agg(F.min("node").alias("above"))
        found.append(staged(here.withColumn("depth", F.lit(len(found) + 1).cast("long")), "upstream-found"))
        seen = staged(seen.unionByName(front), "upstream")
        front = front.join(found[-1].select("origin"), "origin", "left_anti")
    every = reduce(DataFrame.unionByName, found) if found else start.select(F.col("node").alias("origin"), F.col("node").alias("above"), F.lit(0).cast("long").alias("depth")).limit(0)
    return every.select(F.col("origin").alias("node"), "above", "depth")
