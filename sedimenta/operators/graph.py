"""Iterative graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import cumulated, ranked
from .staging import removed
from .staging import staged as _staged


def components(edges: DataFrame) -> DataFrame:
    """node, root of undirected edges (a, b): root is the least node reached.

    Each round hangs nodes on the least root among their neighbours' and then
    follows the root's own root, so paths halve; it ends when no root moves.
    """
    both = _staged(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    labels = _staged(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        hop = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = _staged(moved.join(hop, "mid").select("node", "old", F.least("mid", "far").alias("root")))
        removed(labels)
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels


def reachable(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """src, dst, depth: what is reachable over directed edges (src, dst), at its least depth; only from `starts` (src) if given.

    The result has a row for each reachable pair. A round joins only what the
    last one found, and writes only what is new.
    """
    edges = _staged(edges.select("src", "dst").distinct())
    first = edges if starts is None else edges.join(starts.select("src").distinct(), "src", "left_semi")
    rounds = [_staged(first.withColumn("depth", F.lit(1)))]
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    while not rounds[-1].isEmpty():
        found = rounds[0]
        for x in rounds[1:]:
            found = found.unionByName(x)
        reached = rounds[-1].select("src", "dst").join(step, "dst").select("src", F.col("to").alias("dst")).distinct()
        rounds.append(_staged(reached.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(len(rounds) + 1))))
    for x in rounds[1:]:
        rounds[0] = rounds[0].unionByName(x)
    return rounds[0]


def dependents(edges: DataFrame) -> DataFrame:
    """node, direct, all: importers of a node, itself not counted."""
    found = reachable(edges.where("src <> dst")).where("src <> dst")
    return found.groupBy(F.col("dst").alias("node")).agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("all"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, root: nodes on a common cycle, those alone left out; root is the least of them.

    Walks that can go one way only are followed by doubled steps, so loops and
    trees of any length are settled in as many rounds as their length has bits.
    What is left is coloured forward and backward: nodes without an edge in or
    out are trimmed; each node takes the least node that reaches it as its
    colour; what reaches back to a colour's own node over nodes of that colour
    is its component, and goes. The closure is never built: a round holds one
    row for each node.
    """
    left = _staged(edges.select("src", "dst").where("src <> dst").distinct())
    out = None
    while True:
        left = _staged(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        for a, b in (("src", "dst"), ("dst", "src")):
            if not left.isEmpty() and (settled := _forced(left.select(F.col(a).alias("src"), F.col(b).alias("dst")))) is not None:
                loops, nodes = settled
                out = loops if out is None else out.unionByName(loops)
                left = _staged(left.join(nodes.withColumnRenamed("node", "src"), "src", "left_anti").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        if left.isEmpty():
            break
        colour = _spread(left, left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node")))
        same = left.join(colour.withColumnsRenamed({"node": "src", "colour": "a"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "b"}), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour"))
        same = _staged(same)
        found = _staged(colour.where("node = colour"))
        last = found
        while not last.isEmpty():
            back = same.join(last.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            last = _staged(back.join(found, "node", "left_anti"))
            found = _staged(found.unionByName(last))
        several = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        told = _staged(found.join(several, "colour").select("node", F.col("colour").alias("root")))
        out = told if out is None else out.unionByName(told)
        left = same.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    return out if out is not None else left.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def _forced(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Loops (node, root) of nodes with one way out each, and all nodes (node) whose only walk runs into such a loop or a dead end; None if no node has one way out.

    Nothing outside can be on a loop with these nodes. A round doubles the steps
    of every walk; walks that come to a fork are dropped.
    """
    ways = _staged(edges.groupBy("src").agg(F.count("*").alias("ways"), F.min("dst").alias("far")))
    only = ways.where("ways = 1").select(F.col("src").alias("node"), "far", F.col("src").alias("least"), F.lit(False).alias("dead"))
    if not (steps := only.count()):
        return None
    ends = edges.select(F.col("dst").alias("src")).distinct().join(ways, "src", "left_anti").select(F.col("src").alias("node"), F.col("src").alias("far"), F.col("src").alias("least"), F.lit(True).alias("dead"))
    walks = _staged(only.unionByName(ends))
    for _ in range(steps.bit_length()):
        on = walks.select(F.col("node").alias("far"), F.col("far").alias("on"), F.col("least").alias("then"), F.col("dead").alias("stops"))
        new = _staged(walks.join(on, "far").select("node", F.col("on").alias("far"), F.least("least", "then").alias("least"), F.col("stops").alias("dead")))
        removed(walks)
        walks = new
    loops = walks.where("NOT dead").join(walks.select(F.col("far").alias("node")).distinct(), "node", "left_semi")
    return loops.select("node", F.col("least").alias("root")), walks.select("node")


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """node, colour: each node's least colour among its own and those of the nodes that reach it."""
    now = _staged(colours)
    while True:
        comes = edges.join(now.withColumnsRenamed({"node": "src"}), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("near"))
        new = _staged(now.join(comes, "node", "left").select("node", F.col("colour").alias("old"), F.least("colour", "near").alias("colour")))
        if new.where("old <> colour").isEmpty():
            return new.select("node", "colour")
        removed(now)
        now = new.select("node", "colour")


def shortest_loops(edges: DataFrame) -> DataFrame:
    """node, length: the shortest directed loop through each node that is on one.

    Only edges within strong components are followed. A component of as many
    edges as nodes is one loop, as long as it has nodes; walks are made in the
    others only.
    """
    edges = _staged(edges.select("src", "dst").distinct())
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(1).cast("long").alias("length"))
    strong = _staged(strong_components(edges))
    ends = strong.withColumnsRenamed({"node": "src", "root": "a"}), strong.withColumnsRenamed({"node": "dst", "root": "b"})
    within = _staged(edges.where("src <> dst").join(ends[0], "src").join(ends[1], "dst").where("a = b").select("src", "dst", F.col("a").alias("root")))
    sizes = strong.groupBy("root").agg(F.count("*").alias("length")).join(within.groupBy("root").agg(F.count("*").alias("edges")), "root")
    single = sizes.where("edges = length")
    told = strong.join(single, "root").select("node", "length").unionByName(alone)
    others = within.join(single, "root", "left_anti").select("src", "dst")
    return told.unionByName(_returns(others)).groupBy("node").agg(F.min("length").cast("int").alias("length"))


def _returns(edges: DataFrame, most: int = 8) -> DataFrame:
    """node, length: after how many edges each node is first met again; all edges lie within strong components.

    A node's walks end where it is met. Pairs met before are kept in `most`
    tables at most, so that plans don't grow with the rounds.
    """
    edges = _staged(edges)
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    last, seen, home, length = edges, [edges], [], 1
    while not last.isEmpty():
        length += 1
        reached = _staged(last.join(step, "dst").select("src", F.col("to").alias("dst")).distinct())
        met = reached.where("src = dst").select("src")
        home.append(met.select(F.col("src").alias("node"), F.lit(length).cast("long").alias("length")))
        going = reached.join(met, "src", "left_anti")
        for x in seen:
            going = going.join(x, ["src", "dst"], "left_anti")
        last = _staged(going)
        seen.append(last)
        if len(seen) > most:
            seen = [_staged(_union(seen).join(last.select("src").distinct(), "src", "left_semi"))]
        if len(home) > most:
            home = [_staged(_union(home))]
    return _union(home) if home else edges.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("length"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def truck_factor(authors: DataFrame, orphan_share: float = 0.5) -> DataFrame:
    """step, person, orphaned: authors (path, person) removed greedily until over `orphan_share` of the paths have none.

    A step takes who holds the most paths that still have an author. A path
    that has lost all its authors has none of those left, so what one of these
    holds never changes: the order is by paths held, and a path is orphaned at
    the step of its last author. Nothing is done person by person.
    """
    held = _staged(authors.select("path", "person").distinct())
    order = ranked(held.groupBy("person").agg(F.count("*").alias("n")), F.desc("n"), F.asc("person")).select("person", F.col("place").cast("int").alias("step"))
    fell = held.join(order, "person").groupBy("path").agg(F.max("step").alias("step")).groupBy("step").agg(F.count("*").alias("paths"))
    counted = order.join(fell, "step", "left").na.fill(0, ["paths"]).withColumn("place", F.col("step"))
    total = held.agg(F.countDistinct("path").alias("total"))
    steps = cumulated(counted, upto="paths").join(F.broadcast(total), how="cross").withColumn("orphaned", F.col("upto") / F.col("total"))
    return steps.where((F.col("upto") - F.col("paths")) / F.col("total") <= orphan_share).select("step", "person", "orphaned")


def lineage(renames: DataFrame) -> DataFrame:
    """name, origin, steps: each name's first name over renames (old, new)."""
    found = reachable(renames.select(F.col("new").alias("src"), F.col("old").alias("dst")))
    return found.groupBy(F.col("src").alias("name")).agg(F.max_by("dst", "depth").alias("origin"), F.max("depth").alias("steps"))


def unreferenced(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes (path) no edge leads to and that are no entry points."""
    return nodes.join(edges.where("src <> dst").select(F.col("dst").alias("path")), "path", "left_anti").join(entries.select("path"), "path", "left_anti")
