"""Cycles of a directed graph and walks over what is left when each is one node.

edges: bundle_id, owner_id, subject_id; all bundles at once. Strongly connected components come from
forward-backward colouring: the smallest node that reaches a node is its colour, and whatever leads back to a
colour's own node inside the colour is a component with it. Beforehand nodes that nobody owns any more, or
that own nothing any more, are peeled off, so the rounds run over cycles and what lies between them only.

The condensation (a component is one unit) has no cycles. There a unit waits until it has heard from all it
owns, so every edge outside components carries one message, whatever the number of paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph.lineage import written


def nodes_of(edges: DataFrame) -> DataFrame:
    """bundle_id, node: both ends of every edge."""
    return edges.select("bundle_id", F.col("owner_id").alias("node")).union(edges.select("bundle_id", F.col("subject_id").alias("node"))).distinct()


def core(edges: DataFrame) -> DataFrame:
    """The edges on cycles or between them. Self-loops and repeated edges don't count."""
    left = written(edges.select("bundle_id", "owner_id", "subject_id").where("owner_id <> subject_id").distinct(), "core")
    n = left.count()
    while n:
        owners, subjects = (left.select("bundle_id", F.col(c).alias(o)).distinct() for c, o in (("owner_id", "subject_id"), ("subject_id", "owner_id")))
        left = written(left.join(subjects, ["bundle_id", "owner_id"], "left_semi").join(owners, ["bundle_id", "subject_id"], "left_semi"), "core")
        before, n = n, left.count()
        if n == before:
            break
    return left


def _coloured(edges: DataFrame) -> DataFrame:
    """bundle_id, node, colour: the smallest node from which edges lead to the node, itself included."""
    colours = nodes_of(edges).select("bundle_id", "node", F.col("node").alias("colour"), F.lit(True).alias("fresh"))
    while True:
        sent = edges.join(colours.where("fresh").withColumnRenamed("node", "owner_id"), ["bundle_id", "owner_id"]).select("bundle_id", F.col("subject_id").alias("node"), "colour", F.lit(None).cast("string").alias("had"))
        known = colours.select("bundle_id", "node", "colour", F.col("colour").cast("string").alias("had"))
        least = known.unionByName(sent).groupBy("bundle_id", "node").agg(F.min("colour").alias("colour"), F.max("had").alias("had"))
        colours = written(least.select("bundle_id", "node", "colour", (F.col("colour").cast("string") != F.col("had")).alias("fresh")), "colours")
        if colours.where("fresh").isEmpty():
            return colours.drop("fresh")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """bundle_id, node, component: the nodes on cycles, component being the smallest node of each. A node that
    is on no cycle isn't listed; nulls are no nodes. An empty table gives an empty one."""
    left = core(edges.where("owner_id IS NOT NULL AND subject_id IS NOT NULL"))
    found: list[DataFrame] = []
    while not left.isEmpty():
        colour = _coloured(left)
        of = lambda c, name: colour.select("bundle_id", F.col("node").alias(c), F.col("colour").alias(name))
        inside = written(left.join(of("owner_id", "colour"), ["bundle_id", "owner_id"]).join(of("subject_id", "_other"), ["bundle_id", "subject_id"]).where("colour = _other").drop("_other"), "inside")
        # Backwards from each colour's own node.
        front = colour.where("node = colour")
        seen = front
        while True:
            back = inside.join(front.withColumnRenamed("node", "subject_id"), ["bundle_id", "colour", "subject_id"]).select("bundle_id", F.col("owner_id").alias("node"), "colour").distinct()
            front = written(back.join(seen, ["bundle_id", "node", "colour"], "left_anti"), "back")
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        seen = written(seen, "members")
        many = seen.groupBy("bundle_id", "colour").count().where("count > 1").drop("count")
        found.append(seen.join(many, ["bundle_id", "colour"], "left_semi").select("bundle_id", "node", F.col("colour").alias("component")))
        gone = lambda c, seen=seen: seen.select("bundle_id", F.col("node").alias(c))
        left = core(inside.join(gone("owner_id"), ["bundle_id", "owner_id"], "left_anti").join(gone("subject_id"), ["bundle_id", "subject_id"], "left_anti"))
    if not found:
        return nodes_of(left).select("bundle_id", "node", F.col("node").alias("component"))
    return written(reduce(DataFrame.unionByName, found), "cycles")


def condensed(edges: DataFrame, cycles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units (bundle_id, node, unit), and edges between units and inside units with owner_unit and subject_unit."""
    units = written(nodes_of(edges).join(cycles, ["bundle_id", "node"], "left").select("bundle_id", "node", F.coalesce("component", "node").alias("unit")), "units")
    of = lambda c, name: units.select("bundle_id", F.col("node").alias(c), F.col("unit").alias(name))
    both = written(edges.join(of("owner_id", "owner_unit"), ["bundle_id", "owner_id"]).join(of("subject_id", "subject_unit"), ["bundle_id", "subject_id"]), "condensed")
    return units, both.where("owner_unit <> subject_unit"), both.where("owner_unit = subject_unit")


def _longest(path: Column) -> Column:
    """Of several paths the longest, of equals the smallest."""
    return F.min(F.struct((-F.size(path)).alias("_n"), path.alias("path")))["path"]


def inner_paths(inner: DataFrame) -> DataFrame:
    """bundle_id, start, node, path: the longest simple path from node to node inside a component. Every simple
    path of the component is followed, which is what finding the longest one takes."""
    nodes = nodes_of(inner)
    front = nodes.select("bundle_id", F.col("node").alias("start"), "node", F.array("node").alias("path"))
    step = inner.select("bundle_id", F.col("owner_id").alias("node"), F.col("subject_id").alias("next"))
    layers = []
    while True:
        front = written(front, "inner")
        if front.isEmpty():
            break
        layers.append(front)
        front = front.join(step, ["bundle_id", "node"]).where(~F.array_contains("path", F.col("next"))).select("bundle_id", "start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
    every = reduce(DataFrame.unionByName, layers or [front])
    return written(every.groupBy("bundle_id", "start", "node").agg(_longest(F.col("path")).alias("path")), "inner")


def _answered(state: DataFrame, send: DataFrame, ways: DataFrame | None, found: list[DataFrame]) -> DataFrame:
    """Rounds of messages: units that have heard from all they own give the best chains of their nodes to `found` and
    tell those who own them. What is left waits for units that never answer. state: bundle_id, unit, node, got
    (messages), tail (the best chain that follows the node), need, done; send: bundle_id, node, unit, to, need."""
    of_unit = Window.partitionBy("bundle_id", "unit")
    while not state.where("done").isEmpty():
        heard = state.where("done")
        path = F.concat(F.array("node"), "tail")
        if ways is not None:
            heard = heard.join(ways.withColumnRenamed("path", "way"), ["bundle_id", "node"], "left").withColumn("node", F.coalesce("start", "node"))
            path = F.concat(F.coalesce("way", F.array("node")), "tail")
        front = heard.groupBy("bundle_id", "node").agg(_longest(path).alias("path"))
        found.append(front)
        sent = send.join(front, ["bundle_id", "node"]).select("bundle_id", "unit", F.col("to").alias("node"), F.lit(1).cast("long").alias("got"), F.col("path").alias("tail"), "need")
        waiting = state.where("NOT done").drop("done").unionByName(sent).groupBy("bundle_id", "unit", "node").agg(F.sum("got").alias("got"), _longest(F.col("tail")).alias("tail"), F.max("need").alias("need"))
        state = written(waiting.withColumn("done", F.sum("got").over(of_unit) == F.col("need")), "state")
    return state


def longest_chains(edges: DataFrame) -> DataFrame:
    """bundle_id, layers, path: the longest simple owner-to-subject path of each bundle, in nodes; of equals
    the smallest path. Nodes that lead to no cycle answer first, each when all it owns have; cycles are looked
    for among the others, which then go on as units. Outside components each edge is used once; simple paths are
    followed inside components only. Rounds are as many as units lie under one another. Self-loops, repeated
    edges and nulls don't count."""
    edges = written(edges.select("bundle_id", "owner_id", "subject_id").where("owner_id <> subject_id").distinct(), "edges")
    kind = edges.schema["owner_id"].dataType.simpleString()
    nothing, none_yet = F.array().cast(f"array<{kind}>"), F.lit(0).cast("long")
    found: list[DataFrame] = []

    owns = edges.groupBy("bundle_id", F.col("owner_id").alias("unit")).agg(F.count("*").alias("need"))
    send = written(edges.select("bundle_id", F.col("subject_id").alias("node"), F.col("owner_id").alias("unit"), F.col("owner_id").alias("to")).join(owns, ["bundle_id", "unit"]), "send")
    ends = nodes_of(edges).join(owns.select("bundle_id", F.col("unit").alias("node")), ["bundle_id", "node"], "left_anti")
    state = written(ends.select("bundle_id", F.col("node").alias("unit"), "node", none_yet.alias("got"), nothing.alias("tail"), none_yet.alias("need"), F.lit(True).alias("done")), "state")
    heard = _answered(state, send, None, found)

    answered = reduce(DataFrame.unionByName, (f.select("bundle_id", F.col("node").alias("subject_id")) for f in found)) if found else None
    left = edges if answered is None else edges.join(answered, ["bundle_id", "subject_id"], "left_anti")
    left = written(left.select("bundle_id", "owner_id", "subject_id"), "left")
    if not left.isEmpty():
        units, outer, inner = condensed(left, strongly_connected(left))
        ways = inner_paths(inner)
        need = outer.groupBy("bundle_id", F.col("owner_unit").alias("unit")).agg(F.count("*").alias("need"))
        send = outer.select("bundle_id", F.col("subject_id").alias("node"), F.col("owner_unit").alias("unit"), F.col("owner_id").alias("to"))
        send = written(send.join(need, ["bundle_id", "unit"]), "send")
        state = units.join(need, ["bundle_id", "unit"], "left").join(heard.select("bundle_id", "node", "tail"), ["bundle_id", "node"], "left")
        state = state.select("bundle_id", "unit", "node", none_yet.alias("got"), F.coalesce("tail", nothing).alias("tail"), "need", F.col("need").isNull().alias("done"))
        _answered(written(state, "state"), send, ways, found)
    if not found:
        return edges.select("bundle_id", F.lit(0).alias("layers"), F.array("owner_id").alias("path"))
    best = reduce(DataFrame.unionByName, found).groupBy("bundle_id").agg(_longest(F.col("path")).alias("path"))
    return best.select("bundle_id", F.size("path").alias("layers"), "path")


def layers(edges: DataFrame) -> DataFrame:
    """bundle_id, node, layer: nodes that own nothing are 0, others one more than the highest layer they own.
    Nodes on a common cycle stand in one layer, that of what they own outside it. Nulls don't count."""
    edges = written(edges.select("bundle_id", "owner_id", "subject_id").where("owner_id <> subject_id").distinct(), "edges")
    units, outer, _ = condensed(edges, strongly_connected(edges))
    send = outer.select("bundle_id", F.col("subject_unit").alias("unit"), F.col("owner_unit").alias("to"))
    need = written(send.groupBy("bundle_id", "to").agg(F.count("*").alias("need")), "need")
    send = written(send.join(need, ["bundle_id", "to"]), "send")
    state = units.select("bundle_id", "unit").distinct().join(need.withColumnRenamed("to", "unit"), ["bundle_id", "unit"], "left_anti")
    state = written(state.select("bundle_id", "unit", F.lit(0).cast("long").alias("got"), F.lit(0).alias("layer"), F.lit(0).cast("long").alias("need"), F.lit(True).alias("done")), "state")
    placed = []
    while not state.where("done").isEmpty():
        front = state.where("done").select("bundle_id", "unit", "layer")
        placed.append(front)
        sent = send.join(front, ["bundle_id", "unit"]).select("bundle_id", F.col("to").alias("unit"), F.lit(1).cast("long").alias("got"), (F.col("layer") + 1).alias("layer"), "need")
        waiting = state.where("NOT done").drop("done").unionByName(sent).groupBy("bundle_id", "unit").agg(F.sum("got").alias("got"), F.max("layer").alias("layer"), F.max("need").alias("need"))
        state = written(waiting.withColumn("done", F.col("got") == F.col("need")), "state")
    if not placed:
        return units.select("bundle_id", "node", F.lit(0).alias("layer"))
    return units.join(reduce(DataFrame.unionByName, placed), ["bundle_id", "unit"]).select("bundle_id", "node", "layer")
