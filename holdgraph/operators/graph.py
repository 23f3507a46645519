"""Graph operators over an edge table (bundle_id, owner_id, subject_id): all bundles at once.

Walks of a bounded number of hops are chains of equi-joins; unbounded ones are frontier loops that write
each layer to the shared folder, so that neither lineage nor driver memory grows with the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdgraph import components as stars
from holdgraph.lineage import written


def walks(edges: DataFrame, hops: int) -> DataFrame:
    """start, node, depth: every walk of 1 to `hops` edges upwards from each subject, walks and not distinct
    nodes."""
    step = edges.select(F.col("subject_id").alias("start"), F.col("owner_id").alias("node"), F.lit(1).alias("depth"))
    out = step
    for d in range(2, hops + 1):
        up = edges.select(F.col("subject_id").alias("node"), F.col("owner_id").alias("next"))
        step = step.join(up, "node").select("start", F.col("next").alias("node"), F.lit(d).alias("depth"))
        out = out.unionByName(step)
    return out


def closure(edges: DataFrame, roots: DataFrame, most: int = 25) -> DataFrame:
    """root, node, depth: all that each root owns directly or through others, cycle-safe; the root itself is
    not counted. roots: root."""
    down = edges.select(F.col("owner_id").alias("node"), F.col("subject_id").alias("next")).distinct()
    front = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    seen = front
    for d in range(1, most + 1):
        reached = front.join(down, "node").select("root", F.col("next").alias("node")).distinct()
        front = written(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def assets_by_sector(reach: DataFrame, assets: DataFrame) -> DataFrame:
    """root, sector, n: assets of all that a root reaches, each once, under the sector by which the first of its owners
    holds it: the one at the least depth, then the smallest node, then sector. reach: root, node, depth (the
    root itself at 0, if it counts); assets: node, asset, sector (null: unknown)."""
    held = reach.join(assets.select("node", "asset", F.coalesce("sector", F.lit("unknown")).alias("sector")), "node")
    first = held.groupBy("root", "asset").agg(F.min(F.struct("depth", "node", "sector")).alias("first"))
    return first.groupBy("root", F.col("first.sector").alias("sector")).agg(F.count(F.lit(1)).alias("n"))


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int = 3) -> DataFrame:
    """root, node, hop: breadth-first in both directions. The disjunction 'subject or owner in the frontier'
    is two equi-joins."""
    both = edges.select(F.col("owner_id").alias("node"), F.col("subject_id").alias("next")).unionByName(edges.select(F.col("subject_id").alias("node"), F.col("owner_id").alias("next"))).distinct()
    front = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("hop")).distinct()
    seen = front
    for h in range(1, hops + 1):
        reached = front.join(both, "node").select("root", F.col("next").alias("node")).distinct()
        front = written(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(front)
    return seen


def expansion(edges: DataFrame, roots: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Layers of owners above each root, every node once: root, node, depth; and root, truncated. A layer takes at most `most`
    nodes of a root (the first by id) and goes on from these; what is left out is said, not lost in silence.
    edges: owner_id, subject_id, ended (edges that have ended lead nowhere). roots: root."""
    up = edges.where("NOT ended").select(F.col("subject_id").alias("node"), F.col("owner_id").alias("next")).where("next IS NOT NULL").distinct()
    front = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    seen, cut = front, None
    rank = F.row_number().over(Window.partitionBy("root").orderBy("node"))
    for d in range(1, depth + 1):
        reached = front.join(up, "node").select("root", F.col("next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        layer = written(reached.withColumn("depth", F.lit(d)).withColumn("place", rank), "layer")
        front = layer.where(F.col("place") <= most).drop("place")
        over = layer.where(F.col("place") > most).select("root")
        cut = over if cut is None else cut.unionByName(over)
        seen = seen.unionByName(front)
    truncated = roots.select("root").distinct().join(cut.distinct().withColumn("truncated", F.lit(True)), "root", "left").select("root", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return seen.where("depth > 0"), truncated


DEEPEST_SQL = """
WITH RECURSIVE step AS (SELECT DISTINCT bundle_id, owner_id, subject_id FROM {edges} WHERE owner_id <> subject_id),
top AS (SELECT DISTINCT s.bundle_id, s.owner_id FROM step s LEFT ANTI JOIN step u ON u.bundle_id = s.bundle_id AND u.subject_id = s.owner_id),
down(bundle_id, node, depth, chain) AS (
  SELECT s.bundle_id, s.subject_id, 1, array(s.owner_id, s.subject_id) FROM step s JOIN top t ON t.bundle_id = s.bundle_id AND t.owner_id = s.owner_id
  UNION ALL
  SELECT s.bundle_id, s.subject_id, d.depth + 1, concat(d.chain, array(s.subject_id)) FROM down d JOIN step s ON s.bundle_id = d.bundle_id AND s.owner_id = d.node
  WHERE d.depth < {hops} AND NOT array_contains(d.chain, s.subject_id)
), first AS (SELECT row_number() OVER (ORDER BY depth DESC, bundle_id, chain) AS place, * FROM (SELECT * FROM down ORDER BY depth DESC, bundle_id, chain LIMIT {most})),
link AS (SELECT place, depth, bundle_id, posexplode(chain) AS (at, node) FROM first)
SELECT CAST(place AS INT) AS place, depth, bundle_id, array_sort(collect_list(struct(at, node, coalesce(name, CAST(node AS STRING)) AS name))) AS chain
FROM link LEFT JOIN {names} n USING (bundle_id, node) GROUP BY place, depth, bundle_id"""


def deepest(edges: DataFrame, names: DataFrame, hops: int = 8, most: int = 5) -> DataFrame:
    """place, depth, bundle_id, chain (at, node, name): the `most` deepest chains over all bundles, downwards
    from nodes that nobody owns, to `hops` links and never twice through a node; ties to the smaller bundle,
    then chain. names: bundle_id, node, name; a node without one is called by its id. The query is recursive
    SQL; only its first rows are ordered as a whole and get names."""
    spark = edges.sparkSession
    sql = DEEPEST_SQL.format(edges="{edges}", names="{names}", hops=hops, most=most)
    # Spark stops a recursion at a million rows unless told otherwise; the walk here is bounded by its hops.
    limit, before = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(sql, edges=edges, names=names), "deepest")
    finally:
        spark.conf.set(limit, before)


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the smallest node that undirected links (a, b) reach; nodes whose only link is to
    themselves, and those of `nodes` (node) without a link, are components of their own."""
    links = links.select("a", "b")
    if nodes is not None:
        links = links.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    links = written(links)
    found = written(stars.components(links, written))
    alone = links.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("node")))


def remapped(statements: DataFrame, remap: DataFrame, columns: list[str]) -> DataFrame:
    """Every reference column with ids replaced as remap (old, new) says."""
    for c in columns:
        m = remap.select(F.col("old").alias(c), F.col("new").alias("_new"))
        statements = statements.join(m, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return statements


def frontier(edges: DataFrame, nodes: DataFrame, side: str = "subject_id") -> DataFrame:
    """Nodes that never stand on a side of an ownership edge."""
    return nodes.join(edges.select(F.col(side).alias("node")).distinct(), "node", "left_anti")
