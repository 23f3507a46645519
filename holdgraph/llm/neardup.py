"""Operator 7: embedding near-duplicates over a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to the shards of their nearest centroids (k-means on a
bounded sample, and once more inside each of these parts, so that shards stay small at any size), two
each, so that shards overlap. Each shard links its nodes to near and to random ones and prunes
robustly: a neighbour stays only if no neighbour chosen before it is nearer to it by a factor. The lists
of all shards are united. Every node is then searched from its home shard's medoid by greedy beam
search, and from what it reaches the search widens through all nodes within the threshold until nothing
new turns up. What is found is verified in double precision and counted where it is found, and a shard
gives one link for each node to the first of its part, so a dense group makes as many rows as it has
nodes. Recall is audited against brute force for a sample of nodes; the graph is built again with more
overlap where it falls short, and at last blocks of all nodes are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdgraph.llm.graph import components
from holdgraph.llm.session import written
from holdgraph.llm.vectors import one_per_id, stacked

THRESHOLD = 0.9
#: Nodes that a shard aims at; rows that centroids are fitted on; most centroids of a level.
SHARD, FITTED, MOST_SHARDS = 4000, 16384, 4096
#: Candidates before pruning, edges after it, the pruning factor, the beam and its steps.
CANDIDATES, DEGREE, ALPHA, BEAM, STEPS = 64, 24, 1.2, 16, 48
#: Random nodes of the shard that a node looks at, the nearest of them that it keeps, edges that are turned
#: round for a node, and queries searched at once.
RANDOM, SPREAD, TURNED, TOGETHER = 512, 8, 16, 256
#: Nodes audited, the recall asked for, the overlaps tried, and nodes of an exact block.
AUDITED, RECALL, OVERLAPS, BLOCK = 1000, 0.98, (2, 4), 4096


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that neither very large nor very small components overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites a[i] with b[i] in `parent`, in which every node points at the first node of its part."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows of the sample (which comes in hash order)."""
    middle = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[a : a + 2048] @ middle.T, axis=1) for a in range(0, len(sample), 2048)])
        sums = np.zeros_like(middle)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        middle = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), middle)
    return middle


def robust_prune(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) among the unit rows of x."""
    n = len(x)
    width = min(CANDIDATES, n - 1)
    if width <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    out_from, out_to, turned_from, turned_to, turned_near = [], [], [], [], []
    rng = np.random.default_rng(0)
    for a in range(0, n, 512):
        rows = np.arange(a, min(a + 512, n))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -np.inf
        # Long edges: the nearest of some random nodes keep a dense group in one piece.
        some = rng.choice(n, size=min(RANDOM, n), replace=False)
        spread = some[np.argpartition(-near[:, some], min(SPREAD, len(some)) - 1, axis=1)[:, :SPREAD]]
        out_from.append(np.repeat(rows, spread.shape[1]))
        out_to.append(spread.ravel())
        nearest = np.argpartition(-near, width - 1, axis=1)[:, :width]
        nearest = np.take_along_axis(nearest, np.argsort(-np.take_along_axis(near, nearest, axis=1), axis=1), axis=1)
        far = 1 - np.take_along_axis(near, nearest, axis=1)
        open_ = np.ones(nearest.shape, dtype=bool)
        vectors = x[nearest]
        for _ in range(min(DEGREE, width)):
            some = open_.any(axis=1)
            if not some.any():
                break
            pick = np.argmax(open_, axis=1)
            chosen = nearest[np.arange(len(rows)), pick]
            out_from.append(rows[some])
            out_to.append(chosen[some])
            turned_from.append(chosen[some])
            turned_to.append(rows[some])
            turned_near.append(near[np.arange(len(rows)), chosen][some])
            between = 1 - np.einsum("ijk,ik->ij", vectors, x[chosen])
            open_ &= ALPHA * between > far
            open_[np.arange(len(rows)), pick] = False
    source, target, near = np.concatenate(turned_from), np.concatenate(turned_to), np.concatenate(turned_near)
    order = np.lexsort((-near, source))
    source, target = source[order], target[order]
    few = np.arange(len(source)) - np.searchsorted(source, source) < TURNED
    return np.concatenate([*out_from, source[few]]), np.concatenate([*out_to, target[few]])


def range_search(x: np.ndarray, queries: np.ndarray, offsets: np.ndarray, targets: np.ndarray, start: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(query index, node) within the threshold. Nodes' edges are targets[offsets[i]:offsets[i + 1]]."""
    nq, n = len(queries), len(x)
    q = x[queries]
    beam = np.full((nq, BEAM), -1, dtype=np.int64)
    score = np.full((nq, BEAM), -np.inf)
    done = np.ones((nq, BEAM), dtype=bool)
    beam[:, 0], score[:, 0], done[:, 0] = start, q @ x[start], False
    degree = np.diff(offsets)
    for _ in range(STEPS):
        value = np.where(done, -np.inf, score)
        pick = np.argmax(value, axis=1)
        go = np.flatnonzero(value[np.arange(nq), pick] > -np.inf)
        if not len(go):
            break
        node = beam[go, pick[go]]
        done[go, pick[go]] = True
        count = degree[node]
        owner = np.repeat(go, count)
        to = targets[np.repeat(offsets[node] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        known = (beam[owner] == to[:, None]).any(axis=1)
        owner, to = owner[~known], to[~known]
        got = np.einsum("ij,ij->i", q[owner], x[to])
        # Merge: the best BEAM of what each query has and has just met.
        rows = np.concatenate([np.repeat(np.arange(nq), BEAM), owner])
        nodes, values = np.concatenate([beam.ravel(), to]), np.concatenate([score.ravel(), got])
        ended = np.concatenate([done.ravel(), np.zeros(len(to), dtype=bool)])
        order = np.lexsort((-values, rows))
        rows, nodes, values, ended = rows[order], nodes[order], values[order], ended[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < BEAM
        beam, score, done = nodes[keep].reshape(nq, BEAM), values[keep].reshape(nq, BEAM), ended[keep].reshape(nq, BEAM)
    hit = (score >= threshold) & (beam >= 0)
    seen = np.zeros((nq, n), dtype=bool)
    seen[np.nonzero(hit)[0], beam[hit]] = True
    # A query is a node too: its own edges are part of what it reaches.
    seen[np.arange(nq), queries] = True
    padded = np.repeat(np.arange(n)[:, None], max(1, degree.max(initial=0)), axis=1)
    padded[np.repeat(np.arange(n), degree), np.arange(len(targets)) - np.repeat(offsets[:-1], degree)] = targets
    front = np.nonzero(seen)
    while len(front[0]):
        reached = np.zeros((nq, n), dtype=bool)
        for slot in padded.T:
            reached[front[0], slot[front[1]]] = True
        owner, node = np.nonzero(reached & ~seen)
        near = np.zeros(len(owner), dtype=bool)
        for a in range(0, len(owner), 50_000):
            near[a : a + 50_000] = np.einsum("ij,ij->i", q[owner[a : a + 50_000]], x[node[a : a + 50_000]]) >= threshold
        front = owner[near], node[near]
        seen[front] = True
    return np.nonzero(seen)


def _nearest(x: np.ndarray, middle: np.ndarray, overlap: int) -> np.ndarray:
    return np.argsort(-(x @ middle.T), axis=1, kind="stable")[:, : min(overlap, len(middle))]


def _shards(nodes: DataFrame, overlap: int) -> DataFrame:
    """node, v, copies, part, shard, home: each node in its `overlap` nearest parts, and in as many nearest
    shards of each; home is the nearest shard of the nearest part."""
    n = nodes.count()
    k = max(1, min(math.ceil(n / SHARD), MOST_SHARDS, FITTED // 4))
    sample = unit(stacked(nodes.orderBy(F.xxhash64("node"), "node").limit(FITTED).select("v").toPandas()["v"]))
    middle = nodes.sparkSession.sparkContext.broadcast(centroids(sample, min(k, len(sample))))
    element = nodes.schema["v"].dataType.simpleString()

    def first(batches):
        c = middle.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(stacked(batch.column("v").to_pandas()))
            best = _nearest(x, c, overlap)
            row = pa.array(np.repeat(np.arange(len(x)), best.shape[1]))
            home = np.tile(np.arange(best.shape[1]) == 0, len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(row) for x in ("node", "v", "copies")), pa.array(best.ravel(), pa.int32()), pa.array(home, pa.bool_())], names=["node", "v", "copies", "part", "home"])

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        k = math.ceil(len(pdf) / (2 * SHARD))
        if k == 1:
            return pdf.assign(shard=0)[["node", "v", "copies", "part", "shard", "home"]]
        x = unit(stacked(pdf["v"]))
        best = _nearest(x, centroids(x[np.linspace(0, len(x) - 1, min(len(x), FITTED)).astype(int)], k), overlap)
        out = pdf.iloc[np.repeat(np.arange(len(x)), best.shape[1])].assign(shard=best.ravel())
        out["home"] &= np.tile(np.arange(best.shape[1]) == 0, len(x))
        return out[["node", "v", "copies", "part", "shard", "home"]]

    parts = nodes.select("node", "v", "copies").mapInArrow(first, f"node long, v {element}, copies long, part int, home boolean")
    return written(parts.groupBy("part").applyInPandas(second, f"node long, v {element}, copies long, part int, shard int, home boolean"), "shards")


_COUNTED = "node long, linked long, root long"


def _found(nodes: DataFrame, overlap: int, threshold: float) -> DataFrame:
    """node, linked (rows of the other nodes within the threshold, copies counted), root (a node of its
    component, or itself); a node may have more rows, with 0 in linked. nodes: node, v, copies."""
    dealt = _shards(nodes, overlap)
    shard = ["part", "shard"]
    # Two nodes within the threshold of one query are at most twice that angle apart, so no way of a range
    # search takes an edge that is longer.
    apart = 2 * threshold**2 - 1 - 1e-9 if threshold > 0 else -1.0

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(stacked(pdf["v"]))
        source, target = robust_prune(x)
        ids = pdf["node"].to_numpy()
        order = np.argsort(source, kind="stable")
        source, target = source[order], target[order]
        wide = np.zeros(len(source), dtype=bool)
        for a in range(0, len(source), 50_000):
            wide[a : a + 50_000] = np.einsum("ij,ij->i", x[source[a : a + 50_000]], x[target[a : a + 50_000]]) >= apart
        lists = []
        for some in (np.ones(len(source), dtype=bool), wide):
            to, cut = ids[target[some]], np.searchsorted(source[some], np.arange(len(ids) + 1))
            lists.append([to[cut[i] : cut[i + 1]] for i in range(len(ids))])
        return pd.DataFrame({"node": ids, "to": lists[0], "wide": lists[1]})

    lists = dealt.select(*shard, "node", "v").groupBy(*shard).applyInPandas(build, "node long, to array<long>, wide array<long>")
    united = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    edges = written(lists.groupBy("node").agg(united("to"), united("wide")), "edges")
    # A shard searches its own nodes, and those that their wide lists lead to outside of it.
    own = dealt.join(edges, "node").select(*shard, "node", "v", "copies", "to", "home", "wide")
    outside = own.select(*shard, F.explode("wide").alias("node")).distinct().join(dealt.select(*shard, "node"), [*shard, "node"], "left_anti")
    halo = outside.join(nodes, "node").join(edges, "node").select(*shard, "node", "v", "copies", "to", F.lit(False).alias("home"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["node"].to_numpy()
        order = np.argsort(ids)
        pdf, ids = pdf.iloc[order], ids[order]
        raw = scaled(stacked(pdf["v"]))
        length = np.linalg.norm(raw, axis=1)
        x, copies, home = raw / length[:, None], pdf["copies"].to_numpy(), pdf["home"].to_numpy()
        queries = np.flatnonzero(home)
        if not len(queries):
            return pd.DataFrame({"node": [], "linked": [], "root": []}).astype("int64")
        lists = [np.asarray(t, dtype=np.int64) for t in pdf["to"]]
        owner, to = np.repeat(np.arange(len(ids)), [len(t) for t in lists]), np.concatenate(lists)
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        here = ids[at] == to
        owner, at = owner[here], at[here]
        offsets = np.searchsorted(owner, np.arange(len(ids) + 1))
        medoid = queries[np.argmax(x[queries] @ x[queries].mean(axis=0))]
        parent, linked = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for a in range(0, len(queries), TOGETHER):
            q, node = range_search(x, queries[a : a + TOGETHER], offsets, at, medoid, threshold - 1e-9)
            q = queries[a + q]
            for b in range(0, len(q), 50_000):
                i, j = q[b : b + 50_000], node[b : b + 50_000]
                near = (i != j) & (np.einsum("ij,ij->i", raw[i], raw[j]) / (length[i] * length[j]) >= threshold)
                np.add.at(linked, i[near], copies[j[near]])
                joined(parent, i[near], j[near])
        rows = np.flatnonzero(home | (parent != np.arange(len(ids))))
        return pd.DataFrame({"node": ids[rows], "linked": np.where(home, linked, 0)[rows], "root": ids[parent[rows]]})

    return written(own.drop("wide").unionByName(halo).groupBy(*shard).applyInPandas(search, _COUNTED), "found")


def exact_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """As _found, by comparing all blocks of nodes with each other: exact, and quadratic in the nodes."""
    blocks = max(1, math.ceil(nodes.count() / BLOCK))
    each = nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    each = each.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "v", "copies")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        raw = scaled(stacked(pdf["v"]))
        length, ids, copies, block = np.linalg.norm(raw, axis=1), pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        parent, linked = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
        right = np.flatnonzero(block == key[1])
        left = np.flatnonzero(block == key[0])
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            i, j = np.nonzero((raw[rows] @ raw[right].T) / (length[rows, None] * length[None, right]) >= threshold)
            i, j = rows[i], right[j]
            i, j = i[i != j], j[i != j]
            np.add.at(linked, i, copies[j])
            if key[0] != key[1]:
                np.add.at(linked, j, copies[i])
            joined(parent, i, j)
        some = (linked > 0) | (parent != np.arange(len(ids)))
        return pd.DataFrame({"node": ids[some], "linked": linked[some], "root": ids[parent[some]]})

    return written(each.groupBy("i", "j").applyInPandas(compare, _COUNTED), "exact")


def audit(nodes: DataFrame, counted: DataFrame, threshold: float = THRESHOLD, sample: int = AUDITED) -> float:
    """Of sampled nodes that have links (by brute force over all nodes), the mean share that was found."""
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(sample).collect()
    if not chosen:
        return 1.0
    ids = np.array([r["node"] for r in chosen])
    q = nodes.sparkSession.sparkContext.broadcast(unit(np.array([r["v"] for r in chosen], dtype=np.float64)))

    def run(batches):
        true = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                near = unit(stacked(batch.column("v").to_pandas())) @ q.value.T >= threshold
                near &= batch.column("node").to_numpy()[:, None] != ids[None, :]
                true += batch.column("copies").to_numpy() @ near
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(true, pa.int64())], names=["node", "all"])

    true = nodes.select("node", "v", "copies").mapInArrow(run, "node long, all long").groupBy("node").agg(F.sum("all").alias("partners")).where("partners > 0")
    share = F.least(F.coalesce("linked", F.lit(0)) / F.col("partners"), F.lit(1.0))
    return true.join(counted.groupBy("node").agg(F.sum("linked").alias("linked")), "node", "left").agg(F.coalesce(F.avg(share), F.lit(1.0))).first()[0]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (the smallest id that links reach),
    kept: one row for each row.

    Vectors that are null, zero or hold null or non-finite components link with nothing; so do rows with a
    null id (their component is null and they are kept). Of rows that share an id the smallest vector
    counts, and each row gets its id's result. Vectors of different dimensions never link. Other columns
    are ignored; an empty table gives an empty one. Where the audited recall stays under RECALL with the
    largest overlap, all blocks of vectors are compared exactly instead."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    usable = one_per_id(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    members = written(usable, "members")
    classes = written(members.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    member = written(members.join(classes, "v").select("vec_id", "node", "copies"), "member")
    found = None
    for (dims,) in classes.select(F.size("v")).distinct().collect():
        nodes = classes.where(F.size("v") == dims)
        for overlap in OVERLAPS:
            counted = _found(nodes, overlap, threshold)
            if audit(nodes, counted, threshold) >= RECALL:
                break
        else:
            counted = exact_links(nodes, threshold)
        found = counted if found is None else found.unionByName(counted)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    part = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = written(classes.select("node").join(linked, "node", "left").join(part, "node", "left").select("node", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "node").alias("component")), "per_node")
    by_id = member.join(per_node, "node").select("vec_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    out = rows.join(by_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
