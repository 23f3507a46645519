"""Operator 9: exact top-k inner products, by descending length with residual bounds.

Components become integers, so scores are exact. Candidates are dealt into blocks by descending length;
a query first meets the longest block, which gives it a threshold, then the longest bands, which raise
it, then the rest. By Cauchy-Schwarz no vector of a block can score above |query| * (longest of the
block), so each query needs only blocks from some length on; queries are grouped by that length, and a
candidate is sent only to the groups that still need it. Inside a block vectors are taken in descending
length, in runs: in coordinates rotated by an SVD the first few carry most of the product, the rest is
at most the product of the two residual lengths, and only pairs whose bound reaches the threshold get
their exact integer score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph.llm.session import written
from holdgraph.llm.vectors import hashed_sample, one_per_id, stacked

#: Candidates of a block, queries of a group and how many of them are compared at once, most bands of length,
#: the part of them that comes before the rest, rows that the rotation is fitted on, and the run length.
BLOCK, QUERIES, TOGETHER, BANDS, FIRST_SHARE, FITTED, RUN = 8192, 16384, 2048, 256, 16, 4096, 1024
_SCHEMA = "query_id long, vec_id long, score long"


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of a bounded sample, largest first. Any rotation is right; this one prunes."""
    return np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) else np.zeros((0, 0))


def block_top_k(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's best k in a block; `least` is what the k-th must reach."""
    d = queries.shape[1]
    if turn.shape[0] != d:
        turn = np.eye(d)
    head = max(1, d // 4)
    q, c = queries @ turn, vectors @ turn
    order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
    vectors, ids, c = vectors[order], ids[order], c[order]
    q_length, c_length = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1)
    q_rest, c_rest = np.linalg.norm(q[:, head:], axis=1), np.linalg.norm(c[:, head:], axis=1)
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * d < 2**52
    threshold = least.astype(np.float64).copy()
    best_q, best_id, best_score = (np.zeros(0, dtype=np.int64) for _ in range(3))
    for a in range(0, len(vectors), RUN):
        b = min(a + RUN, len(vectors))
        slack = 1e-9 * (1 + q_length * c_length[a])
        alive = np.flatnonzero(q_length * c_length[a] + slack >= threshold)
        if not len(alive):
            break  # the rest is shorter still
        bound = q[alive, :head] @ c[a:b, :head].T + q_rest[alive, None] * c_rest[None, a:b]
        row, column = np.nonzero(bound + slack[alive, None] >= threshold[alive, None])
        if not len(row):
            continue
        if exact and 8 * len(row) > bound.size:
            score = (queries[alive] @ vectors[a:b].T)[row, column].astype(np.int64)
        elif exact:
            score = np.einsum("ij,ij->i", queries[alive[row]], vectors[a + column]).astype(np.int64)
        else:
            score = np.einsum("ij,ij->i", queries[alive[row]].astype(np.int64), vectors[a + column].astype(np.int64))
        row, column = alive[row], ids[a + column]
        keep = (column != query_ids[row]) & (score >= threshold[row])
        best_q, best_id, best_score = (np.concatenate(x) for x in ((best_q, row[keep]), (best_id, column[keep]), (best_score, score[keep])))
        order = np.lexsort((best_id, -best_score, best_q))
        best_q, best_id, best_score = best_q[order], best_id[order], best_score[order]
        first = np.searchsorted(best_q, best_q)
        place = np.arange(len(best_q)) - first
        full = place == k - 1
        threshold[best_q[full]] = np.maximum(threshold[best_q[full]], best_score[full])
        top = place < k
        best_q, best_id, best_score = best_q[top], best_id[top], best_score[top]
    return best_q, best_id, best_score


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of each query with all
    other vectors (all, if fewer), ties to the smaller id. is_query is a condition on vec_id.

    Components are floor(scale * x); they and their products must fit 64 bits. Vectors that are null or
    hold null or non-finite components take no part, nor do null ids; of rows that share an id the smallest
    vector counts. Vectors of different lengths don't meet. An empty table gives an empty one."""
    spark = vectors.sparkSession
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = one_per_id(vectors, id_col, vector_col).select("vec_id", whole.alias("v"))
    rows = rows.select("vec_id", "v", F.size("v").alias("dims"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("length"))
    rows = written(rows, "vectors")

    # Bands of length, of a block at least: a bounded number of borders and counts.
    total = rows.count()
    bands = max(1, min(BANDS, math.ceil(total / BLOCK)))
    borders = sorted({x for x in (bands > 1 and rows.agg(F.percentile_approx("length", [i / bands for i in range(1, bands)], 2000)).first()[0] or [])}, reverse=True)
    band = F.lit(0)
    if borders:
        band = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b > F.col("length")))
    banded = rows.withColumn("band", band)
    sizes = {(r["dims"], r["band"]): r["count"] for r in banded.groupBy("dims", "band").count().collect()}
    many = F.create_map(*(F.lit(x) for key, n in sizes.items() for x in (f"{key[0]}/{key[1]}", math.ceil(n / BLOCK)))) if sizes else F.create_map(F.lit(""), F.lit(1))
    name = F.concat_ws("/", "dims", "band")
    blocked = banded.withColumn("part", F.pmod(F.xxhash64("vec_id"), many[name]))
    longest = F.max("length").over(Window.partitionBy("dims", "band", "part"))
    blocked = written(blocked.withColumn("longest", longest), "blocked")
    query = blocked.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), "dims", "length")
    groups = max(1, math.ceil(query.count() / QUERIES))
    sample = hashed_sample(rows, FITTED, total)
    turn = spark.sparkContext.broadcast(rotation(sample) if sample.size else np.zeros((0, 0)))

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")]
        if len(left) and len(right):
            vectors, vec_ids = stacked(right["v"]), right["vec_id"].to_numpy()
            for a in range(0, len(left), TOGETHER):
                some = left.iloc[a : a + TOGETHER]
                ids = some["query_id"].to_numpy()
                q, vec_id, score = block_top_k(stacked(some["query"]), ids, some["least"].to_numpy(), vectors, vec_ids, turn.value, k)
                out.append(pd.DataFrame({"query_id": ids[q], "vec_id": vec_id, "score": score}))
        return pd.concat(out)

    def met(found: DataFrame | None, candidates: DataFrame) -> DataFrame:
        """The best k of every query among candidates that can still reach what it has found. A query needs
        candidates of a certain length on; groups are ranges of that length, so the long candidates go to
        all groups and the short ones to few."""
        if found is None:
            asked = query.withColumn("least", F.lit(float("-inf")))
        else:
            least = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.get("s", F.lit(k - 1)).cast("double").alias("least"))
            asked = query.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        need = F.when(F.col("least") > 0, F.col("least") / F.col("length") * (1 - 1e-9) - 1e-6).otherwise(F.lit(-1.0))
        asked = asked.withColumn("need", need)
        cuts = [-math.inf]
        if groups > 1:
            cuts += [c for c in asked.agg(F.percentile_approx("need", [i / groups for i in range(1, groups)], 10_000)).first()[0] or [] if c > -1]
        cuts = sorted(set(cuts))
        at = F.array(*map(F.lit, cuts))
        group = F.size(F.filter(at, lambda c: c <= F.col("need")))
        asked = asked.withColumn("group", group)
        # Needs may be equal (at first there are none), so a group is dealt by id as well.
        sizes = {1: 1} if groups == 1 else {r["group"]: math.ceil(r["count"] / QUERIES) for r in asked.groupBy("group").count().collect()}
        deals = F.element_at(F.array(*(F.lit(sizes.get(g, 1)) for g in range(1, len(cuts) + 1))), F.col("group"))
        asked = asked.withColumn("deal", F.pmod(F.xxhash64("query_id"), deals).cast("int"))
        # The least need of a group is at least its lower border.
        reached = F.explode(F.sequence(F.lit(1), F.size(F.filter(at, lambda c: c <= F.col("longest")))))
        dealt = lambda df: df.withColumn("group", reached).withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
        each = dealt(candidates)
        keys = ["dims", "band", "part", "group", "deal"]
        open_ = dealt(candidates.select("dims", "band", "part", "longest").distinct())
        asked = asked.join(open_, ["dims", "group", "deal"]).where(F.col("need") <= F.col("longest")).select("query_id", "query", "least", *(F.col(c).alias(f"q_{c}") for c in keys))
        return asked.groupBy(*(f"q_{c}" for c in keys)).cogroup(each.select("vec_id", "v", *keys).groupBy(*keys)).applyInPandas(best, _SCHEMA)

    first = blocked.groupBy("dims").agg(F.min(F.struct("band", "part")).alias("first")).select("dims", "first.band", "first.part")
    found = written(met(None, blocked.join(first, ["dims", "band", "part"])), "begun")
    others = blocked.join(first, ["dims", "band", "part"], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    early = F.col("band") <= len(borders) // FIRST_SHARE
    for part in (others.where(early), others.where(~early)):
        found = found.unionByName(met(found, part)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = written(found.select("query_id", "rank", "vec_id", "score"), "best").drop("rank")
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
