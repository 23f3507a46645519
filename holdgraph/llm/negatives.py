"""Operator 12: hard negatives by angular triangle filtering.

A few reference directions are chosen from a bounded sample, and every row stores its angle to each. The
angle between two rows lies between the difference and the sum of their angles to a direction, so its cosine
has an interval; the narrowest one over all directions, times both norms and widened by more than rounding
can do, bounds the integer score from both sides. A row gets its integer score with an anchor only if these
bounds overlap what the anchor still looks for: for positives anything from the best lower bounds on, for
negatives the windows under its positives' scores, raised to the scores already found.

Rows are dealt into blocks near one direction, which store the range of their angles. Anchors meet blocks in
three rounds, each with more blocks; what a round finds raises the limits of the next, so later rounds
return few rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph.llm.session import written
from holdgraph.llm.vectors import hashed_sample, labelled_per_id, stacked

#: Rows of a block, anchors of a group, how many of each are compared at once, directions, rows that they are
#: chosen from, and the part of the blocks that each round adds.
BLOCK, ANCHORS, TOGETHER, RUN, DIRECTIONS, FITTED, ROUNDS = 8192, 8192, 256, 2048, 12, 4096, (64, 8, 1)
#: How far rounding can move a cosine made from two stored angles, many times over.
SLACK = 1e-6


def directions(sample: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors of a sample that are far from each other: each is the one farthest from all before it."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    chosen = []
    nearest = np.full(len(unit), -1.0)
    while len(chosen) < min(count, len(unit)):
        at = int(np.argmin(nearest)) if chosen else 0
        if chosen and nearest[at] > 1 - 1e-9:
            break
        chosen.append(unit[at])
        nearest = np.maximum(nearest, unit @ unit[at])
    return np.array(chosen).reshape(len(chosen), sample.shape[1])


def angles_to(rows: np.ndarray, norms: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Angles of rows to unit vectors; a zero row stands at a right angle to everything."""
    if not len(to) or to.shape[1] != rows.shape[1]:
        return np.zeros((len(rows), 0))
    cosine = np.divide(rows @ to.T, norms[:, None], out=np.zeros((len(rows), len(to))), where=norms[:, None] > 0)
    return np.arccos(np.clip(cosine, -1, 1))


def score_bounds(a_norm: np.ndarray, a_angle: np.ndarray, x_norm: np.ndarray, x_angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every anchor with every row, from norms and angles alone."""
    least = np.full((len(a_norm), len(x_norm)), -1.0)
    most = np.ones_like(least)
    for d in range(a_angle.shape[1]):
        both = np.outer(np.cos(a_angle[:, d]), np.cos(x_angle[:, d]))
        off = np.outer(np.sin(a_angle[:, d]), np.sin(x_angle[:, d]))
        # The cosines of the difference and of the sum. Beyond pi the sum's holds too: the angles to the
        # opposite direction add up to what is left of the circle.
        np.minimum(most, both + off, out=most)
        np.maximum(least, both - off, out=least)
    scale = np.outer(a_norm, x_norm)
    return (least - SLACK) * scale - 1e-6, (most + SLACK) * scale + 1e-6


def block_reach(a_norm: np.ndarray, a_angle: np.ndarray, x_norm: np.ndarray, x_angle: np.ndarray) -> np.ndarray:
    """Greatest inner product that each anchor could have with a row whose angles lie in the block's ranges."""
    cosine = np.ones(len(a_norm))
    if len(x_norm) and a_angle.shape[1]:
        gap = np.maximum(np.maximum(x_angle.min(axis=0) - a_angle, a_angle - x_angle.max(axis=0)), 0)
        cosine = np.minimum(cosine, np.cos(gap).min(axis=1))
    longest, shortest = x_norm.max(initial=0), x_norm.min(initial=np.inf)
    reach = np.where(cosine + SLACK >= 0, (cosine + SLACK) * longest, (cosine + SLACK) * (shortest if len(x_norm) else 0))
    return reach * a_norm + 1e-6


def _scores(a: np.ndarray, x: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 2**52:
        if 8 * len(row) > len(a) * len(x):
            return (a @ x.T)[row, column].astype(np.int64)
        return np.einsum("ij,ij->i", a[row], x[column]).astype(np.int64)
    return np.einsum("ij,ij->i", a[row].astype(np.int64), x[column].astype(np.int64))


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, ties to the smaller id, in that order."""
    order = np.lexsort((ids, -score, row))
    first = np.searchsorted(row[order], row[order])
    return order[np.arange(len(order)) - first < k]


def _raise(floor: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> None:
    """Rows that found k scores need at least the lowest of them from now on."""
    worst = np.full(len(floor), np.inf)
    np.minimum.at(worst, row, score)
    full = np.bincount(row, minlength=len(floor)) >= k
    floor[full] = np.maximum(floor[full], worst[full])


def _side(frame: pd.DataFrame, at: slice = slice(None)) -> tuple[np.ndarray, ...]:
    part = frame.iloc[at]
    return stacked(part["v"]), part["vec_id"].to_numpy(), part["label"].to_numpy(), part["norm"].to_numpy(), stacked(part["angles"])


def positives_in_block(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """anchor_id, slot (0), vec_id, score: each anchor's best k rows of its label in the block, of those that
    reach `least`."""
    out = []
    for at in range(0, len(anchors), TOGETHER):
        a, a_id, a_label, a_norm, a_angle = _side(anchors, slice(at, at + TOGETHER))
        floor = anchors["least"].to_numpy()[at : at + TOGETHER].astype(np.float64)
        for b in range(0, len(rows), RUN):
            x, x_id, x_label, x_norm, x_angle = _side(rows, slice(b, b + RUN))
            alive = np.flatnonzero(block_reach(a_norm, a_angle, x_norm, x_angle) >= floor)
            least, most = score_bounds(a_norm[alive], a_angle[alive], x_norm, x_angle)
            fits = (a_label[alive, None] == x_label[None, :]) & (a_id[alive, None] != x_id[None, :])
            if fits.shape[1] >= k:
                # k rows score at least the k-th best lower bound.
                kth = -np.partition(np.where(fits, -least, np.inf), k - 1, axis=1)[:, k - 1]
                floor[alive] = np.maximum(floor[alive], kth)
            row, column = np.nonzero(fits & (most >= floor[alive, None]))
            score = _scores(a, x, alive[row], column)
            keep = score >= floor[alive[row]]
            row, column, score = alive[row][keep], column[keep], score[keep]
            top = _best(row, x_id[column], score, k)
            _raise(floor, row[top], score[top], k)
            out.append(pd.DataFrame({"anchor_id": a_id[row[top]], "slot": 0, "vec_id": x_id[column[top]], "score": score[top]}))
    return _some(out)


def negatives_in_block(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """anchor_id, slot (the window), vec_id, score: the best k rows of other labels in each window."""
    out = []
    for at in range(0, len(anchors), TOGETHER):
        a, a_id, a_label, a_norm, a_angle = _side(anchors, slice(at, at + TOGETHER))
        lows, highs = (list(anchors[c].to_numpy()[at : at + TOGETHER]) for c in ("lows", "highs"))
        slots = max(map(len, lows), default=0)
        # Missing windows are empty.
        low, high = (np.array([[*w, *[fill] * (slots - len(w))] for w in side], dtype=np.float64).reshape(len(a), slots) for side, fill in ((lows, np.inf), (highs, -np.inf)))
        for b in range(0, len(rows), RUN):
            x, x_id, x_label, x_norm, x_angle = _side(rows, slice(b, b + RUN))
            alive = np.flatnonzero(block_reach(a_norm, a_angle, x_norm, x_angle) >= low.min(axis=1, initial=np.inf))
            least, most = score_bounds(a_norm[alive], a_angle[alive], x_norm, x_angle)
            overlap = np.zeros(least.shape, dtype=bool)
            for s in range(slots):
                overlap |= (most >= low[alive, s, None]) & (least <= high[alive, s, None])
            row, column = np.nonzero(overlap & (a_label[alive, None] != x_label[None, :]))
            row = alive[row]
            score = _scores(a, x, row, column)
            for s in range(slots):
                inside = np.flatnonzero((score >= low[row, s]) & (score <= high[row, s]))
                top = inside[_best(row[inside], x_id[column[inside]], score[inside], k)]
                _raise(low[:, s], row[top], score[top], k)
                out.append(pd.DataFrame({"anchor_id": a_id[row[top]], "slot": s, "vec_id": x_id[column[top]], "score": score[top]}))
    return _some(out)


_SCHEMA = "anchor_id long, slot int, vec_id long, score long"


def _some(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([pd.DataFrame({"anchor_id": [], "slot": [], "vec_id": [], "score": []}), *frames]).astype({"anchor_id": "int64", "slot": "int32", "vec_id": "int64", "score": "int64"})


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components are floor(scale * x), a score is their integer inner product; it must fit 64 bits. An anchor
    (is_anchor is a condition on vec_id) has as positives its `positives` best other rows of its label. For
    each, the `negatives` best rows of other labels with low * positive <= 100 * score <= high * positive are
    returned. Higher scores come first, ties by smaller id; fewer, if there are fewer.

    Rows with a null id or label, or a null vector or one with null or non-finite components take no part; of
    rows that share an id the smallest vector counts, then the smallest label. Vectors of different lengths
    don't meet. A positive with a negative score has no negatives. An empty table gives an empty one. Other
    columns are ignored."""
    spark = vectors.sparkSession
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = labelled_per_id(vectors.where(F.col(label_col).isNotNull()), id_col, vector_col, label_col)
    rows = written(rows.select("vec_id", F.col("label").cast("string").alias("label"), whole.alias("v"), F.size("v").alias("dims")), "vectors")
    refs = directions(hashed_sample(rows, FITTED, rows.count()))

    def with_angles(batches):
        for frame in batches:
            out = []
            for _, part in frame.groupby("dims"):
                v = stacked(part["v"])
                norm = np.linalg.norm(v, axis=1)
                angles = angles_to(v, norm, refs)
                cell = angles.argmin(axis=1) if angles.shape[1] else np.zeros(len(part), dtype=np.int64)
                out.append(part.assign(norm=norm, angles=list(angles), cell=cell.astype("int32")))
            yield pd.concat(out) if out else frame.assign(norm=0.0, angles=None, cell=0)

    rows = written(rows.mapInPandas(with_angles, "vec_id long, label string, v array<double>, dims int, norm double, angles array<double>, cell int"), "angles")

    # Blocks of a direction, numbered within each length of vectors: a bounded number of counts.
    counts = rows.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.sum(is_anchor.cast("long")).alias("anchors")).orderBy("dims", "cell").collect()
    first, parts, blocks, anchors = {}, {}, {}, {}
    for r in counts:
        first[r["dims"], r["cell"]] = blocks.get(r["dims"], 0)
        parts[r["dims"], r["cell"]] = math.ceil(r["n"] / BLOCK)
        blocks[r["dims"]] = blocks.get(r["dims"], 0) + parts[r["dims"], r["cell"]]
        anchors[r["dims"]] = anchors.get(r["dims"], 0) + r["anchors"]
    if not sum(anchors.values()):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def known(values: dict, *key: str) -> Column:
        return F.create_map(*(F.lit(x) for k, n in values.items() for x in ("/".join(map(str, k if isinstance(k, tuple) else (k,))), n)))[F.concat_ws("/", *key)]

    spread = F.pmod(F.xxhash64("vec_id"), known(parts, "dims", "cell")).cast("int")
    groups = {d: max(1, math.ceil(n / ANCHORS)) for d, n in anchors.items()}
    rows = rows.withColumn("block", known(first, "dims", "cell") + spread)
    asking = written(rows.where(is_anchor).withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), known(groups, "dims")).cast("int")).drop("cell", "block"), "anchors")
    columns = ["vec_id", "label", "v", "norm", "angles"]
    each = rows.select(*columns, "dims", "block", F.explode(F.sequence(F.lit(0), known(groups, "dims") - 1)).alias("group"))

    def rounds(asked_after, kernel, k: int) -> DataFrame:
        """What the kernel finds over all blocks: in every round anchors know what was found before."""
        order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        found, before = None, None

        def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return kernel(left, right, k) if len(left) and len(right) else _some([])

        most = max(blocks.values())
        for part in [p for p in ROUNDS if p == 1 or most >= 2 * p]:
            share = lambda c, part=part: F.pmod(F.xxhash64(c), F.lit(part)) == 0
            now = lambda c, before=before: share(c) if before is None else share(c) & ~before(c)
            asked = asked_after(found).withColumn("block", F.explode(F.sequence(F.lit(0), known(blocks, "dims") - 1)))
            keys = ["dims", "block", "group"]
            met = asked.where(now("block")).groupBy(*keys).cogroup(each.where(now("block")).groupBy(*keys)).applyInPandas(compared, _SCHEMA)
            found = met if found is None else found.unionByName(met)
            found = written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "found")
            before = share
        return found.withColumn("rank", F.row_number().over(order))

    def kth(found: DataFrame, k: int) -> DataFrame:
        """anchor_id, slot, least: what the next round must reach, where k are found."""
        return found.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n")

    def for_positives(found: DataFrame | None) -> DataFrame:
        if found is None:
            return asking.withColumn("least", F.lit(float("-inf")))
        least = kth(found, positives).select(F.col("anchor_id").alias("vec_id"), F.col("least").cast("double"))
        return asking.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    positive = written(rounds(for_positives, positives_in_block, positives).select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole numbers: a positive's score is not negative here.
    floor = F.call_function("div", F.col("positive_score") * low + 99, F.lit(100)).cast("double")
    ceiling = F.call_function("div", F.col("positive_score") * high, F.lit(100)).cast("double")

    def for_negatives(found: DataFrame | None) -> DataFrame:
        windows = positive.where("positive_score >= 0").withColumn("least", floor)
        if found is not None:
            more = kth(found, negatives).withColumnRenamed("least", "raised")
            windows = windows.join(more, ["anchor_id", "slot"], "left").withColumn("least", F.greatest("least", "raised"))
        sides = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("slot", "least", ceiling.alias("most")))).alias("w"))
        return asking.join(sides, "vec_id").select(*asking.columns, F.col("w.least").alias("lows"), F.col("w.most").alias("highs"))

    negative = rounds(for_negatives, negatives_in_block, negatives)
    out = positive.join(negative.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score"), ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in SQL, all pairs.
MINE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM pair WHERE same) WHERE k <= 5
), negative AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positive p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5"""
