"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(embedding, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))


def one_per_id(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: of usable rows that share an id the smallest vector; no null ids."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return v.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min("v").alias("v"))


def stacked(column) -> np.ndarray:
    """Rows of a column of arrays as a matrix of doubles."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def labelled_per_id(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, v, label: of usable rows that share an id the one with the smallest vector, then label (null
    first); no null ids."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("row"))
    return v.select("vec_id", "row.v", "row.label")


def hashed_sample(rows: DataFrame, about: int, total: int, column: str = "v") -> np.ndarray:
    """The vectors of about so many of `total` rows (vec_id, column), chosen by their ids' hashes and in their
    order, as a matrix of doubles; vectors of another length than the first's are left out. At most twice the
    number is collected, however many rows and partitions there are."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    some = rows.where(part < int((1 << 40) * min(1.0, about / max(total, 1)))).select(part.alias("part"), "vec_id", F.col(column).alias("v")).limit(2 * about).collect()
    found = [np.array(r["v"], dtype=np.float64) for r in sorted(some, key=lambda r: (r["part"], r["vec_id"]))]
    return np.stack([v for v in found if len(v) == len(found[0])]) if found else np.zeros((0, 0))
