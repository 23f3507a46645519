"""What the operators share of the session: where cut lineage is written, and reading tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdgraph import lineage


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: what follows neither
    repeats the work before it nor loses it with an executor."""
    return lineage.written(df, name)


#: Rows of an Arrow batch: texts are long, and a batch stands several times in an executor's memory.
BATCH_ROWS = 2000


def with_small_batches(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, after the session is told to hand BATCH_ROWS rows at once to Python."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns, so that no other column can clash with what an operator adds."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
