"""The change stream: the same operators on a stream of events, with state kept by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdgraph.lineage import shared_folder


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of folder/name as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def mix(events: DataFrame) -> DataFrame:
    """Running counts of the event mix."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("n_ceased"))


def records(events: DataFrame) -> DataFrame:
    """Events as records: deleted ones and those without data give none, ceased ones are closed."""
    status = F.when(F.col("value") > 90, "closed").otherwise("new")
    return events.where("event_type <> 'error' AND props IS NOT NULL").select("event_id", F.col("user_id").alias("record_id"), status.alias("status"))


def windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by event-time window, with late rows bounded by a watermark (an extension)."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, each batch written once to the shared folder under its own
    number (so a repeated batch replaces itself), and reads the last state of a complete stream or all of an
    appending one."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/number={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    if mode == "complete":
        out = out.where(F.col("_batch") == out.agg(F.max("_batch")).first()[0])
    return out.drop("_batch", "number")


def closings(events: DataFrame) -> DataFrame:
    """Records with the closings that deletions stand for: a deletion has no data, so the last state that was
    seen of its record is kept by key, and closed when the deletion arrives. events: record_id, seq, data
    (null: deleted). Rows: record_id, seq, data, status."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        for frame in frames:
            rows = []
            for r in frame.sort_values("seq").itertuples():
                if r.data is not None:
                    rows.append((key[0], r.seq, r.data, "updated" if last is not None else "new"))
                    last = r.data
                elif last is not None:
                    rows.append((key[0], r.seq, last, "closed"))
                    last = None
            yield pd.DataFrame(rows, columns=["record_id", "seq", "data", "status"])
        if last is None:
            if state.exists:
                state.remove()
        else:
            state.update((last,))

    return events.groupBy("record_id").applyInPandasWithState(step, "record_id string, seq long, data string, status string", "data string", "append", GroupStateTimeout.NoTimeout)
