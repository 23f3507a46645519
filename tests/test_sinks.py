"""Sinks read back, and keyed state in the change stream."""

from pyspark.sql import functions as F

from holdgraph.sources import sinks
from holdgraph.streaming import changes


def test_quads_round_trip(spark, tmp_path):
    rows = [("s1", "name", 'A "B" \\ C\nD', "graph:s1"), ("s2", "a", "Entity", "graph:s2")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string, graph string")
    sinks.write_quads(df, f"{tmp_path}/q")
    assert sorted(map(tuple, sinks.read_quads(spark.read.text(f"{tmp_path}/q")).collect())) == sorted(rows)


def test_lines_stay_in_order(spark, tmp_path):
    df = spark.createDataFrame([(f"{i:04}", f"line {i}") for i in range(500)], "order_key string, line string").repartition(7)
    sinks.write_lines(df, f"{tmp_path}/l")
    files = sorted(p for p in (tmp_path / "l").iterdir() if p.name.startswith("part"))
    assert [x for p in files for x in p.read_text().splitlines()] == [f"line {i}" for i in range(500)]


def test_json_and_graph(spark, tmp_path):
    df = spark.createDataFrame([("b1", "e1"), ("b2", "e2")], "bundle_id string, id string")
    sinks.write_json_lines(df, f"{tmp_path}/j", "bundle_id")
    assert {(r.bundle_id, r.id) for r in spark.read.json(f"{tmp_path}/j").collect()} == {("b1", "e1"), ("b2", "e2")}
    sinks.write_property_graph(df, df, f"{tmp_path}/g")
    assert spark.read.option("header", True).csv(f"{tmp_path}/g/edges").count() == 2


def test_deletions_close_the_last_state(spark, tmp_path):
    schema = "record_id string, seq long, data string"
    for k, rows in enumerate(([("a", 1, "x"), ("b", 2, None)], [("a", 3, "y"), ("a", 4, None), ("c", 5, "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = changes.drained(changes.closings(stream))
    assert {(r.record_id, r.data, r.status) for r in out.where(F.col("status") == "closed").collect()} <= {("a", "y", "closed"), ("a", "x", "closed")}
    assert out.where("status = 'closed' AND record_id = 'a'").count() == 1
    assert out.where("record_id = 'b'").count() == 0
