"""Writing exports. Every sink writes what Spark has partitioned; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object a line; with `by`, one folder for each value."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def write_property_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """CSV tables of nodes and edges, as graph loaders take them."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def literal(value):
    """A quoted literal of an N-Quads line."""
    text = value
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def quad_lines(quads: DataFrame, base: str = "urn:statement:") -> DataFrame:
    iri = lambda c: F.concat(F.lit(f"<{base}"), c, F.lit(">"))
    return quads.select(F.concat_ws(" ", iri(F.col("subject")), iri(F.col("predicate")), literal(F.col("object")), iri(F.col("graph")), F.lit(".")).alias("value"))


def read_quads(lines: DataFrame, base: str = "urn:statement:") -> DataFrame:
    """The four columns of N-Quads lines."""
    part = lambda k: F.regexp_extract("value", r'^<([^>]*)> <([^>]*)> "((?:[^"\\]|\\.)*)" <([^>]*)> \.$', k)
    name = lambda k: F.replace(part(k), F.lit(base), F.lit(""))
    text = part(3)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return lines.select(name(1).alias("subject"), name(2).alias("predicate"), text.alias("object"), name(4).alias("graph"))


def write_quads(quads: DataFrame, path: str) -> None:
    quad_lines(quads).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Script lines (order_key, line) in order: range-partitioned, so files follow one another."""
    lines.repartitionByRange("order_key").sortWithinPartitions("order_key").select("line").write.mode("overwrite").text(path)
