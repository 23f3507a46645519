"""Networks that grow by layers: what a looked-up entity's bundle says is stitched onto the node it was looked up for.

lines: lei, seq, value (a statement as JSON); signals: lei, seq, value (JSON). A layer takes the open frontier
of every root at once, reads those entities' bundles, puts the node's id in place of every id that the bundle
gives the entity, and merges statements by id and signals by their whole text; the first one stays. Layers are
written as they are made, so lineage and plans don't grow with the depth.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph import schema
from holdgraph.functions import codelists as C
from holdgraph.lineage import written
from holdgraph.sources import statements as st

#: Entities that one layer of a root takes at most, as the published interface has it.
MOST = 25
_LEI = "^[A-Z0-9]{18}[0-9]{2}$"
# How a filing spells the registers in which a controlling company can be looked up.
UK_NAMES = ("united kingdom", "england", "scotland", "wales", "northern ireland", "gb", "uk")


class Expansion(NamedTuple):
    """statements: root, layer, statement_id, kind, lei, subject_id, party_id, value. signals: root, layer,
    value. layers: root, layer, n_items, truncated (some of the frontier had to wait)."""

    statements: DataFrame
    signals: DataFrame
    layers: DataFrame


def _read(lines: DataFrame) -> DataFrame:
    """lines with what the walk needs of them; lines that aren't JSON or have no id are left out."""
    raw = lines.withColumn("raw", F.try_parse_json("value")).where("raw IS NOT NULL")
    ids = F.coalesce(F.try_variant_get(F.col("raw"), "$.recordDetails.identifiers", f"array<{schema.IDENTIFIER}>"), F.array().cast(f"array<{schema.IDENTIFIER}>"))
    types = F.transform(F.try_variant_get(F.col("raw"), "$.recordDetails.interests", "array<struct<type:string>>"), lambda i: i["type"])
    read = raw.withColumns({"statement_id": st.statement_id(), "kind": st.statement_kind(), "ids": ids, "subject_id": st.endpoint("raw", "subject")[0], "party_id": st.endpoint("raw", "interestedParty")[0], "types": types})
    return read.drop("raw").where("statement_id IS NOT NULL")


def _own_lei(ids: Column) -> Column:
    """An entity's LEI: the first identifier of that shape under such a scheme, else of that shape."""
    shaped = F.filter(F.transform(ids, lambda i: F.struct(F.upper(F.trim(i["id"])).alias("id"), F.upper(F.concat_ws(" ", i["scheme"], i["schemeName"])).alias("scheme"))), lambda i: i["id"].rlike(_LEI))
    return F.coalesce(F.get(F.filter(shaped, lambda i: F.contains(i["scheme"], F.lit("LEI"))), F.lit(0))["id"], F.get(shaped, F.lit(0))["id"])


def identities(lines: DataFrame) -> DataFrame:
    """lei, olds: ids of the statements in an entity's own bundle that are the entity. Those that assert the LEI give
    the values by which registers that don't know it are recognised."""
    value = lambda i: F.upper(F.trim(i["id"]))
    entity = _read(lines).where("kind = 'entity'").select("lei", "statement_id", F.array_distinct(F.filter(F.transform("ids", value), lambda v: v != "")).alias("values"))
    asserted = entity.where(F.array_contains("values", F.col("lei"))).select("lei", F.explode("values").alias("value")).distinct()
    named = entity.select("lei", "statement_id", F.explode("values").alias("value"))
    return named.join(asserted, ["lei", "value"]).groupBy("lei").agg(F.array_sort(F.collect_set("statement_id")).alias("olds"))


def _stitched(value: str = "value") -> Column:
    """The text with the node's id in place of each of the bundle's."""
    return F.aggregate(F.coalesce("olds", F.array().cast("array<string>")), F.col(value), lambda v, old: F.replace(v, old, F.col("anchor")))


def _first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def frontier(statements: DataFrame, expanded: DataFrame, direction: str = "owners") -> DataFrame:
    """root, lei, anchor, place: entities with an LEI that weren't expanded and, going up, that nobody shown owns or
    controls; going down, that own or control nothing shown. Offices are neither. In the order of arrival."""
    side = "subject_id" if direction == "owners" else "party_id"
    office = (F.size("types") > 0) & F.forall("types", lambda x: x.isin(*C.DIRECTORSHIPS))
    taken = statements.where((F.col("kind") == "relationship") & ~F.coalesce(office, F.lit(False))).select("root", F.col(side).alias("statement_id")).distinct()
    open_ = statements.where("kind = 'entity' AND lei IS NOT NULL").join(taken, ["root", "statement_id"], "left_anti")
    open_ = open_.join(expanded.select("root", F.col("anchor").alias("statement_id")), ["root", "statement_id"], "left_anti")
    order = Window.partitionBy("root").orderBy("layer", "item", "seq", "statement_id")
    return open_.select("root", "lei", F.col("statement_id").alias("anchor"), F.row_number().over(order).alias("place"))


def expand(seeds: DataFrame, lines: DataFrame, signals: DataFrame, depth: int, most: int = MOST, direction: str = "owners") -> Expansion:
    """Layers from the seeds (root, lei, anchor, place), until nothing is open or `depth` is reached. A layer takes
    the first `most` of a root's frontier; the rest waits for the next, and layers say so. An LEI without a
    bundle adds nothing and isn't asked again; of statements without an id and text that isn't JSON nothing is
    kept. Null LEIs don't count."""
    clean = lambda df: df.withColumn("lei", F.upper(F.trim("lei"))).where("lei IS NOT NULL")
    lines, signals = clean(lines), clean(signals)
    olds = written(identities(lines), "identities")
    known = lines.join(olds, "lei", "left")
    said = signals.join(olds, "lei", "left")
    items = written(clean(seeds).select("root", "lei", "anchor", "place"), "items")
    expanded: DataFrame | None = None
    all_statements, all_signals, layers = [], [], []
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    for layer in range(1, depth + 1):
        if items.isEmpty():
            break
        layers.append(items.groupBy("root").agg(F.least(F.count("*"), F.lit(most)).alias("n_items"), (F.count("*") > most).alias("truncated")).withColumn("layer", F.lit(layer)))
        now = items.where(F.col("place") <= most).withColumnRenamed("place", "item")
        done = now.select("root", "anchor")
        expanded = done if expanded is None else expanded.unionByName(done)
        asked = now.select("root", F.col("lei").alias("of"), "anchor", "item")
        got = asked.join(known.withColumnRenamed("lei", "of"), "of").withColumn("value", _stitched())
        new = _read(got.select("root", "item", "seq", "value")).withColumn("lei", F.when(F.col("kind") == "entity", _own_lei(F.col("ids")))).drop("ids")
        new = _first(new, ["root", "statement_id"], ["item", "seq", "value"]).withColumn("layer", F.lit(layer))
        if all_statements:
            new = new.join(union(all_statements).select("root", "statement_id"), ["root", "statement_id"], "left_anti")
        all_statements.append(written(new, "layer"))
        heard = asked.join(said.withColumnRenamed("lei", "of"), "of").select("root", _stitched().alias("value")).distinct().withColumn("layer", F.lit(layer))
        if all_signals:
            heard = heard.join(union(all_signals).select("root", "value"), ["root", "value"], "left_anti")
        all_signals.append(written(heard, "signals"))
        items = written(frontier(union(all_statements), expanded, direction), "items")
    if not layers:
        nothing = seeds.where("false")
        none = lambda *columns: nothing.select(F.col("root"), *(F.lit(None).cast(t).alias(c) for c, t in columns))
        return Expansion(none(("layer", "int"), ("statement_id", "string"), ("kind", "string"), ("lei", "string"), ("subject_id", "string"), ("party_id", "string"), ("value", "string")), none(("layer", "int"), ("value", "string")), none(("layer", "int"), ("n_items", "long"), ("truncated", "boolean")))
    columns = ("root", "layer", "statement_id", "kind", "lei", "subject_id", "party_id", "value")
    return Expansion(union(all_statements).select(*columns), union(all_signals).select("root", "layer", "value"), union(layers).select("root", "layer", "n_items", "truncated"))


def controlling_companies(filings: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """root, number, depth, via: companies above a company by what it files, each once at its least depth and of
    several ways under the smallest number. filings: number, items (array of kind, ceased_on,
    registration_number, country). Followed are corporate entities and legal persons that haven't ceased, with
    a number of eight letters and digits in a register of the United Kingdom. roots: root."""
    item = F.col("item")
    kind, reg = F.lower(F.coalesce(item["kind"], F.lit(""))), F.trim(F.coalesce(item["registration_number"], F.lit("")))
    kept = (F.coalesce(item["ceased_on"], F.lit("")) == "") & (F.contains(kind, F.lit("corporate")) | F.contains(kind, F.lit("legal-person")))
    kept = kept & reg.rlike("^[A-Za-z0-9]{8}$") & F.lower(F.trim(F.coalesce(item["country"], F.lit("")))).isin(*UK_NAMES)
    up = written(filings.select("number", F.explode("items").alias("item")).where(kept).select("number", reg.alias("next")).distinct(), "filings")
    seen = roots.select("root", F.col("root").alias("number"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct()
    front = seen
    for d in range(1, depth + 1):
        reached = front.select("root", "number").join(up, "number").groupBy("root", F.col("next").alias("number")).agg(F.min("number").alias("via"))
        front = written(reached.join(seen, ["root", "number"], "left_anti").select("root", "number", F.lit(d).alias("depth"), "via"), "companies")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")
