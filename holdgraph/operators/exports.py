"""Projections of statements to other models, as tables or lines ready to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdgraph.functions import codelists as C


def cypher_escaped(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def link_schema(interest: Column) -> Column:
    return F.when(interest.isNull(), "UnknownLink").when(interest.isin(*C.DIRECTORSHIPS), "Directorship").otherwise("Ownership")


def entity_links(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """One link an interest (ids id, id-2, ...), an unknown link where there is none; links with an endpoint
    that is not a node are dropped. relationships: statement_id, party_id, subject_id, interests array<string>."""
    one = relationships.select("statement_id", "party_id", "subject_id", F.posexplode_outer("interests").alias("place", "interest"))
    link = F.when(F.coalesce("place", F.lit(0)) == 0, F.col("statement_id")).otherwise(F.concat("statement_id", F.lit("-"), (F.col("place") + 1).cast("string")))
    known = one.join(nodes.select(F.col("statement_id").alias("party_id")), "party_id", "left_semi").join(nodes.select(F.col("statement_id").alias("subject_id")), "subject_id", "left_semi")
    return known.select(link.alias("link_id"), link_schema(F.col("interest")).alias("schema"), F.col("party_id").alias("source"), F.col("subject_id").alias("target"))


def pointer_records(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """Each node's record with its relationships folded in as sorted pointers."""
    pointers = relationships.groupBy(F.col("party_id").alias("statement_id")).agg(F.array_sort(F.collect_list(F.concat_ws(":", F.upper("type"), "subject_id"))).alias("pointers"))
    return nodes.join(pointers, "statement_id", "left").withColumn("pointers", F.coalesce("pointers", F.array().cast("array<string>")))


def cypher_lines(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """order_key, line: nodes first, then edges; parties that are unspecified give no edge."""
    node = F.concat(F.lit("MERGE (n:Entity {id: '"), cypher_escaped(F.col("statement_id")), F.lit("'}) SET n.name = '"), cypher_escaped(F.col("name")), F.lit("', n.jurisdiction = '"), cypher_escaped(F.col("jurisdiction")), F.lit("';"))
    edge = F.concat(F.lit("MATCH (a {id: '"), cypher_escaped(F.col("party_id")), F.lit("'}), (b {id: '"), cypher_escaped(F.col("subject_id")), F.lit("'}) MERGE (a)-[r:OWNS_OR_CONTROLS]->(b) SET r.interest = '"), cypher_escaped(F.col("type")), F.lit("';"))
    return entities.select(F.concat(F.lit("0"), "statement_id").alias("order_key"), node.alias("line")).unionByName(relationships.where("party_id IS NOT NULL").select(F.concat(F.lit("1"), "statement_id").alias("order_key"), edge.alias("line")))


def quads(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """subject, predicate, object, graph: one graph a statement."""
    q = lambda p, o: F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object"))
    e = entities.select(F.col("statement_id").alias("subject"), F.inline(F.array(q("a", F.lit("Entity")), q("name", F.col("name")), q("jurisdiction", F.col("jurisdiction")), q("entityType", F.col("entity_type")))))
    r = relationships.select(F.col("statement_id").alias("subject"), F.inline(F.array(q("a", F.lit("Relationship")), q("interestedParty", F.col("party_id")), q("subject", F.col("subject_id")), q("interestType", F.col("type")))))
    return e.unionByName(r).where("object IS NOT NULL").withColumn("graph", F.concat(F.lit("graph:"), "subject"))


def assembled(parts: DataFrame) -> DataFrame:
    """Statements of many files: the first of an id by file and line wins, nodes before relationships.
    parts: statement_id, kind, file_rank, line."""
    first = parts.groupBy("statement_id").agg(F.min(F.struct("file_rank", "line", "kind")).alias("f"))
    return first.select("statement_id", "f.kind", "f.file_rank", "f.line", (F.col("f.kind") == "relationship").cast("int").alias("part"))


def network_package(statements: DataFrame) -> DataFrame:
    """bundle_id, member, n_rows of a network's export: its statements by kind, as JSON and as lines. statements:
    bundle_id, kind."""
    per = statements.groupBy("bundle_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    each = per.select("bundle_id", F.concat("kind", F.lit(".jsonl")).alias("member"), F.col("n").alias("n_rows"))
    return each.unionByName(per.groupBy("bundle_id").agg(F.sum("n").alias("n_rows")).select("bundle_id", F.lit("statements.json").alias("member"), "n_rows"))


def party_tables(entities: DataFrame, persons: DataFrame, interests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of a party model: party (party_id, type), party_supplementary_data (party_id, field, value: share held of
    each subject and how many subjects) and account_party_link (account, party_id, role: every owned entity has
    an account that it holds, and its owners hold beside it)."""
    party = entities.select(F.col("statement_id").alias("party_id"), F.lit("COMPANY").alias("type")).unionByName(persons.select(F.col("statement_id").alias("party_id"), F.lit("CONSUMER").alias("type"))).distinct()
    held = interests.where("party_id IS NOT NULL").groupBy("party_id", "subject_id").agg(F.max("share").alias("share"))
    more = held.where("share IS NOT NULL").select("party_id", F.concat(F.lit("bo_ownership_pct_"), "subject_id").alias("field"), F.col("share").cast("double").alias("value"))
    more = more.unionByName(held.groupBy("party_id").agg(F.count(F.lit(1)).cast("double").alias("value")).select("party_id", F.lit("bo_subjects").alias("field"), "value"))
    account = F.concat(F.lit("bods-ownership-"), "subject_id").alias("account")
    links = held.select(account, F.col("subject_id").alias("party_id"), F.lit("PRIMARY_HOLDER").alias("role")).distinct().unionByName(held.select(account, "party_id", F.lit("SUPPLEMENTARY_HOLDER").alias("role")))
    return party, more, links


def analysis_quads(statements: DataFrame, matches: DataFrame, pairs: DataFrame, degraded: DataFrame, anchors: DataFrame) -> DataFrame:
    """Signals, possible doubles and screens that didn't run, as annotations of statements: subject, predicate, object,
    graph. matches (bundle_id, code, grade, statement_id) stay where their statement is there, else they stand
    at the bundle's anchor (bundle_id, statement_id); pairs: a, b; degraded: bundle_id, source."""
    anchor = anchors.select("bundle_id", F.col("statement_id").alias("anchor"))
    there = statements.select("statement_id", F.lit(True).alias("there"))
    at = matches.join(anchor, "bundle_id", "left").join(there, "statement_id", "left").select(F.when(F.col("there"), F.col("statement_id")).otherwise(F.col("anchor")).alias("target"), F.lit("commenting").alias("motivation"), F.col("code").alias("text"))
    same = pairs.join(statements.select(F.col("statement_id").alias("a")), "a", "left_semi").select(F.col("a").alias("target"), F.lit("linking").alias("motivation"), F.concat(F.lit("POSSIBLY_SAME_AS "), F.col("b").cast("string")).alias("text"))
    gone = degraded.join(anchor, "bundle_id").select(F.col("anchor").alias("target"), F.lit("commenting").alias("motivation"), F.concat(F.lit("DEGRADED_SOURCE "), "source").alias("text"))
    notes = at.unionByName(same).unionByName(gone).where("target IS NOT NULL").distinct()
    node = F.concat(F.lit("_:a"), F.hex(F.xxhash64("target", "motivation", "text")))
    said = F.array(F.struct(F.lit("target").alias("predicate"), F.col("target").alias("object")), F.struct(F.lit("motivation").alias("predicate"), F.col("motivation").alias("object")), F.struct(F.lit("description").alias("predicate"), F.col("text").alias("object")))
    return notes.select(node.alias("subject"), F.inline(said)).withColumn("graph", F.lit("analysis"))


def load_script(labels: list[str], folder: str) -> list[str]:
    """Statements that load a property-graph package: indexes, nodes by label, then edges."""
    load = lambda name: f"LOAD CSV WITH HEADERS FROM '{folder}/{name}.csv' AS row"
    nodes = [f"{load(label.lower())} MERGE (n:{label} {{statementId: row.statementId}}) SET n += row;" for label in labels]
    return [*(f"CREATE INDEX IF NOT EXISTS FOR (n:{label}) ON (n.statementId);" for label in labels), *nodes, f"{load('edge')} MATCH (a {{statementId: row.source}}), (b {{statementId: row.target}}) MERGE (a)-[r:OWNS {{statementId: row.statementId}}]->(b) SET r += row;"]
