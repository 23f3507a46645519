"""Exports of the derived statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.operators import exports as X
from holdgraph.plans.registry import query
from holdgraph.sources import derived


@query(f"""WITH {derived.SQL}, i AS (SELECT statement_id, party_id, subject_id, unnest(CASE WHEN key % 6 = 0 THEN [NULL] WHEN key % 6 = 1 THEN [type, 'boardMember'] ELSE [type] END) AS interest, generate_subscripts(CASE WHEN key % 6 = 0 THEN [NULL] WHEN key % 6 = 1 THEN [type, 'boardMember'] ELSE [type] END, 1) AS place FROM relationship)
SELECT statement_id || CASE WHEN place > 1 THEN '-' || place ELSE '' END AS link_id, CASE WHEN interest IS NULL THEN 'UnknownLink' WHEN interest = 'boardMember' THEN 'Directorship' ELSE 'Ownership' END AS schema, party_id AS source, subject_id AS target FROM i
WHERE party_id IN (SELECT statement_id FROM entity WHERE entity_type <> 'anonymousEntity') AND subject_id IN (SELECT statement_id FROM entity WHERE entity_type <> 'anonymousEntity')""")
def ftm_links(spark, sf_dir):
    """One link an interest, dangling ones dropped (SK5, SK6, JN7)."""
    k = F.col("key") % 6
    interests = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("type", F.lit("boardMember"))).otherwise(F.array("type"))
    nodes = derived.entities(spark, sf_dir).where("entity_type <> 'anonymousEntity'").select("statement_id")
    return X.entity_links(derived.relationships(spark, sf_dir).withColumn("interests", interests), nodes)


@query(f"""WITH {derived.SQL} SELECT e.statement_id, e.name, count(r.statement_id) AS n_pointers, coalesce(string_agg(upper(r.type) || ':' || r.subject_id, '|' ORDER BY upper(r.type) || ':' || r.subject_id), '') AS pointers FROM entity e LEFT JOIN relationship r ON r.party_id = e.statement_id GROUP BY e.statement_id, e.name""")
def endpoint_fold(spark, sf_dir):
    """Relationships folded into the interested party's record (SK7, SK8)."""
    r = X.pointer_records(derived.entities(spark, sf_dir), derived.relationships(spark, sf_dir).where("party_id IS NOT NULL"))
    return r.select("statement_id", "name", F.size("pointers").cast("long").alias("n_pointers"), F.array_join("pointers", "|").alias("pointers"))


@query(f"""WITH {derived.SQL} SELECT '0' || statement_id AS order_key, 'MERGE (n:Entity {{id: ''' || statement_id || '''}}) SET n.name = ''' || replace(replace(name, '\\', '\\\\'), '''', '\\''') || ''', n.jurisdiction = ''' || jurisdiction || ''';' AS line FROM entity
UNION ALL SELECT '1' || statement_id, 'MATCH (a {{id: ''' || party_id || '''}}), (b {{id: ''' || subject_id || '''}}) MERGE (a)-[r:OWNS_OR_CONTROLS]->(b) SET r.interest = ''' || type || ''';' FROM relationship WHERE party_id IS NOT NULL""")
def cypher_script(spark, sf_dir):
    """Nodes and edges as idempotent statements (SK10, SF35)."""
    return X.cypher_lines(derived.entities(spark, sf_dir), derived.relationships(spark, sf_dir))


@query(f"""WITH {derived.SQL}, q AS (SELECT statement_id AS subject, unnest(['a', 'name', 'jurisdiction', 'entityType']) AS predicate, unnest(['Entity', name, jurisdiction, entity_type]) AS object FROM entity
UNION ALL SELECT statement_id, unnest(['a', 'interestedParty', 'subject', 'interestType']), unnest(['Relationship', party_id, subject_id, type]) FROM relationship)
SELECT subject, predicate, object, 'graph:' || subject AS graph FROM q WHERE object IS NOT NULL""")
def rdf_quads(spark, sf_dir):
    """Statements as quads, one graph each (SK13, SK15)."""
    return X.quads(derived.entities(spark, sf_dir), derived.relationships(spark, sf_dir))


@query(f"""WITH {derived.SQL} SELECT predicate, count(*) AS n, count(DISTINCT object) AS n_objects FROM (SELECT unnest(['a', 'name', 'jurisdiction', 'entityType']) AS predicate, unnest(['Entity', name, jurisdiction, entity_type]) AS object FROM entity
UNION ALL SELECT unnest(['a', 'interestedParty', 'subject', 'interestType']), unnest(['Relationship', party_id, subject_id, type]) FROM relationship) WHERE object IS NOT NULL GROUP BY predicate""")
def quad_counts(spark, sf_dir):
    """Counts over quads (AG17, SC25)."""
    return X.quads(derived.entities(spark, sf_dir), derived.relationships(spark, sf_dir)).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("object").alias("n_objects"))


@query(f"""WITH {derived.SQL}, s AS (SELECT bundle_id, 'entity' AS kind FROM entity UNION ALL SELECT bundle_id, 'relationship' FROM relationship)
SELECT bundle_id, count(CASE WHEN kind = 'entity' THEN 1 END) AS n_entities, count(CASE WHEN kind = 'relationship' THEN 1 END) AS n_relationships, count(*) AS n FROM s GROUP BY bundle_id""")
def export_manifest(spark, sf_dir):
    """Statements of a bundle by kind (SK1, SK3, AG20)."""
    s = derived.entities(spark, sf_dir).select("bundle_id", F.lit("entity").alias("kind")).unionByName(derived.relationships(spark, sf_dir).select("bundle_id", F.lit("relationship").alias("kind")))
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return s.groupBy("bundle_id").agg(n("entity").alias("n_entities"), n("relationship").alias("n_relationships"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT 's' || o_custkey AS statement_id, CASE WHEN o_orderkey % 2 = 0 THEN 'entity' ELSE 'relationship' END AS kind, CAST(o_orderkey % 5 AS INTEGER) AS file_rank, o_orderkey AS line FROM orders)
SELECT statement_id, kind, file_rank, line, CASE WHEN kind = 'relationship' THEN 1 ELSE 0 END AS part FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY file_rank, line, kind) AS k FROM p) WHERE k = 1""")
def dataset_assembly(spark, sf_dir):
    """Part files in one: first id wins, nodes before relationships (SK16, SK21)."""
    k = F.col("o_orderkey")
    p = derived.table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("statement_id"), F.when(k % 2 == 0, "entity").otherwise("relationship").alias("kind"), (k % 5).cast("int").alias("file_rank"), k.alias("line"))
    return X.assembled(p)
