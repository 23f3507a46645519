"""Networks grown by layers from bundles that are derived from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.functions import codelists as C
from holdgraph.operators import expansion
from holdgraph.plans.registry import query
from holdgraph.sources import derived

#: Layers and items of a layer in these queries.
DEPTH, MOST = 3, 2


def _lei(key):
    return F.format_string("L%017d00", key)


def landing(spark, sf_dir):
    """lines and signals by LEI: an entity under two ids (a register's doesn't know the LEI), its owners, the links."""
    e = derived.entities(spark, sf_dir).select("statement_id", "key", "name", "entity_type")
    r = derived.relationships(spark, sf_dir)
    ident = lambda scheme, v: F.struct(v.alias("id"), F.lit(scheme).alias("scheme"))
    entity = lambda sid, name, ids: F.to_json(F.struct(sid.alias("statementId"), F.lit("entity").alias("recordType"), F.struct(name.alias("name"), F.array_compact(F.array(*ids)).alias("identifiers")).alias("recordDetails")))
    text = lambda p, c: F.concat(F.lit(p), c)
    key = F.col("key")
    own_lei = lambda k: F.when(k % 7 != 0, ident("XI-LEI", _lei(k)))
    register = ident("GB-COH", F.format_string("R%07d", key))
    me = e.select(_lei(key).alias("lei"), F.lit(0).alias("seq"), entity(text("g-", F.col("statement_id")), F.col("name"), [ident("XI-LEI", _lei(key)), register]).alias("value"))
    mine = e.where("key % 2 = 0").select(_lei(key).alias("lei"), F.lit(1).alias("seq"), entity(text("h-", F.col("statement_id")), F.col("name"), [register]).alias("value"))
    party = r.where("party_id IS NOT NULL").withColumn("owner", F.substring("party_id", 2, 20).cast("long")).withColumn("of", F.substring("subject_id", 2, 20).cast("long"))
    owners = party.select(_lei(F.col("of")).alias("lei"), (2 + F.col("owner")).cast("int").alias("seq"), entity(text("g-", F.col("party_id")), F.col("party_id"), [own_lei(F.col("owner"))]).alias("value"))
    subject = text("g-", F.col("subject_id"))
    link = F.struct(F.when(F.substring("subject_id", 2, 20).cast("long") % 2 == 0, text("h-", F.col("subject_id"))).otherwise(subject).alias("subject"), text("g-", F.col("party_id")).alias("interestedParty"), F.array(F.struct("type")).alias("interests"))
    links = party.select(_lei(F.col("of")).alias("lei"), (10_000_000 + F.col("owner")).cast("int").alias("seq"), F.to_json(F.struct(F.col("statement_id").alias("statementId"), F.lit("relationship").alias("recordType"), link.alias("recordDetails"))).alias("value"))
    state = e.where("entity_type = 'stateBody'")
    signals = state.select(_lei(key).alias("lei"), F.lit(0).alias("seq"), F.to_json(F.struct(F.lit("STATE_CONTROLLED").alias("code"), text("g-", F.col("statement_id")).alias("statement"))).alias("value"))
    return me.unionByName(mine).unionByName(owners).unionByName(links), signals


def _layer(d: int, down: bool) -> str:
    side, before = ("party" if down else "subj"), f"SELECT * FROM acc{d - 1}"
    put = lambda c: f"CASE WHEN {c} IN ('g-e' || i.k, 'h-e' || i.k) THEN i.anchor ELSE {c} END"
    return f"""got{d} AS (SELECT i.root, {d} AS layer, i.place AS item, p.seq, {put("p.sid")} AS sid, p.kind, p.ek, {put("p.subj")} AS subj, {put("p.party")} AS party, p.type FROM item{d} i JOIN pay p ON p.k = i.k WHERE i.place <= {MOST}),
acc{d} AS MATERIALIZED ({before} UNION ALL SELECT root, layer, item, seq, sid, kind, ek, subj, party, type FROM (SELECT *, row_number() OVER (PARTITION BY root, sid ORDER BY item, seq, kind) AS n FROM got{d}) g WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM acc{d - 1} a WHERE a.root = g.root AND a.sid = g.sid)),
done{d} AS (SELECT * FROM done{d - 1} UNION ALL SELECT root, anchor FROM item{d} WHERE place <= {MOST}),
item{d + 1} AS MATERIALIZED (SELECT root, ek AS k, sid AS anchor, row_number() OVER (PARTITION BY root ORDER BY layer, item, seq, sid) AS place FROM acc{d} a WHERE kind = 'entity' AND ek IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM acc{d} x WHERE x.root = a.root AND x.kind = 'relationship' AND x.type NOT IN {C.DIRECTORSHIPS} AND x.{side} = a.sid) AND NOT EXISTS (SELECT 1 FROM done{d} z WHERE z.root = a.root AND z.anchor = a.sid))"""


_PAY = f"""{derived.SQL}, link AS (SELECT *, CAST(substr(party_id, 2) AS BIGINT) AS owner, CAST(substr(subject_id, 2) AS BIGINT) AS of_ FROM relationship WHERE party_id IS NOT NULL), pay AS MATERIALIZED (
  SELECT key AS k, 0 AS seq, 'g-' || statement_id AS sid, 'entity' AS kind, key AS ek, NULL AS subj, NULL AS party, NULL AS type FROM entity
  UNION ALL SELECT key, 1, 'h-' || statement_id, 'entity', NULL, NULL, NULL, NULL FROM entity WHERE key % 2 = 0
  UNION ALL SELECT of_, 2 + owner, 'g-' || party_id, 'entity', CASE WHEN owner % 7 <> 0 THEN owner END, NULL, NULL, NULL FROM link
  UNION ALL SELECT of_, 10000000 + owner, statement_id, 'relationship', NULL, CASE WHEN of_ % 2 = 0 THEN 'h-' ELSE 'g-' END || subject_id, 'g-' || party_id, type FROM link
), item1 AS (SELECT statement_id AS root, key AS k, 'node-' || statement_id AS anchor, 1 AS place FROM entity), acc0 AS (SELECT root, 0 AS layer, 0 AS item, 0 AS seq, anchor AS sid, 'x' AS kind, k AS ek, anchor AS subj, anchor AS party, anchor AS type FROM item1 WHERE false), done0 AS (SELECT root, anchor FROM item1 WHERE false),
{", ".join(_layer(d, False) for d in range(1, DEPTH + 1))}"""


def _seeds(spark, sf_dir):
    e = derived.entities(spark, sf_dir)
    return e.select(F.col("statement_id").alias("root"), _lei(F.col("key")).alias("lei"), F.concat(F.lit("node-"), "statement_id").alias("anchor"), F.lit(1).alias("place"))


@query(f"""WITH {_PAY}, cut AS (SELECT DISTINCT root FROM ({" UNION ALL ".join(f"SELECT root FROM item{d} WHERE place > {MOST}" for d in range(1, DEPTH + 1))}))
SELECT root, CAST(layer AS INTEGER) AS layer, sid AS statement_id, kind, subj AS subject_id, party AS party_id, root IN (SELECT root FROM cut) AS truncated FROM acc{DEPTH}""")
def expanded_networks(spark, sf_dir):
    """Three layers of owners around every entity, stitched and merged (GR11, GR13)."""
    lines, signals = landing(spark, sf_dir)
    grown = expansion.expand(_seeds(spark, sf_dir), lines, signals, DEPTH, MOST)
    cut = grown.layers.groupBy("root").agg(F.bool_or("truncated").alias("truncated"))
    return grown.statements.drop("lei", "value").join(cut, "root")


@query(f"""WITH {_PAY}, said AS (SELECT DISTINCT i.root, '{{"code":"STATE_CONTROLLED","statement":"' || i.anchor || '"}}' AS value FROM ({" UNION ALL ".join(f"SELECT * FROM item{d}" for d in range(1, DEPTH + 1))}) i JOIN entity e ON e.key = i.k WHERE e.entity_type = 'stateBody' AND i.place <= {MOST})
SELECT root, value FROM said""")
def expanded_signals(spark, sf_dir):
    """The signals of all that was expanded, their ids stitched too, each once (GR13)."""
    lines, signals = landing(spark, sf_dir)
    return expansion.expand(_seeds(spark, sf_dir), lines, signals, DEPTH, MOST).signals.select("root", "value")


_KINDS = ("corporate-entity-person-with-significant-control", "individual-person-with-significant-control", "legal-person-person-with-significant-control", "Corporate-Entity-beneficial-owner")
_PLACES = ("England", "united kingdom", "France", " Wales ", "GB")


@query(f"""WITH RECURSIVE {derived.SQL}, up AS (SELECT DISTINCT substr(subject_id, 2) AS number, substr(party_id, 2) AS next FROM relationship
  WHERE party_id IS NOT NULL AND status <> 'closed' AND key % 4 <> 1 AND key % 5 <> 2 AND CAST(substr(party_id, 2) AS BIGINT) % 13 <> 0),
walk(root, number, depth) AS (SELECT substr(statement_id, 2), substr(statement_id, 2), 0 FROM entity UNION SELECT w.root, u.next, w.depth + 1 FROM walk w JOIN up u ON u.number = w.number WHERE w.depth < 3),
least_ AS (SELECT root, number, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT lpad(l.root, 8, '0') AS root, lpad(l.number, 8, '0') AS number, CAST(l.depth AS INTEGER) AS depth, min(lpad(b.number, 8, '0')) AS via FROM least_ l JOIN least_ b ON b.root = l.root AND b.depth = l.depth - 1 JOIN up u ON u.number = b.number AND u.next = l.number WHERE l.depth > 0 GROUP BY ALL""")
def controlling_companies(spark, sf_dir):
    """Corporate controllers to depth three by kind, register and number (GR15)."""
    r, k = derived.relationships(spark, sf_dir).where("party_id IS NOT NULL"), F.col("key")
    number = lambda c: F.lpad(F.substring(c, 2, 20), 8, "0")
    owner = F.substring("party_id", 2, 20).cast("long")
    item = F.struct(F.element_at(F.array(*map(F.lit, _KINDS)), (k % 4 + 1).cast("int")).alias("kind"), F.when(F.col("status") == "closed", "2020-01-01").alias("ceased_on"), F.when(owner % 13 == 0, "12").otherwise(number("party_id")).alias("registration_number"), F.element_at(F.array(*map(F.lit, _PLACES)), (k % 5 + 1).cast("int")).alias("country"))
    filings = r.groupBy(number("subject_id").alias("number")).agg(F.collect_list(item).alias("items"))
    roots = derived.entities(spark, sf_dir).select(number("statement_id").alias("root"))
    return expansion.controlling_companies(filings, roots)
