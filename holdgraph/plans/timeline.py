"""Change timelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.functions import codelists as C
from holdgraph.operators import timeline as T
from holdgraph.plans.registry import query
from holdgraph.sources import derived

_FIELDS = ("lei:Entity/lei:LegalName", "lei:Entity/lei:LegalForm/lei:EntityLegalFormCode", "lei:Entity/lei:EntityStatus", "lei:Entity/lei:LegalJurisdiction", "lei:Entity/lei:SuccessorEntity/lei:SuccessorLEI", "lei:Registration/lei:RegistrationStatus", "lei:Entity/lei:LegalAddress/lei:City", "lei:Entity/lei:LegalAddress/lei:Region", "lei:Entity/lei:Other")
_KINDS = ("INITIAL", "UPDATE", "INSERT", "DELETE")
_FORMS = ("B6ES", "H0PO", "8888", "ISSUED", "RETIRED", "lapsed")
_STATUSES = ("ISSUED", "merged", "B6ES", "H0PO")
_CATEGORIES = ("persons-with-significant-control", "change-of-name", "address", "accounts", "dissolution", "reregistration")
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_array = lambda xs: F.array(*map(F.lit, xs))
_pick = lambda xs, k: F.element_at(_array(xs), (k % len(xs) + 1).cast("int"))


@query(f"""WITH m AS (SELECT event_id, user_id, {_list(_FIELDS)}[event_id % 9 + 1] AS field, {_list(_KINDS)}[event_id // 9 % 4 + 1] AS kind, {_list(_FORMS)}[event_id // 5 % 6 + 1] AS old, {_list(_STATUSES)}[event_id // 7 % 4 + 1] AS new FROM events),
c AS (SELECT *, CASE WHEN kind = 'INITIAL' THEN NULL WHEN field = '{_FIELDS[0]}' THEN 'LEGAL_NAME_CHANGE' WHEN field = '{_FIELDS[1]}' AND ((old = 'B6ES' AND new = 'H0PO') OR (old = 'H0PO' AND new = 'B6ES')) THEN 'LEGAL_FORM_CHANGE'
  WHEN field = '{_FIELDS[2]}' THEN 'STATUS_CHANGED' WHEN field = '{_FIELDS[3]}' THEN 'JURISDICTION_CHANGE' WHEN starts_with(field, 'lei:Entity/lei:SuccessorEntity') THEN 'SUCCESSION' WHEN field = '{_FIELDS[5]}' AND upper(new) IN ('RETIRED', 'MERGED', 'ANNULLED', 'DUPLICATE') THEN 'REGISTRATION_RETIRED'
  WHEN contains(field, 'Address') AND NOT ends_with(field, '/lei:Region') THEN 'ADDRESS_CHANGE' END AS change_type FROM m)
SELECT user_id, change_type, CASE WHEN change_type IS NULL THEN 3 ELSE 2 END AS tier, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def entity_changes(spark, sf_dir):
    """Field modifications of entity records classified (TM1, TM12, SF33, SF34)."""
    k = F.col("event_id")
    m = derived.table(spark, sf_dir, "events").select("user_id", _pick(_FIELDS, k).alias("field"), _pick(_KINDS, F.floor(k / 9)).alias("kind"), _pick(_FORMS, F.floor(k / 5)).alias("old"), _pick(_STATUSES, F.floor(k / 7)).alias("new"))
    change = T.entity_change(F.col("field"), F.col("kind"), F.col("old"), F.col("new"))
    return m.withColumn("change_type", change).withColumn("tier", T.tier_of(F.col("change_type"))).groupBy("user_id", "change_type", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT event_id, ['rr:Relationship/rr:RelationshipType', 'rr:Relationship/rr:RelationshipStatus', 'rr:Relationship/rr:Other'][event_id % 3 + 1] AS field, {_list(_KINDS)}[event_id // 3 % 4 + 1] AS kind, ['INACTIVE', 'ACTIVE'][event_id // 12 % 2 + 1] AS new FROM events)
SELECT event_id, CASE WHEN field LIKE '%Type' AND kind IN ('INITIAL', 'INSERT') THEN 'OWNER_ADDED' WHEN (field LIKE '%Type' AND kind = 'DELETE') OR (field LIKE '%Status' AND new = 'INACTIVE') THEN 'OWNER_REMOVED' END AS change_type FROM m""")
def relationship_changes(spark, sf_dir):
    """Modifications of relationship records classified (TM2)."""
    k = F.col("event_id")
    field = _pick(("rr:Relationship/rr:RelationshipType", "rr:Relationship/rr:RelationshipStatus", "rr:Relationship/rr:Other"), k)
    return derived.table(spark, sf_dir, "events").select("event_id", T.relationship_change(field, _pick(_KINDS, F.floor(k / 3)), _pick(("INACTIVE", "ACTIVE"), F.floor(k / 12))).alias("change_type"))


@query(f"""WITH f AS (SELECT o_orderkey, {_list(_CATEGORIES)}[o_orderkey % 6 + 1] AS category, 'PSC0' || (o_orderkey // 6 % 10) AS code FROM orders)
SELECT o_orderkey, CASE WHEN category = 'persons-with-significant-control' THEN CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FILING_CODES.items())} ELSE 'CONTROL_NATURE_CHANGED' END
ELSE CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.FILING_CATEGORIES.items())} END END AS change_type FROM f""")
def filing_changes(spark, sf_dir):
    """Filings classified by code and category (TM9)."""
    k = F.col("o_orderkey")
    return derived.table(spark, sf_dir, "orders").select("o_orderkey", T.filing_change(_pick(_CATEGORIES, k), F.concat(F.lit("PSC0"), (F.floor(k / 6) % 10).cast("string"))).alias("change_type"))


@query("""SELECT user_id, event_id, event_type AS new, old FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS NOT NULL AND old <> event_type""")
def period_changes(spark, sf_dir):
    """Changes of value between dated rows; re-registrations of the same value are skipped (TM7)."""
    e = derived.table(spark, sf_dir, "events")
    return T.transitions(e, ["user_id"], "event_type", ["ts", "event_id"], True).select("user_id", "event_id", F.col("event_type").alias("new"), "old")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus AS new, old FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders) WHERE old IS NOT NULL""")
def state_transitions(spark, sf_dir):
    """Every consecutive pair of dated intervals (TM6, TM11)."""
    o = derived.table(spark, sf_dir, "orders")
    return T.transitions(o, ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"], False).select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("new"), "old")


@query("""WITH RECURSIVE d AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
fold AS (SELECT o_custkey, o_orderpriority, k, d AS anchor FROM d WHERE k = 1 UNION ALL SELECT d.o_custkey, d.o_orderpriority, d.k, CASE WHEN d.d - f.anchor <= 400 THEN f.anchor ELSE d.d END FROM fold f JOIN d ON d.o_custkey = f.o_custkey AND d.o_orderpriority = f.o_orderpriority AND d.k = f.k + 1)
SELECT o_custkey, o_orderpriority, CAST(anchor AS VARCHAR) AS anchor, CAST(count(*) AS INTEGER) AS n FROM fold GROUP BY o_custkey, o_orderpriority, anchor""")
def anchored_clusters(spark, sf_dir):
    """Events of a kind within 400 days of a cluster's first event (TM3)."""
    o = derived.table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return T.anchored_clusters(o, ["o_custkey", "o_orderpriority"], "day", 400).withColumn("anchor", F.col("anchor").cast("string"))


@query("""WITH i AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CASE WHEN bool_or(o_orderstatus = 'P') THEN NULL ELSE CAST(max(o_orderdate) AS DATE) END AS e FROM orders GROUP BY o_custkey)
SELECT o_custkey, 'OWNER_ADDED' AS change_type, CAST(s AS VARCHAR) AS event_date FROM i UNION ALL SELECT o_custkey, 'OWNER_REMOVED', CAST(e AS VARCHAR) FROM i WHERE e IS NOT NULL""")
def owner_intervals(spark, sf_dir):
    """Intervals as added and removed events, dates by min and max (TM5, TM8)."""
    i = derived.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).cast("string").alias("s"), F.when(F.max((F.col("o_orderstatus") == "P").cast("int")) == 0, F.max(F.to_date("o_orderdate")).cast("string")).alias("e"))
    return T.owner_intervals(i, ["o_custkey"], "s", "e")


@query("""WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS d, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS tier, value > 90 AS boosted FROM events)
SELECT user_id, event_id, CAST(d AS VARCHAR) AS event_date, CAST(tier AS INTEGER) AS tier, CAST(row_number() OVER (PARTITION BY user_id ORDER BY d NULLS LAST, tier, event_id) AS INTEGER) AS place FROM e WHERE tier <= 2 OR boosted""")
def history(spark, sf_dir):
    """Notable events of a subject in order, undated last (TM10, PF7, WN18)."""
    from pyspark.sql import Window

    tier = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    e = derived.table(spark, sf_dir, "events").select("user_id", "event_id", F.to_date("ts").alias("d"), tier.alias("tier"), (F.col("value") > 90).alias("boosted"))
    order = Window.partitionBy("user_id").orderBy(F.col("d").asc_nulls_last(), "tier", "event_id")
    return T.notable(e).select("user_id", "event_id", F.col("d").cast("string").alias("event_date"), "tier", F.row_number().over(order).alias("place"))


_ENTRY_EVENTS = """ev AS (SELECT o_custkey AS subject, o_orderkey AS event_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'LEGAL_NAME_CHANGE' WHEN '2-HIGH' THEN 'ADDRESS_CHANGE' WHEN '3-MEDIUM' THEN 'STATUS_CHANGED' WHEN '4-NOT SPECIFIED' THEN 'OWNER_ADDED' END AS change_type,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'relationship' ELSE 'entity' END AS record_type, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date,
  ['effective', 'recorded', 'snapshot_window'][o_orderkey % 3 + 1] AS date_basis, ['high', 'medium', 'low'][o_orderkey % 5 % 3 + 1] AS date_confidence, 's' || (o_orderkey % 4) AS source_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 2 + o_orderkey % 7 % 2 END AS tier, o_orderkey % 14 = 1 AS boosted,
  CASE WHEN o_orderkey % 6 = 0 THEN '20' || (10 + o_orderkey % 10) END AS interest_start, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'c' || (o_orderkey % 3) END AS counterparty FROM orders),
note AS (SELECT * FROM ev WHERE change_type IS NOT NULL AND (tier <= 2 OR boosted)),
d AS (SELECT *, row_number() OVER (PARTITION BY subject, change_type ORDER BY event_date, event_id) AS k FROM note WHERE record_type = 'entity' AND event_date IS NOT NULL),
fold(event_id, subject, change_type, k, anchor) AS (SELECT event_id, subject, change_type, k, event_date FROM d WHERE k = 1 UNION ALL SELECT d.event_id, d.subject, d.change_type, d.k, CASE WHEN d.event_date - f.anchor <= 400 THEN f.anchor ELSE d.event_date END FROM fold f JOIN d ON d.subject = f.subject AND d.change_type = f.change_type AND d.k = f.k + 1),
every AS (SELECT n.*, f.anchor, CASE WHEN f.anchor IS NULL THEN n.event_id END AS own FROM note n LEFT JOIN fold f ON f.event_id = n.event_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, change_type, record_type, anchor, own ORDER BY list_position(['effective', 'recorded', 'snapshot_window'], date_basis), list_position(['high', 'medium', 'low'], date_confidence), event_date NULLS LAST, event_id) AS r FROM every),
entry AS (SELECT subject, min_by(event_id, r) AS entry_id, change_type, record_type, min(event_date) FILTER (r = 1) AS event_date, min_by(date_basis, r) AS date_basis, min_by(tier, r) AS tier, bool_or(boosted) AS boosted, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS sources, count(*) - 1 AS n_corroborating,
  min_by(interest_start, r) FILTER (interest_start <> '') AS interest_start, min_by(counterparty, r) FILTER (counterparty <> '') AS counterparty, anchor, own FROM ranked GROUP BY subject, change_type, record_type, anchor, own)"""


def _entry_events(spark, sf_dir):
    k, urgency = F.col("o_orderkey"), F.col("o_orderpriority")
    pick = lambda names_, n: F.element_at(F.array(*map(F.lit, names_)), (n + 1).cast("int"))
    change = F.when(urgency == "1-URGENT", "LEGAL_NAME_CHANGE").when(urgency == "2-HIGH", "ADDRESS_CHANGE").when(urgency == "3-MEDIUM", "STATUS_CHANGED").when(urgency == "4-NOT SPECIFIED", "OWNER_ADDED")
    relation = urgency == "4-NOT SPECIFIED"
    return derived.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), k.alias("event_id"), change.alias("change_type"), F.when(relation, "relationship").otherwise("entity").alias("record_type"),
        F.when(k % 13 != 0, F.to_date("o_orderdate")).alias("event_date"), pick(T.BASES, k % 3).alias("date_basis"), pick(T.CONFIDENCES, k % 5 % 3).alias("date_confidence"),
        F.concat(F.lit("s"), (k % 4).cast("string")).alias("source_id"), F.when(relation, F.lit(1).cast("long")).otherwise(2 + k % 7 % 2).alias("tier"), (k % 14 == 1).alias("boosted"),
        F.when(k % 6 == 0, F.concat(F.lit("20"), (10 + k % 10).cast("string"))).alias("interest_start"), F.lit(None).cast("string").alias("interest_end"), F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("c"), (k % 3).cast("string"))).alias("counterparty"),
    )


@query(f"""WITH RECURSIVE {_ENTRY_EVENTS} SELECT subject, entry_id, change_type, record_type, CAST(event_date AS VARCHAR) AS event_date, date_basis, tier, boosted, sources, CAST(n_corroborating AS INTEGER) AS n_corroborating, interest_start, counterparty,
CAST(row_number() OVER (PARTITION BY subject ORDER BY event_date NULLS LAST, tier, entry_id) AS INTEGER) AS place FROM entry""")
def timeline_entries(spark, sf_dir):
    """Clusters of events with the event that counts, its sources and what corroborates it (TM3, TM4, TM10)."""
    entries, _ = T.entries(_entry_events(spark, sf_dir))
    return entries.drop("date_confidence", "interest_end").withColumns({"event_date": F.col("event_date").cast("string"), "sources": F.array_join("sources", ",")})


@query(f"""WITH RECURSIVE {_ENTRY_EVENTS} SELECT e.subject, e.event_id, n.entry_id FROM every e JOIN entry n ON n.subject = e.subject AND n.change_type = e.change_type AND n.record_type = e.record_type AND n.anchor IS NOT DISTINCT FROM e.anchor AND n.own IS NOT DISTINCT FROM e.own""")
def corroborating_events(spark, sf_dir):
    """Which entry every notable event belongs to (TM4)."""
    return T.entries(_entry_events(spark, sf_dir))[1]
