"""Overlays, targets of screens, validation and search quality, over tables that are derived from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.operators import overlays, rollups
from holdgraph.plans.registry import query
from holdgraph.sources import derived, loaders, statements, validation


def _lei(k):
    return F.format_string("L%017d00", k)


def _pick(names, n):
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), head AS (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0), member AS (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0)
SELECT 'b' || c.k AS bundle_id, CASE WHEN h.k IS NOT NULL THEN 'head' ELSE 'subsidiary' END AS mode, coalesce(h.name, m.name) AS name,
  CASE WHEN c.k % 5 <> 0 THEN 'opencorporates=gb/' || c.k || CASE WHEN c.k % 4 = 0 THEN '!' ELSE '' END || ',' ELSE '' END || 'permid=p' || c.k AS identifiers
FROM c LEFT JOIN head h ON h.k = c.k LEFT JOIN member m ON m.k = c.k WHERE h.k IS NOT NULL OR m.k IS NOT NULL""")
def group_matches(spark, sf_dir):
    """Heads and subsidiaries of groups, with identifiers that the subject confirms (JN16)."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    known = F.create_map(F.lit("opencorporates"), F.when(k % 4 == 0, text(" GB/", k)).otherwise(text("us/", k)), F.lit("permid"), text("p", k))
    subjects = derived.table(spark, sf_dir, "customer").select(text("b", k).alias("bundle_id"), F.lower(_lei(k)).alias("lei"), known.alias("known"))
    ids = F.create_map(F.lit("permid"), text("p", s), F.lit("opencorporates"), F.when(s % 5 != 0, text("gb/", s)).otherwise(" "))
    register = derived.table(spark, sf_dir, "supplier").select(_lei(s).alias("lei"), F.col("s_name").alias("name"), F.lit("G").alias("parent_name"), ids.alias("identifiers"), s.alias("s"))
    found = overlays.group_matches(subjects, register.where("s % 3 = 0"), register.where("s % 2 = 0"))
    said = F.array_join(F.transform("identifiers", lambda i: F.concat(i["scheme"], F.lit("="), i["value"], F.when(i["confirmed"], "!").otherwise(""))), ",")
    return found.select("bundle_id", "mode", "name", said.alias("identifiers"))


_INDEX = "sec AS (SELECT p_size AS s, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'os-' || p_size END AS id, list_sort(list(DISTINCT 'IS' || p_partkey)) AS isins, list_sort(list(DISTINCT 'EU' || (p_partkey % 3))) AS regimes FROM part WHERE p_partkey % 4 = 0 GROUP BY p_size)"


def _index(spark, sf_dir):
    p = derived.table(spark, sf_dir, "part").where("p_partkey % 4 = 0")
    sets = lambda prefix, c: F.array_sort(F.collect_set(F.concat(F.lit(prefix), c.cast("string"))))
    k = F.col("p_partkey")
    return p.groupBy("p_size").agg(sets("IS", k).alias("isins"), sets("EU", k % 3).alias("regimes")).select(_lei(F.col("p_size").cast("long")).alias("lei"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("os-"), F.col("p_size").cast("string"))).alias("id"), "isins", "regimes")


@query(f"""WITH {_INDEX} SELECT 'b' || c_custkey AS bundle_id, 'SANCTIONED_SECURITY' AS code, 'high' AS confidence, coalesce(id, printf('L%017d00', s)) AS hit_id, CAST(len(isins) AS INTEGER) AS n_matches, array_to_string(regimes, ', ') AS detail, array_to_string(isins[1:5], ',') AS sample FROM customer JOIN sec ON s = c_custkey % 60""")
def security_signals(spark, sf_dir):
    """Signals of securities under sanctions (RK19, JN17)."""
    c = derived.table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), F.col("c_custkey").cast("string")).alias("bundle_id"), _lei(F.col("c_custkey") % 60).alias("lei"))
    return overlays.security_signals(c, _index(spark, sf_dir)).drop("kind").withColumn("sample", F.array_join("sample", ","))


@query(f"""WITH {_INDEX}, every AS (SELECT p_size AS s, 'IS' || p_partkey AS isin, false AS barred FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT s, unnest(isins), true FROM sec)
SELECT printf('L%017d00', s) AS lei, isin, any_value(p_name) AS name, bool_or(barred) AS sanctioned FROM every LEFT JOIN part ON 'IS' || p_partkey = isin AND p_partkey % 5 <> 0 GROUP BY ALL""")
def security_rows(spark, sf_dir):
    """A subject's securities with what is known of them (JN20)."""
    p, isin = derived.table(spark, sf_dir, "part"), F.concat(F.lit("is"), F.col("p_partkey").cast("string"))
    listed = p.where("p_partkey % 3 = 0").select(_lei(F.col("p_size").cast("long")).alias("lei"), isin.alias("isin"))
    details = p.where("p_partkey % 5 <> 0").select(isin.alias("isin"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return overlays.security_rows(listed, _index(spark, sf_dir), details).drop("kind")


@query(f"""WITH {derived.SQL}, t AS (SELECT statement_id, 'person' AS kind, name, CAST(substr(birth_date, 1, 4) AS INTEGER) AS birth_year, nationality FROM person WHERE person_type = 'knownPerson' UNION ALL SELECT statement_id, 'entity', name, NULL, '' FROM entity WHERE entity_type <> 'anonymousEntity')
SELECT *, length(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) >= 3 AS leaks FROM t""")
def screening_targets(spark, sf_dir):
    """Whom screens look up, and of them those that leak services are asked for (PF21, PF22)."""
    e, p, _ = derived.typed(spark, sf_dir)
    found = overlays.screening_targets(e, p.withColumn("nationalities", F.array("nationality")))
    asked = overlays.leak_targets(found).select("statement_id", F.lit(True).alias("leaks"))
    return found.join(asked, "statement_id", "left").select("statement_id", "kind", "name", "birth_year", F.array_join("countries", ",").alias("nationality"), F.coalesce("leaks", F.lit(False)).alias("leaks"))


@query("""WITH a AS (SELECT user_id AS q, event_id % 40 AS id, CAST(event_id % 12 + 1 AS INTEGER) AS place FROM events), x AS (SELECT c_custkey AS q, c_mktsegment AS category, c_custkey % 40 AS id FROM customer),
j AS (SELECT x.q, category, min(place) AS place FROM x LEFT JOIN a ON a.q = x.q AND a.id = x.id GROUP BY ALL)
SELECT coalesce(category, '') AS category, count(*) AS n, count(*) FILTER (place <= 1) AS hit_1, count(*) FILTER (place <= 5) AS hit_5 FROM j GROUP BY GROUPING SETS ((category), ())""")
def search_quality(spark, sf_dir):
    """How often search has the expected answer first and among the first five, by category (AG28)."""
    answers = derived.table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 40).alias("id"), (F.col("event_id") % 12 + 1).cast("int").alias("place"))
    expected = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("category"), (F.col("c_custkey") % 40).alias("id"))
    return rollups.search_quality(answers, expected)


def _flawed(spark, sf_dir):
    """Statements as published, of which some have faults."""
    e, p, r = derived.typed(spark, sf_dir)
    k = F.col("key")
    unless = lambda n, c: F.when(k % n != 0, c)
    line = lambda df, kind, details: df.select("bundle_id", F.to_json(F.struct(F.col("statement_id").alias("statementId"), unless(43, F.concat(F.lit("rec-"), "statement_id")).alias("recordId"), F.when(k % 97 == 0, "thing").otherwise(kind).alias("recordType"), unless(47, F.when(k % 19 == 0, "odd").otherwise("new")).alias("recordStatus"), details.alias("recordDetails"))).alias("value"))
    name = F.when(k % 31 == 0, "").when(k % 6 == 0, "Same Name").otherwise(F.col("name"))
    entity = F.struct(name.alias("name"), F.struct(F.when(k % 29 == 0, "company").otherwise(F.col("entity_type")).alias("type")).alias("entityType"))
    person = F.struct(F.when(k % 7 == 0, "human").otherwise(F.col("person_type")).alias("personType"), F.when(k % 11 != 0, F.array(F.struct(F.col("name").alias("fullName")))).alias("names"))
    party = F.when(F.col("party_id").isNull(), F.to_variant_object(F.struct("reason"))).when(k % 37 == 0, F.lit("lost").cast("variant")).when(k % 5 == 0, F.to_variant_object(F.struct(F.col("party_id").alias("describedByEntityStatement")))).when(k % 43 != 0, F.concat(F.lit("rec-"), "party_id").cast("variant")).otherwise(F.col("party_id").cast("variant"))
    subject = F.when(k % 41 != 0, F.col("subject_id"))
    interest = F.struct(F.when(k % 13 == 0, "golden").otherwise(F.col("type")).alias("type"))
    link = F.struct(subject.alias("subject"), party.alias("interestedParty"), F.array(interest).alias("interests"))
    return line(e, "entity", entity).unionByName(line(p, "person", person)).unionByName(line(r, "relationship", link))


_FLAWED = f"""{derived.SQL}, line AS (
  SELECT bundle_id, statement_id, key AS k, 'entity' AS as_, CASE WHEN key % 31 = 0 THEN '' WHEN key % 6 = 0 THEN 'Same Name' ELSE name END AS name, CASE WHEN key % 29 = 0 THEN 'company' ELSE entity_type END AS t, NULL AS subj, NULL AS party, false AS open FROM entity
  UNION ALL SELECT bundle_id, statement_id, key, 'person', CASE WHEN key % 11 <> 0 THEN name END, CASE WHEN key % 7 = 0 THEN 'human' ELSE person_type END, NULL, NULL, false FROM person
  UNION ALL SELECT bundle_id, statement_id, key, 'relationship', NULL, CASE WHEN key % 13 = 0 THEN 'golden' ELSE type END, CASE WHEN key % 41 <> 0 THEN subject_id END, CASE WHEN party_id IS NULL THEN NULL WHEN key % 37 = 0 THEN 'lost' WHEN key % 5 = 0 THEN party_id WHEN key % 43 <> 0 THEN 'rec-' || party_id ELSE party_id END, party_id IS NULL FROM relationship
), st AS (SELECT *, CASE WHEN k % 43 <> 0 THEN 'rec-' || statement_id END AS rec, CASE WHEN k % 97 = 0 THEN 'thing' ELSE as_ END AS kind, CASE WHEN k % 47 <> 0 THEN CASE WHEN k % 19 = 0 THEN 'odd' ELSE 'new' END END AS status FROM line),
ids AS (SELECT bundle_id, statement_id AS id FROM st UNION SELECT bundle_id, rec FROM st WHERE rec IS NOT NULL),
ref AS (SELECT bundle_id, statement_id, 'subject' AS side, subj AS ref FROM st WHERE kind = 'relationship' UNION ALL SELECT bundle_id, statement_id, 'interestedParty', party FROM st WHERE kind = 'relationship' AND NOT open),
lost AS (SELECT r.* FROM ref r WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.bundle_id = r.bundle_id AND i.id = r.ref))"""


_ISSUES = f"""SELECT bundle_id, statement_id, 'missing' AS check, 'recordId' AS detail FROM st WHERE rec IS NULL UNION ALL SELECT bundle_id, statement_id, 'missing', 'recordStatus' FROM st WHERE status IS NULL
UNION ALL SELECT bundle_id, statement_id, 'recordType', kind FROM st WHERE kind = 'thing' UNION ALL SELECT bundle_id, statement_id, 'recordStatus', coalesce(status, '') FROM st WHERE kind <> 'thing' AND coalesce(status, '') <> 'new'
UNION ALL SELECT bundle_id, statement_id, 'entityType', t FROM st WHERE kind = 'entity' AND t NOT IN {validation.ENTITY_TYPES} UNION ALL SELECT bundle_id, statement_id, 'entityName', '' FROM st WHERE kind = 'entity' AND name = ''
UNION ALL SELECT bundle_id, statement_id, 'personType', t FROM st WHERE kind = 'person' AND t NOT IN {validation.PERSON_TYPES} UNION ALL SELECT bundle_id, statement_id, 'personName', '' FROM st WHERE kind = 'person' AND name IS NULL
UNION ALL SELECT bundle_id, statement_id, 'interestType', t FROM st WHERE kind = 'relationship' AND t NOT IN {validation.INTEREST_TYPES} UNION ALL SELECT bundle_id, statement_id, side, coalesce(ref, '') FROM lost"""


@query(f"WITH {_FLAWED} {_ISSUES}")
def statement_issues(spark, sf_dir):
    """Shape checks of statements as published, all eight families (PF5, JN8)."""
    return validation.issues(statements.parsed(_flawed(spark, sf_dir)))


@query(f"""WITH {_FLAWED}, issue AS ({_ISSUES}) SELECT "check" AS issue, count(*) AS n FROM issue GROUP BY 1""")
def validation_issues(spark, sf_dir):
    """How many statements fail each check (PF5)."""
    return validation.issues(statements.parsed(_flawed(spark, sf_dir))).groupBy(F.col("check").alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FLAWED}, used AS (SELECT DISTINCT bundle_id, ref FROM ref WHERE ref IS NOT NULL),
idle AS (SELECT bundle_id, count(*) AS n FROM st s WHERE kind = 'entity' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.bundle_id = s.bundle_id AND u.ref IN (s.statement_id, s.rec)) GROUP BY 1),
again AS (SELECT bundle_id, count(*) AS n FROM (SELECT bundle_id, lower(name) FROM st WHERE kind = 'entity' AND name <> '' GROUP BY ALL HAVING count(DISTINCT statement_id) > 1) GROUP BY 1), gone AS (SELECT bundle_id, count(*) AS n FROM lost GROUP BY 1)
SELECT st.bundle_id, count(*) FILTER (kind = 'entity') AS n_entities, count(*) FILTER (kind = 'person') AS n_persons, count(*) FILTER (kind = 'relationship') AS n_relationships, coalesce(any_value(gone.n), 0) AS n_dangling, coalesce(any_value(idle.n), 0) AS n_unreferenced, coalesce(any_value(again.n), 0) AS n_repeated_names
FROM st LEFT JOIN gone USING (bundle_id) LEFT JOIN idle USING (bundle_id) LEFT JOIN again USING (bundle_id) GROUP BY 1""")
def bundle_connectivity(spark, sf_dir):
    """What hangs together in a bundle and what doesn't (AG30, AG31)."""
    return validation.connectivity(statements.parsed(_flawed(spark, sf_dir)))


@query("""WITH i AS (SELECT 'records/XI-LEI-' || c_custkey AS record, CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE 'EE-KMKR' END AS scheme, CAST(c_custkey % 700 AS VARCHAR) AS code FROM customer UNION ALL SELECT 'records/EE-' || s_suppkey, 'EE-ARIREGISTER', CAST(s_suppkey AS VARCHAR) FROM supplier)
SELECT DISTINCT g.record FROM i g JOIN i a ON a.code = g.code AND a.record <> g.record WHERE g.scheme LIKE 'EE-%' AND a.scheme LIKE 'EE-%' AND g.record LIKE 'records/XI-LEI-%' AND a.record NOT LIKE 'records/XI-LEI-%'""")
def registry_twins(spark, sf_dir):
    """Records under an LEI that share a register's code with a record of the register (JN4)."""
    k, s = F.col("c_custkey"), F.col("s_suppkey").cast("string")
    lei = derived.table(spark, sf_dir, "customer").select(F.concat(F.lit("records/XI-LEI-"), k.cast("string")).alias("record"), F.when(k % 4 == 0, "OTHER").otherwise("EE-KMKR").alias("scheme"), (k % 700).cast("string").alias("code"))
    own = derived.table(spark, sf_dir, "supplier").select(F.concat(F.lit("records/EE-"), s).alias("record"), F.lit("EE-ARIREGISTER").alias("scheme"), s.alias("code"))
    return loaders.registry_twins(lei.unionByName(own), ("EE-KMKR", "EE-ARIREGISTER"), "records/XI-LEI-")
