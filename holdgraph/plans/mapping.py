"""Payload mappings over landing tables that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.operators import rollups
from holdgraph.operators import selection as L
from holdgraph.plans.registry import query
from holdgraph.sources import derived, loaders
from holdgraph.sources import registers as G

table = derived.table


def _landing(df, key, payload):
    return df.select(key.cast("string").alias("key"), F.try_parse_json(F.to_json(payload)).alias("payload"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer)
SELECT 'acra_singapore' AS source, 'U' || k AS number, CASE WHEN k % 4 = 0 THEN 'SG Entity U' || k ELSE c_name END AS name, 'registeredEntity' AS entity_type, '2001-02-0' || (k % 9 + 1) AS founded, 0 AS n_parties FROM c
UNION ALL SELECT 'krs_poland', 'K' || k, c_name, CASE k % 3 WHEN 0 THEN 'arrangement' WHEN 1 THEN 'stateBody' ELSE 'registeredEntity' END, NULL, 0 FROM c
UNION ALL SELECT 'cnpj_brazil', 'B' || k, c_name, 'registeredEntity', NULL, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END FROM c
UNION ALL SELECT 'firmenbuch', 'F' || k, c_name, 'registeredEntity', '1999-12-31', 2 FROM c""")
def mapped_registers(spark, sf_dir):
    """Companies of four registers with their parties, by specification (MP1-MP3, MP7)."""
    c = table(spark, sf_dir, "customer")
    k, s, name = F.col("c_custkey"), F.col("c_custkey").cast("string"), F.col("c_name")
    text = lambda prefix: F.concat(F.lit(prefix), s)
    partner = F.struct(name.alias("name"), F.lit("Sócio-Administrador").alias("role"), F.lit("person").alias("kind"))
    raw = {
        "acra_singapore": F.struct(text("U").alias("uen"), F.when(k % 4 == 0, "").otherwise(name).alias("entity_name"), F.concat(F.lit("2001-02-0"), (k % 9 + 1).cast("string")).alias("uen_issue_date")),
        "krs_poland": F.struct(text("K").alias("pl_krs"), name.alias("name"), F.element_at(F.array(*map(F.lit, ("Fundacja X", "Agencja Y", "Spółka"))), (k % 3 + 1).cast("int")).alias("legal_form")),
        "cnpj_brazil": F.struct(text("B").alias("br_cnpj"), F.struct(name.alias("name")).alias("company"), F.array(partner, F.struct(F.when(k % 5 > 0, F.concat(name, F.lit(" SA"))).otherwise("").alias("name"), F.lit("Diretor").alias("role"), F.lit("entity").alias("kind"))).alias("partners")),
        "firmenbuch": F.struct(text("F").alias("fn"), F.struct(name.alias("name"), F.lit("31.12.1999").alias("founding_date"), F.array(F.struct(F.lit("A").alias("full_name"))).alias("officers"), F.array(F.struct(F.lit("B GmbH").alias("display_name"), F.lit(False).alias("is_person"))).alias("shareholders")).alias("extract")),
    }
    out = None
    for source, payload in raw.items():
        e, _, r = G.map_register(_landing(c, k, payload), G.REGISTERS[source])
        n = r.groupBy(F.col("subject_id").alias("statement_id")).agg(F.countDistinct("party_id").cast("int").alias("n"))
        one = e.where("size(identifiers) > 0").join(n, "statement_id", "left").select(F.lit(source).alias("source"), F.get("identifiers", F.lit(0))["id"].alias("number"), "name", "entity_type", F.col("founding_date").alias("founded"), F.coalesce("n", F.lit(0)).alias("n_parties"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH o AS (SELECT o_custkey, o_orderkey, ['director', 'secretary', 'llp-member'][o_orderkey % 3 + 1] AS role, o_orderstatus = 'F' AS gone, o_orderdate FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS bundle_id, count(*) AS n, min('Officer ' || o_orderkey) AS first_name, min(CASE WHEN o_orderkey % 2 = 0 THEN '1970-0' || (o_orderkey % 9 + 1) ELSE '1970' END) AS first_birth FROM o WHERE NOT gone AND role <> 'secretary' GROUP BY o_custkey""")
def managing_officers(spark, sf_dir):
    """Acting managing officials of company payloads (MP8)."""
    k = F.col("o_orderkey")
    born = F.struct(F.lit(1970).alias("year"), F.when(k % 2 == 0, k % 9 + 1).alias("month"))
    role = F.element_at(F.array(*map(F.lit, ("director", "secretary", "llp-member"))), (k % 3 + 1).cast("int"))
    officer = F.struct(F.concat(F.lit("Officer "), k.cast("string")).alias("name"), role.alias("officer_role"), born.alias("date_of_birth"), F.when(F.col("o_orderstatus") == "F", "2020-01-01").alias("resigned_on"))
    raw = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(officer).alias("items"))
    out = G.officers(_landing(raw, F.col("o_custkey"), F.struct(F.struct("items").alias("officers"))))
    return out.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"), F.min("birth_date").alias("first_birth"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS bundle_id, CASE o_orderkey % 3 WHEN 0 THEN 'boardMember' WHEN 1 THEN 'boardChair' ELSE 'otherInfluenceOrControl' END AS type, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_ended FROM orders GROUP BY 1, 2""")
def officer_appointments(spark, sf_dir):
    """One officer's appointments: offices by role, with their ends (MP10)."""
    k = F.col("o_orderkey")
    role = F.element_at(F.array(*map(F.lit, ("Director", "chairman", "secretary"))), (k % 3 + 1).cast("int"))
    one = F.struct(F.struct(k.cast("string").alias("company_number")).alias("appointed_to"), role.alias("officer_role"), F.when(F.col("o_orderstatus") == "F", "2020-01-01").alias("resigned_on"))
    raw = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(one).alias("items"))
    out = G.appointments(_landing(raw, F.col("o_custkey"), F.struct(F.col("o_custkey").alias("officer_id"), F.struct(F.lit("N").alias("name"), "items").alias("appointments"))))
    return out.groupBy("bundle_id", "type").agg(F.count(F.lit(1)).alias("n"), F.count("end_date").alias("n_ended"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, 'C' || (l_partkey % 50) AS child, l_linenumber % 2 AS two FROM lineitem), f AS (SELECT l_orderkey, child, min(l_linenumber) AS first FROM l GROUP BY 1, 2)
SELECT DISTINCT 'P' || l.l_orderkey AS party_id, child AS subject_id, unnest(CASE WHEN two = 1 THEN ['direct', 'ultimate'] ELSE ['ultimate'] END) AS relation FROM l JOIN f USING (l_orderkey, child) WHERE l_linenumber = first""")
def legal_subsidiaries(spark, sf_dir):
    """Children of a legal entity, a row a relation, the first row of a child counts (MP12)."""
    child = F.concat(F.lit("C"), (F.col("l_partkey") % 50).cast("string"))
    both = F.when(F.col("l_linenumber") % 2 == 1, F.array(F.lit("ultimate"), F.lit("direct"), F.lit("direct"))).otherwise(F.array(F.lit("ultimate")))
    row = F.struct("l_linenumber", F.struct(child.alias("id")).alias("record"), both.alias("relations"))
    raw = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("children"))
    return G.subsidiaries(_landing(raw, F.col("l_orderkey"), F.struct(F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("lei"), "children"))).select("party_id", "subject_id", "relation")


@query("""SELECT 'q' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'person' ELSE 'entity' END AS kind, p_name AS name, CASE WHEN p_brand <> p_name THEN p_brand END AS alias, CASE p_partkey % 2 WHEN 0 THEN 'GB' END AS jurisdiction, CASE WHEN p_partkey % 4 = 0 THEN 'L' || p_partkey END AS lei FROM part""")
def ftm_statements(spark, sf_dir):
    """Followed-money entities: first name, aliases, jurisdiction, identifiers (MP14)."""
    k = F.col("p_partkey")
    some = lambda when, value: F.when(when, F.array(value))
    props = F.struct(F.array("p_name", "p_brand").alias("name"), some(k % 2 == 0, F.lit("gb")).alias("jurisdiction"), some(k % 4 == 0, F.concat(F.lit("L"), k.cast("string"))).alias("leiCode"))
    raw = _landing(table(spark, sf_dir, "part"), k, F.struct(F.concat(F.lit("q"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "Person").otherwise("Company").alias("schema"), props.alias("properties")))
    return G.ftm_entities(raw).select("id", "kind", "name", F.get("aliases", F.lit(0)).alias("alias"), "jurisdiction", F.get("identifiers", F.lit(0))["id"].alias("lei"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'T' || p_partkey WHEN p_partkey % 4 = 1 THEN 'N' || p_partkey WHEN p_partkey % 4 = 2 THEN 'D' || p_partkey END AS lei FROM part""")
def nested_identifiers(spark, sf_dir):
    """The identifier of a nested record, wherever it stands (SC17)."""
    k = F.col("p_partkey")
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    feature = F.struct(F.when(k % 4 < 2, F.element_at(F.array(F.lit("LEI"), F.lit("bq_lei")), (k % 2 + 1).cast("int"))).otherwise("DUNS").alias("OTHER_ID_TYPE"), text("N").alias("OTHER_ID_NUMBER"), F.when(k % 4 == 2, text("D")).alias("LEI"))
    raw = _landing(table(spark, sf_dir, "part"), k, F.struct(F.when(k % 4 == 0, text("T")).alias("bq_lei"), F.array(F.struct(*(F.lit(None).cast("string").alias(c) for c in ("OTHER_ID_TYPE", "OTHER_ID_NUMBER", "LEI"))), feature).alias("FEATURES")))
    return raw.select(F.col("key").cast("long").alias("p_partkey"), G.nested_lei().alias("lei"))


_CLASSES = ("Q5", "Q7275", "Q157031", "Q7188", "Q1", "Q8436", "Q193076")


@query(f"""WITH o AS (SELECT p_partkey, ['{"', '".join(_CLASSES)}'][p_partkey % 7 + 1] AS c, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' Stiftung' WHEN p_partkey % 13 = 0 THEN p_name || ' trust' ELSE p_name END AS n, ['IA', 'IN', NULL][p_partkey % 3 + 1] AS code FROM part),
k AS (SELECT *, CASE c WHEN 'Q8436' THEN 'family' WHEN 'Q5' THEN 'person' WHEN 'Q7188' THEN 'statebody' WHEN 'Q7275' THEN 'state' ELSE CASE WHEN c = 'Q157031' OR contains(lower(n), 'stiftung') OR contains(lower(n), 'foundation') THEN 'foundation' WHEN c = 'Q193076' OR contains(lower(n), ' trust') THEN 'arrangement' ELSE 'company' END END AS owner FROM o)
SELECT p_partkey, owner, CASE owner WHEN 'person' THEN 'person' WHEN 'family' THEN NULL ELSE 'entity' END AS kind, CASE owner WHEN 'person' THEN NULL WHEN 'family' THEN NULL WHEN 'arrangement' THEN 'arrangement' WHEN 'state' THEN 'state' WHEN 'statebody' THEN 'stateBody' ELSE 'registeredEntity' END AS entity_type,
  CASE WHEN code IS DISTINCT FROM 'IA' THEN true END AS benefits, CASE WHEN p_partkey % 2 = 0 THEN false WHEN p_partkey % 5 = 0 THEN true END AS asserted, CASE WHEN p_partkey % 3 = 0 THEN '2020-05-05' WHEN p_partkey % 3 = 1 THEN '2021-06-06' ELSE '2026-01-01' END AS dated FROM k""")
def owner_classes(spark, sf_dir):
    """What an owner is, whether a filing says it benefits, and when a statement was made (SF22, MP19, MP20, MP22, MP23)."""
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, F.concat("p_name", F.lit(" Stiftung"))).when(k % 13 == 0, F.concat("p_name", F.lit(" trust"))).otherwise(F.col("p_name"))
    owner = G.owner_class(F.array(F.element_at(F.array(*map(F.lit, _CLASSES)), (k % 7 + 1).cast("int"))), name)
    o = table(spark, sf_dir, "part").select(k, owner.alias("owner"))
    kind, entity_type = G.owner_statement(F.col("owner"))
    code = F.element_at(F.array(F.lit("IA"), F.lit("in"), F.lit(None)), (k % 3 + 1).cast("int"))
    asserted = G.asserted_benefit(F.when(k % 2 == 0, False), F.when(k % 5 == 0, "a").otherwise("b"), ("a",))
    dated = G.statement_date(F.when(k % 3 == 0, "2020-05-05"), F.when(k % 3 == 1, "2021-06-06T10:00:00Z"), F.lit("2026-01-01"))
    return o.select(k, "owner", kind.alias("kind"), entity_type.alias("entity_type"), G.benefits(code).alias("benefits"), asserted.alias("asserted"), dated.alias("dated"))


@query("""SELECT e.statement_id, s.name AS source_name, '2026-01-01' AS publication_date FROM (SELECT 'e' || c_custkey AS statement_id, c_nationkey AS n FROM customer) e JOIN (SELECT n_nationkey AS n, n_name AS name FROM nation) s USING (n)""")
def publication_blocks(spark, sf_dir):
    """Source and publication of statements (MP6)."""
    e = table(spark, sf_dir, "customer").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("statement_id"), F.col("c_nationkey").alias("source_id"))
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("source_name"))
    return G.with_sources(e, sources, F.lit("2026-01-01")).select("statement_id", "source_name", "publication_date")


@query("""WITH r AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'L' || (p_partkey % 90) END AS lei, p_name AS name, p_brand AS parent, p_partkey % 10 = 1 AS head FROM part),
f AS (SELECT head, lei, min_by(name, seq) AS name, min_by(parent, seq) AS parent FROM r WHERE lei <> '' GROUP BY head, lei),
n AS (SELECT parent, count(*) AS m, count(CASE WHEN lei <> '' THEN 1 END) AS w FROM r WHERE NOT head GROUP BY parent)
SELECT 'member' AS kind, lei, name, parent AS parent_name, NULL::BIGINT AS members, NULL::BIGINT AS members_with_lei FROM f WHERE NOT head UNION ALL SELECT 'head', lei, name, f.parent, coalesce(m, 0), coalesce(w, 0) FROM f LEFT JOIN n USING (parent) WHERE head""")
def group_registers(spark, sf_dir):
    """Members and heads of company groups (SC22)."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("seq"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("l"), (k % 90).cast("string"))).alias("lei"), F.col("p_name").alias("name"), F.col("p_brand").alias("parent_name"), (k % 10 == 1).alias("head"), F.lit("a; b").alias("alternative_names"))
    members, heads = loaders.group_register(rows)
    none = F.lit(None).cast("long")
    return members.select(F.lit("member").alias("kind"), "lei", "name", "parent_name", none.alias("members"), none.alias("members_with_lei")).unionByName(heads.select(F.lit("head").alias("kind"), "lei", "name", "parent_name", "members", "members_with_lei"))


@query("""SELECT parent, tracker, project, least(sum(share), 100.0) AS share FROM (SELECT DISTINCT 'coal' AS tracker, o_custkey AS parent, o_orderpriority AS project, CAST(o_orderkey % 40 AS DOUBLE) AS share FROM orders
UNION ALL SELECT DISTINCT 'steel', l_suppkey, l_returnflag, CAST(l_linenumber * 7 AS DOUBLE) FROM lineitem) GROUP BY parent, tracker, project""")
def stacked_projects(spark, sf_dir):
    """Sheets of several trackers stacked, shares of a project summed and capped (SC23, AG12)."""
    coal = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("Parent"), F.col("o_orderpriority").alias("Unit"), (F.col("o_orderkey") % 40).alias("Share (%)"))
    steel = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("Owner"), F.col("l_returnflag").alias("Project"), (F.col("l_linenumber") * 7).alias("Share"))
    rows = loaders.stacked_sheets({"coal": coal, "steel": steel}, {"parent": ("Parent", "Owner"), "project": ("Project", "Unit"), "share": ("Share", "Share (%)")})
    out = rollups.capped(rows.withColumn("share", F.col("share").cast("double")), ["parent", "sheet", "project"], "share")
    return out.select(F.col("parent").cast("long").alias("parent"), F.col("sheet").alias("tracker"), "project", "share")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 10 = 0")
def human_ids(spark, sf_dir):
    """Identifiers that stand for humans (PF16)."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    classes = c.select(k.alias("id"), F.explode(F.array(F.when(k % 6 == 0, "Q5").otherwise("Q6"), F.when(k % 10 == 0, "Q5").otherwise("Q7"))).alias("class"))
    return L.humans(c.select(k.alias("id")), classes)


@query("""WITH c AS (SELECT c_custkey AS k, c_name FROM customer)
SELECT CAST(k AS VARCHAR) AS bundle_id, list_sort([c_name, 'C' || (k + 1)])[1] || '|' || list_sort([c_name, 'C' || (k + 1)])[2] AS entities, CAST(1 + CAST(k % 2 = 0 AS INTEGER) AS BIGINT) AS n_persons, CAST(2 + CAST(k % 2 = 0 AS INTEGER) + CAST(k % 5 = 0 AS INTEGER) AS BIGINT) AS n_relationships,
  CAST(CAST(k % 4 = 0 AS INTEGER) AS BIGINT) AS n_closed, CAST(CAST(k % 5 = 0 AS INTEGER) AS BIGINT) AS n_unspecified, CAST(2 + CAST(k % 2 = 0 AS INTEGER) + CAST(k % 5 = 0 AS INTEGER) AS BIGINT) AS n_interests FROM c""")
def company_statements(spark, sf_dir):
    """Companies assembled from profile, controllers, filed statements, directors and related companies (MP7)."""
    k, text = F.col("c_custkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    number = lambda c: F.lpad(c.cast("string"), 8, "0")
    psc = lambda kind, name, natures, number, ceased: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.array(F.lit(natures)).alias("natures_of_control"), F.struct(number.alias("registration_number"), F.lit("England").alias("country_registered")).alias("identification"), ceased.alias("ceased_on"))
    none = F.lit(None).cast("string")
    items = F.array(psc("individual-person-with-significant-control", text("P", k), "voting-rights-25-to-50-percent", none, none), psc("corporate-entity-person-with-significant-control", text("C", k + 1), "ownership-of-shares-75-to-100-percent", number(k + 1), F.when(k % 4 == 0, "2020-01-01")))
    officers = F.when(k % 2 == 0, F.struct(F.array(F.struct(text("D", k).alias("name"), F.lit("director").alias("officer_role"))).alias("items")))
    filed = F.when(k % 5 == 0, F.struct(F.array(F.struct(F.lit("psc-details-not-confirmed").alias("statement"), F.lit("2019-01-01").alias("notified_on"))).alias("items")))
    related = F.when(k % 3 == 0, F.struct(F.struct(number(k + 1).alias("company_number"), F.struct(F.lit("other").alias("company_name")).alias("profile")).alias("x")))
    payload = F.struct(number(k).alias("company_number"), F.struct(F.col("c_name").alias("company_name")).alias("profile"), F.struct(items.alias("items")).alias("pscs"), officers.alias("officers"), filed.alias("psc_statements"), related.alias("related_companies"))
    e, p, r = G.company_statements(_landing(table(spark, sf_dir, "customer"), k, payload))
    names = e.groupBy("bundle_id").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("entities"))
    persons = p.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_persons"))
    links = r.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_relationships"), F.count(F.when(F.col("record_status") == "closed", 1)).alias("n_closed"), F.count("unspecified_reason").alias("n_unspecified"), F.sum(F.size("interests")).cast("long").alias("n_interests"))
    return names.join(persons, "bundle_id").join(links, "bundle_id")
