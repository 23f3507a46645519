"""Notices, files of mixed encodings and old statements, derived from orders, customers and the statement tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdgraph.lineage import shared_folder
from holdgraph.plans.registry import query
from holdgraph.sources import derived, notices, sniffed, statements, upgrade


def _notices(spark, sf_dir):
    """A notice for each order: its lines are lots, tendered for by their suppliers."""
    el = lambda tag, *inner: F.concat(F.lit(f"<{tag}>"), *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in inner), F.lit(f"</{tag.split()[0]}>"))
    n, s = F.col("n"), F.col("l_suppkey")
    num = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    org = el("efac:Organization", el("efac:Company", el("cac:PartyIdentification", el("cbc:ID", "ORG-", s)), el("cac:PartyLegalEntity", el("cbc:CompanyID", F.when(s % 2 == 0, num("sup ", s)).otherwise(num("SUP-", s))))))
    party = el("efac:TenderingParty", el("cbc:ID", "TPA-", n), el("efac:Tenderer", el("cbc:ID", "ORG-", s)))
    amount = F.concat(F.lit('<cbc:PayableAmount currencyID="EUR">'), F.col("l_quantity").cast("int").cast("string"), F.lit("</cbc:PayableAmount>"))
    tender = el("efac:LotTender", el("cbc:ID", "TEN-", n), el("cac:LegalMonetaryTotal", amount), el("efac:TenderingParty", el("cbc:ID", "TPA-", n)), el("efac:TenderLot", el("cbc:ID", "LOT-", n)))
    code = F.when(F.col("l_returnflag") == "R", "clos-nw").otherwise("selec-w")
    lot = F.when(n % 2 == 1, el("efac:TenderLot", el("cbc:ID", "L-", n))).otherwise("")
    result = el("efac:LotResult", el("cbc:TenderResultCode", code), el("efac:LotTender", el("cbc:ID", "TEN-", n)), el("efac:SettledContract", el("cbc:ID", "CON-", n)), lot)
    signed = F.when(F.col("l_linestatus") == "F", el("cbc:AwardDate", F.date_format("l_shipdate", "yyyy-MM-dd"), "+01:00")).otherwise("")
    contract = el("efac:SettledContract", el("cbc:ID", "CON-", n), signed, el("efac:ContractReference", el("cbc:ID", "REF-", s)))
    parts = F.array_sort(F.collect_list(F.struct(n.alias("n"), s.alias("s"), org.alias("org"), party.alias("party"), tender.alias("tender"), result.alias("result"), contract.alias("contract"))))
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = derived.table(spark, sf_dir, "lineitem").withColumn("n", line).groupBy(F.col("l_orderkey").alias("notice_id")).agg(parts.alias("p"))
    all_ = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    head = '<ContractAwardNotice xmlns:ext="urn:e" xmlns:efac="urn:a" xmlns:cac="urn:b" xmlns:cbc="urn:c" xmlns:efext="urn:d">'
    body = el("ext:UBLExtensions", el("ext:UBLExtension", el("ext:ExtensionContent", el("efext:EformsExtension", el("efac:NoticeResult", all_("result"), all_("tender"), all_("contract"), all_("party")), el("efac:Organizations", all_("org"))))))
    return lines.select("notice_id", F.concat(F.lit(head), body, F.lit("</ContractAwardNotice>")).alias("xml"))


@query("""WITH l AS (SELECT l_orderkey AS notice_id, l_suppkey AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, CAST(floor(l_quantity) AS INTEGER) AS amount, l_returnflag <> 'R' AS won, CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS signed FROM lineitem)
SELECT notice_id, target AS target_id, CASE WHEN bool_or(won) THEN 'won' ELSE 'tendered' END AS role, count(*) FILTER (won) AS n_lots, CAST(coalesce(sum(amount) FILTER (won), 0) AS BIGINT) AS total, count(signed) FILTER (won) AS n_dates, coalesce(min(signed) FILTER (won), '') AS first_date, count(*) FILTER (won) AS n_references
FROM l WHERE target % 5 = 0 GROUP BY ALL""")
def notice_winners(spark, sf_dir):
    """Who won what in procurement notices, through the notices' chains of references (SC32)."""
    targets = derived.table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("target_id"), F.concat(F.lit("Sup."), F.col("s_suppkey").cast("string")).alias("company_id"))
    won = notices.winners(_notices(spark, sf_dir), targets)
    total = F.aggregate("values", F.lit(0).cast("long"), lambda t, v: t + v["amount"].cast("long"))
    return won.select("notice_id", "target_id", "role", F.size("lots").cast("long").alias("n_lots"), total.alias("total"), F.size("award_dates").cast("long").alias("n_dates"), F.coalesce(F.array_min("award_dates"), F.lit("")).alias("first_date"), F.size("contract_references").cast("long").alias("n_references"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS reg_no, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'Ελλάς; ' || c_name ELSE 'Café "' || c_mktsegment || '", ' || c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer""")
def sniffed_files(spark, sf_dir):
    """Files of three delimiters and encodings in one folder, written from customers and read back (SC19)."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.concat(F.lit("Ελλάς; "), "c_name")).otherwise(F.concat(F.lit('Café "'), "c_mktsegment", F.lit('", '), "c_name"))
    rows = derived.table(spark, sf_dir, "customer").withColumn("name", name)
    for n, (columns, sep, encoding) in enumerate(((("Reg_No", "Name"), ";", "UTF-8"), (("registration number", "Organisation_Name", "segment"), "\t", "UTF-8"), (("REG_NO", "name", "Segment"), ",", "UTF-16"))):
        part = rows.where(k % 3 == n).select(k.alias(columns[0]), F.col("name").alias(columns[1]), *(F.col("c_mktsegment").alias(c) for c in columns[2:]))
        part.write.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"').csv(f"{path}/{n}")
    read = sniffed.read_sniffed(spark, path)
    return read.select(sniffed.cell(("reg_no", "registration number")).alias("reg_no"), sniffed.cell(("name", "organisation_name")).alias("name"), sniffed.cell(("segment",)).alias("segment"))


_OLD_TYPES = ("shareholding", "voting-rights", "appointment-of-board", "golden-share")


def _old_lines(spark, sf_dir):
    """The derived statements in the old spelling."""
    e, p, r = derived.typed(spark, sf_dir)
    line = lambda df, kind, *fields: df.select("bundle_id", F.to_json(F.struct(F.col("statement_id").alias("statementID"), F.lit(kind).alias("statementType"), *fields)).alias("value"))
    k = F.col("key")
    entities = line(e, "entityStatement", "name", F.struct(F.col("jurisdiction").alias("code")).alias("incorporatedInJurisdiction"))
    persons = line(p, "personStatement", F.array(F.struct(F.col("words").alias("fullName"))).alias("names"), F.concat("birth_date", F.lit("-03-04")).alias("birthDate"))
    kind = F.element_at(F.array(*map(F.lit, _OLD_TYPES)), (k % 4 + 1).cast("int"))
    interest = F.struct(kind.alias("type"), F.when(k % 2 == 0, "direct").alias("interestLevel"), F.struct((k % 130).cast("string").alias("exact")).alias("share"))
    lost = F.when(k % 31 == 0, F.concat("party_id", F.lit("x"))).otherwise(F.col("party_id"))
    party = F.when(F.col("party_id").isNull(), F.to_variant_object(F.struct(F.struct("reason").alias("unspecified")))).otherwise(F.to_variant_object(F.struct(lost.alias("describedByEntityStatement"))))
    links = line(r, "ownershipOrControlStatement", F.struct(F.when(k % 37 == 0, "nowhere").otherwise(F.col("subject_id")).alias("describedByEntityStatement")).alias("subject"), party.alias("interestedParty"), F.array(interest).alias("interests"))
    return entities.unionByName(persons).unionByName(links)


_ID = lambda kind, c: f"'hg-' || substr(sha256('old|{kind}|' || {c}), 1, 24)"


@query(f"""WITH {derived.SQL}, link AS (SELECT *, CASE WHEN key % 31 <> 0 THEN party_id END AS party FROM relationship WHERE key % 37 <> 0)
SELECT bundle_id, {_ID('entity', 'statement_id')} AS statement_id, 'entity' AS kind, name AS what, jurisdiction AS detail, NULL AS share FROM entity
UNION ALL SELECT bundle_id, {_ID('person', 'statement_id')}, 'person', words, birth_date || '-03', NULL FROM person
UNION ALL SELECT bundle_id, {_ID('ownershipOrControl', 'statement_id').replace('ownershipOrControl', 'relationship')}, 'relationship', {_ID('entity', 'subject_id')} || ' ' || coalesce({_ID('entity', 'party')}, CASE WHEN party_id IS NULL THEN reason ELSE 'unknown' END),
  ['shareholding', 'votingRights', 'appointmentOfBoard', 'otherInfluenceOrControl: interest type as filed: golden-share'][key % 4 + 1], CASE WHEN key % 130 BETWEEN 1 AND 100 THEN CAST(key % 130 AS DOUBLE) END FROM link""")
def upgraded_statements(spark, sf_dir):
    """Statements of the old spelling, upgraded and read as the newer ones are (MP18)."""
    parsed = statements.parsed(upgrade.upgraded(_old_lines(spark, sf_dir), "old"))
    e, p, i = statements.typed(parsed)
    none = F.lit(None).cast("double").alias("share")
    entities = e.select("bundle_id", "statement_id", F.lit("entity").alias("kind"), F.col("name").alias("what"), F.col("jurisdiction").alias("detail"), none)
    persons = p.select("bundle_id", "statement_id", F.lit("person").alias("kind"), F.col("name").alias("what"), F.col("birth_date").alias("detail"), none)
    links = i.select("bundle_id", "statement_id", F.lit("relationship").alias("kind"), F.concat_ws(" ", "subject_id", F.coalesce("party_id", "reason")).alias("what"), F.concat_ws(": ", "type", "details").alias("detail"), "share")
    return entities.unionByName(persons).unionByName(links)
