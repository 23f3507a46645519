"""The statement tables that Spark derives from the driver's star schema, and the same in SQL.

A customer is an entity; it belongs to one of 50 bundles, in which every entity but the first is owned by
the one at a third of its place, some by a second one, and some own one above them. Suppliers are persons and own customers. Facts such as types, legal forms,
dates and reasons are arithmetic on keys, so they grow with the tables and need no further input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Country codes that stand for the nations 0 to 24, in order.
COUNTRIES = ("GB", "DE", "FR", "IR", "KP", "MM", "VG", "KE", "VN", "US", "CH", "NO", "PL", "BG", "DZ", "NA", "LB", "SY", "EE", "LV", "CZ", "IE", "NL", "SG", "BR")
BUNDLES = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _country(nation: str):
    return F.element_at(F.array(*map(F.lit, COUNTRIES)), F.col(nation) + 1)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_id, statement_id, key, place, name, jurisdiction, entity_type, legal_form, founding_date."""
    k = F.col("c_custkey")
    year = (1950 + k % 70).cast("string")
    kind = F.when(k % 23 == 0, "stateBody").when(k % 19 == 0, "arrangement").when(k % 29 == 0, "anonymousEntity").otherwise("registeredEntity")
    form = F.concat(F.lower("c_mktsegment"), F.when(k % 31 == 0, " family trust").when(k % 37 == 0, " stiftung").otherwise(" limited"))
    founded = F.when(k % 3 == 0, year).when(k % 3 == 1, F.concat(year, F.lit("-0"), (1 + k % 9).cast("string"))).otherwise(F.concat(year, F.lit("-05-1"), (k % 10).cast("string")))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("b"), (k % BUNDLES).cast("string")).alias("bundle_id"),
        F.concat(F.lit("e"), k.cast("string")).alias("statement_id"),
        k.alias("key"),
        F.floor(k / BUNDLES).alias("place"),
        F.col("c_name").alias("name"),
        _country("c_nationkey").alias("jurisdiction"),
        kind.alias("entity_type"),
        form.alias("legal_form"),
        founded.alias("founding_date"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_id, statement_id, subject_id, party_id (null where unspecified), reason, type, share, details,
    status, key: who owns whom among entities. Some entities have a second owner, and some own an entity
    above themselves, so there are diamonds and cycles."""
    e = entities(spark, sf_dir).where("place > 0")
    k, place = F.col("key"), F.col("place")
    unspecified = k % 53 == 0
    at = lambda p: F.concat(F.lit("e"), (p * BUNDLES + k % BUNDLES).cast("string"))
    kinds = F.array(*map(F.lit, ("shareholding", "votingRights", "appointmentOfBoard", "boardMember")))
    nothing = F.lit(None).cast("string")
    row = lambda sid, subject, party, reason, kind, share, details, status: F.struct(F.concat(F.lit(sid), k.cast("string")).alias("statement_id"), subject.alias("subject_id"), party.alias("party_id"), reason.alias("reason"), kind.alias("type"), share.cast("double").alias("share"), details.alias("details"), status.alias("status"))
    first = row("r", F.col("statement_id"), F.when(~unspecified, at(F.floor(place / 3))), F.when(unspecified, "interestedPartyHasNotProvidedInformation"), F.element_at(kinds, (k % 4 + 1).cast("int")), k * 7 % 100, F.when(k % 41 == 0, "held by Nominee Services").otherwise(F.col("segment")), F.when(k % 47 == 0, "closed").otherwise("new"))
    second = F.when((k % 11 == 0) & (place >= 4), row("s", F.col("statement_id"), at(F.floor(place / 2)), nothing, F.lit("shareholding"), F.lit(10), F.col("segment"), F.lit("new")))
    back = F.when((k % 83 == 0) & (place >= 9), row("b", at(F.floor(place / 9)), F.col("statement_id"), nothing, F.lit("votingRights"), F.lit(5), F.col("segment"), F.lit("new")))
    return e.select("bundle_id", "key", F.inline(F.array_compact(F.array(first, second, back))))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statement_id, key, name, nationality, birth_date, the entity that the person owns and its bundle;
    person_type and words as the rules take them."""
    k = F.col("s_suppkey")
    words = F.concat("s_name", F.when(k % 59 == 0, " Nominee Director").otherwise(""))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), k.cast("string")).alias("statement_id"), k.alias("key"), F.col("s_name").alias("name"), _country("s_nationkey").alias("nationality"), (1940 + k % 60).cast("string").alias("birth_date"), F.concat(F.lit("e"), (k * 3).cast("string")).alias("subject_id"), F.concat(F.lit("b"), (k * 3 % BUNDLES).cast("string")).alias("bundle_id"), F.when(k % 71 == 0, "anonymousPerson").otherwise("knownPerson").alias("person_type"), words.alias("words"))


def typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, persons and interests as the rules take them."""
    e = entities(spark, sf_dir).withColumn("legal_form", F.array("legal_form"))
    r = relationships(spark, sf_dir).withColumns({"party_kind": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    return e, persons(spark, sf_dir), r


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bundle_id, value: the same statements as published, a JSON object a line."""
    e, p, r = typed(spark, sf_dir)
    line = lambda df, kind, details: df.select("bundle_id", F.to_json(F.struct(F.col("statement_id").alias("statementId"), F.lit(kind).alias("recordType"), details.alias("recordDetails"))).alias("value"))
    entity = F.struct("name", F.struct(F.col("entity_type").alias("type")).alias("entityType"), F.struct(F.col("jurisdiction").alias("code")).alias("jurisdiction"), F.get("legal_form", F.lit(0)).alias("legalForm"), F.col("founding_date").alias("foundingDate"))
    person = F.struct(F.col("person_type").alias("personType"), F.array(F.struct(F.lit("individual").alias("type"), F.col("words").alias("fullName"))).alias("names"))
    party = F.when(F.col("party_id").isNull(), F.to_variant_object(F.struct("reason"))).otherwise(F.col("party_id").cast("variant"))
    interest = F.struct("type", "details", F.struct(F.col("share").alias("exact")).alias("share"))
    link = F.struct(F.col("subject_id").alias("subject"), party.alias("interestedParty"), F.array(interest).alias("interests"))
    return line(e, "entity", entity).unionByName(line(p, "person", person)).unionByName(line(r, "relationship", link))


_LIST = ", ".join(f"'{c}'" for c in COUNTRIES)

#: The same tables as common table expressions: entity, relationship, person.
SQL = f"""entity AS (
  SELECT 'b' || (c_custkey % {BUNDLES}) AS bundle_id, 'e' || c_custkey AS statement_id, c_custkey AS key, c_custkey // {BUNDLES} AS place, c_name AS name,
    [{_LIST}][c_nationkey + 1] AS jurisdiction,
    CASE WHEN c_custkey % 23 = 0 THEN 'stateBody' WHEN c_custkey % 19 = 0 THEN 'arrangement' WHEN c_custkey % 29 = 0 THEN 'anonymousEntity' ELSE 'registeredEntity' END AS entity_type,
    lower(c_mktsegment) || CASE WHEN c_custkey % 31 = 0 THEN ' family trust' WHEN c_custkey % 37 = 0 THEN ' stiftung' ELSE ' limited' END AS legal_form,
    CASE c_custkey % 3 WHEN 0 THEN CAST(1950 + c_custkey % 70 AS VARCHAR) WHEN 1 THEN (1950 + c_custkey % 70) || '-0' || (1 + c_custkey % 9) ELSE (1950 + c_custkey % 70) || '-05-1' || (c_custkey % 10) END AS founding_date,
    c_mktsegment AS segment, c_acctbal AS balance
  FROM customer
), relationship AS (
  SELECT bundle_id, 'r' || key AS statement_id, statement_id AS subject_id,
    CASE WHEN key % 53 <> 0 THEN 'e' || (place // 3 * {BUNDLES} + key % {BUNDLES}) END AS party_id,
    CASE WHEN key % 53 = 0 THEN 'interestedPartyHasNotProvidedInformation' END AS reason,
    ['shareholding', 'votingRights', 'appointmentOfBoard', 'boardMember'][key % 4 + 1] AS type,
    CAST(key * 7 % 100 AS DOUBLE) AS share,
    CASE WHEN key % 41 = 0 THEN 'held by Nominee Services' ELSE segment END AS details,
    CASE WHEN key % 47 = 0 THEN 'closed' ELSE 'new' END AS status, key
  FROM entity WHERE place > 0
  UNION ALL SELECT bundle_id, 's' || key, statement_id, 'e' || (place // 2 * {BUNDLES} + key % {BUNDLES}), NULL, 'shareholding', 10.0, segment, 'new', key FROM entity WHERE key % 11 = 0 AND place >= 4
  UNION ALL SELECT bundle_id, 'b' || key, 'e' || (place // 9 * {BUNDLES} + key % {BUNDLES}), statement_id, NULL, 'votingRights', 5.0, segment, 'new', key FROM entity WHERE key % 83 = 0 AND place >= 9
), person AS (
  SELECT 'p' || s_suppkey AS statement_id, s_suppkey AS key, s_name AS name, [{_LIST}][s_nationkey + 1] AS nationality, CAST(1940 + s_suppkey % 60 AS VARCHAR) AS birth_date, 'e' || (s_suppkey * 3) AS subject_id,
    'b' || (s_suppkey * 3 % {BUNDLES}) AS bundle_id, CASE WHEN s_suppkey % 71 = 0 THEN 'anonymousPerson' ELSE 'knownPerson' END AS person_type, s_name || CASE WHEN s_suppkey % 59 = 0 THEN ' Nominee Director' ELSE '' END AS words
  FROM supplier
)"""
