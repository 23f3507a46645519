"""Shape checks of parsed statements (bundle_id, raw), as rows: nothing fails, everything is told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdgraph.lineage import written

# What a statement must have, and the codes of version 0.4.
REQUIRED = ("statementId", "recordId", "recordType", "recordStatus", "recordDetails")
RECORD_TYPES = ("entity", "person", "relationship")
RECORD_STATUSES = ("new", "updated", "closed")
ENTITY_TYPES = ("registeredEntity", "legalEntity", "arrangement", "anonymousEntity", "unknownEntity", "state", "stateBody")
PERSON_TYPES = ("knownPerson", "anonymousPerson", "unknownPerson")
INTEREST_TYPES = (
    "shareholding", "votingRights", "appointmentOfBoard", "otherInfluenceOrControl", "seniorManagingOfficial", "settlor", "trustee", "protector",
    "beneficiaryOfLegalArrangement", "rightsToSurplusAssetsOnDissolution", "rightsToProfitOrIncome", "rightsGrantedByContract",
    "conditionalRightsGrantedByContract", "controlViaCompanyRulesOrArticles", "controlByLegalFramework", "boardMember", "boardChair", "unknownInterest",
    "unpublishedInterest", "enjoymentAndUseOfAssets", "rightToProfitOrIncomeFromAssets", "nominee", "nominator",
)


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("raw"), path, kind)


def _outside(value: Column, codes: tuple[str, ...]) -> Column:
    return ~F.coalesce(value.isin(*codes), F.lit(False))


def _references(read: DataFrame) -> DataFrame:
    """bundle_id, n, statement_id, side, ref: what relationships refer to; unspecified parties refer to nothing."""
    def side(field: str, *wrapped: str) -> Column:
        base = f"$.recordDetails.{field}"
        unspecified = _get(f"{base}.reason", "variant").isNotNull() | _get(f"{base}.unspecifiedReason", "variant").isNotNull()
        plain = F.when(F.schema_of_variant(F.coalesce(_get(base, "variant"), F.parse_json(F.lit("{}")))) == "STRING", _get(base))
        ref = F.coalesce(plain, *(_get(f"{base}.{w}") for w in wrapped))
        return F.when(~unspecified, F.struct(F.lit(field).alias("side"), ref.alias("ref")))

    both = F.array_compact(F.array(side("subject", "describedByEntityStatement"), side("interestedParty", "describedByPersonStatement", "describedByEntityStatement")))
    return read.where(F.col("kind") == "relationship").select("bundle_id", "n", "statement_id", F.inline(both))


def _read(statements: DataFrame) -> DataFrame:
    # A number for each statement, as ids may be missing; it is written, so that it stays the same.
    return written(statements.select("bundle_id", "raw", F.monotonically_increasing_id().alias("n"), _get("$.statementId").alias("statement_id"), _get("$.recordId").alias("record_id"), _get("$.recordType").alias("kind")), "statements")


def _ids(read: DataFrame) -> DataFrame:
    """bundle_id, id: what may be referred to, a statement's id or its record's."""
    return read.select("bundle_id", F.explode(F.array_compact(F.array(F.nullif("statement_id", F.lit("")), F.nullif("record_id", F.lit("")))))).toDF("bundle_id", "id").distinct()


def issues(statements: DataFrame) -> DataFrame:
    """bundle_id, statement_id, check, detail, of eight families: missing fields; record types, and for those that are
    known statuses, entity types and names, person types and names, references to statements that the bundle
    doesn't hold, and interest types. A statement may have many; one without any gives no row."""
    read = _read(statements)
    known = F.col("kind").isin(*RECORD_TYPES)
    said = lambda c: F.coalesce(c, F.lit(""))
    issue = lambda when, check, detail: F.when(when, F.struct(F.lit(check).alias("check"), detail.alias("detail")))
    missing = [issue(_get(f"$.{f}", "variant").isNull(), "missing", F.lit(f)) for f in REQUIRED]
    entity, person = F.col("kind") == "entity", F.col("kind") == "person"
    entity_type, person_type = _get("$.recordDetails.entityType.type"), _get("$.recordDetails.personType")
    types = F.coalesce(F.transform(_get("$.recordDetails.interests", "array<struct<type:string>>"), lambda i: i["type"]), F.array().cast("array<string>"))
    bad = F.filter(types, lambda t: _outside(t, INTEREST_TYPES))
    found = F.array_compact(F.array(
        *missing,
        issue(~F.coalesce(known, F.lit(False)), "recordType", said(F.col("kind"))),
        issue(known & _outside(_get("$.recordStatus"), RECORD_STATUSES), "recordStatus", said(_get("$.recordStatus"))),
        issue(entity & _outside(entity_type, ENTITY_TYPES), "entityType", said(entity_type)),
        issue(entity & (said(_get("$.recordDetails.name")) == ""), "entityName", F.lit("")),
        issue(person & _outside(person_type, PERSON_TYPES), "personType", said(person_type)),
        issue(person & (said(_get("$.recordDetails.names[0].fullName")) == ""), "personName", F.lit("")),
    ))
    interests = F.when(F.col("kind") == "relationship", F.transform(bad, lambda t: F.struct(F.lit("interestType").alias("check"), said(t).alias("detail"))))
    flat = read.select("bundle_id", "statement_id", F.inline(F.concat(found, F.coalesce(interests, F.array().cast("array<struct<check:string,detail:string>>")))))
    ref = _references(read)
    ids = _ids(read)
    lost = ref.join(ids.withColumnRenamed("id", "ref"), ["bundle_id", "ref"], "left_anti").select("bundle_id", "statement_id", F.col("side").alias("check"), said(F.col("ref")).alias("detail"))
    return flat.unionByName(lost)


def connectivity(statements: DataFrame) -> DataFrame:
    """bundle_id, n_entities, n_persons, n_relationships, n_dangling (references), n_unreferenced (entities that no
    relationship names, by statement or record), n_repeated_names (names that several entities have, whatever
    their case)."""
    read = _read(statements)
    ref = _references(read)
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k[:-1]}ies" if k == "entity" else f"n_{k}s")
    parts = [read.groupBy("bundle_id").agg(*map(count, RECORD_TYPES))]
    parts.append(ref.join(_ids(read).withColumnRenamed("id", "ref"), ["bundle_id", "ref"], "left_anti").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_dangling")))
    entities = read.where("kind = 'entity'").select("bundle_id", "n", "statement_id", "record_id", F.lower(F.trim(_get("$.recordDetails.name"))).alias("name"))
    used = ref.where("ref IS NOT NULL").select("bundle_id", "ref").distinct()
    named = entities.select("bundle_id", "n", F.explode(F.array("statement_id", "record_id")).alias("ref")).join(used, ["bundle_id", "ref"]).select("bundle_id", "n").distinct()
    parts.append(entities.join(named, ["bundle_id", "n"], "left_anti").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_unreferenced")))
    again = entities.where("coalesce(name, '') <> ''").groupBy("bundle_id", "name").agg(F.countDistinct("statement_id").alias("k")).where("k > 1")
    parts.append(again.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n_repeated_names")))
    out = reduce(lambda a, b: a.join(b, "bundle_id", "left"), parts)
    return out.na.fill(0)
