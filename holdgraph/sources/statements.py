"""Reading statements as published (JSON lines, two spellings of several fields) into the typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdgraph import schema


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """One statement a line, one file a bundle: bundle_id (the file's name), line, raw as a variant."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.jsonl?)?$", 1)
    return parsed(spark.read.text(path).select(name.alias("bundle_id"), "value"))


def parsed(lines: DataFrame) -> DataFrame:
    """bundle_id, raw (variant) of lines (bundle_id, value); blank lines and lines that aren't JSON are left out."""
    return lines.where(F.trim("value") != "").select("bundle_id", F.try_parse_json("value").alias("raw")).where("raw IS NOT NULL")


def _text(raw: str | Column, *paths: str) -> Column:
    """The first of several spellings that is there."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(*(F.try_variant_get(raw, p, "string") for p in paths))


def statement_kind(raw: str = "raw") -> Column:
    return F.coalesce(_text(raw, "$.recordType"), F.lower(F.regexp_replace(_text(raw, "$.statementType"), "(?i)statement$", "")))


def statement_id(raw: str = "raw") -> Column:
    return _text(raw, "$.statementId", "$.statement_id", "$.statementID")


def endpoint(raw: str, field: str) -> tuple[Column, Column, Column, Column]:
    """A polymorphic endpoint as id, kind, reason and description: a plain id, an id wrapped in
    describedBy...Statement, or an unspecified party."""
    base = f"$.recordDetails.{field}"
    kind_of = F.schema_of_variant(F.try_variant_get(F.col(raw), base, "variant"))
    plain = F.when(kind_of == "STRING", _text(raw, base))
    entity = _text(raw, f"{base}.describedByEntityStatement", f"{base}.describedByAnonymousEntityStatement")
    person = _text(raw, f"{base}.describedByPersonStatement")
    reason = _text(raw, f"{base}.reason", f"{base}.unspecifiedReason", f"{base}.unspecified.reason")
    description = _text(raw, f"{base}.description", f"{base}.unspecified.description")
    kind = F.when(entity.isNotNull(), "entity").when(person.isNotNull(), "person")
    return F.coalesce(plain, entity, person), kind, reason, description


def _common(raw: str = "raw") -> list[Column]:
    sid = statement_id(raw)
    return [F.col("bundle_id"), sid.alias("statement_id"), F.coalesce(_text(raw, "$.recordId"), sid).alias("record_id"), _text(raw, "$.recordStatus").alias("record_status"), _text(raw, "$.statementDate").alias("statement_date")]


def entities(statements: DataFrame) -> DataFrame:
    d = "$.recordDetails"
    country = _text("raw", f"{d}.jurisdiction.code", f"{d}.incorporatedInJurisdiction.code", "$.incorporatedInJurisdiction.code")
    identifiers = F.try_variant_get(F.col("raw"), f"{d}.identifiers", f"array<{schema.IDENTIFIER}>")
    # A legal form is a text or an object of texts, under any of these names; the entity's name is none of them.
    forms = [f"{d}.{f}" for f in ("legalForm", "legalFormLabel", "entitySubtype", "details", "entityType.subtype", "entityType.details")]
    parts = lambda f: F.coalesce(F.map_values(F.try_variant_get(F.col("raw"), f, "map<string,string>")), F.array(_text("raw", f)))
    form = F.filter(F.array_compact(F.concat(*map(parts, forms))), lambda f: f != "")
    return statements.where(statement_kind() == "entity").select(*_common(), _text("raw", f"{d}.name").alias("name"), F.coalesce(_text("raw", f"{d}.entityType.type"), _text("raw", f"{d}.entityType")).alias("entity_type"), form.alias("legal_form"), country.alias("jurisdiction"), _text("raw", f"{d}.foundingDate").alias("founding_date"), identifiers.alias("identifiers"))


def persons(statements: DataFrame) -> DataFrame:
    d = "$.recordDetails"
    names = F.try_variant_get(F.col("raw"), f"{d}.names", "array<struct<type:string,fullName:string,givenName:string,familyName:string>>")
    best = F.coalesce(F.get(F.filter(names, lambda n: n["type"] == "individual"), F.lit(0)), F.get(names, F.lit(0)))
    name = F.coalesce(best["fullName"], F.nullif(F.concat_ws(" ", best["givenName"], best["familyName"]), F.lit("")))
    nationalities = F.try_variant_get(F.col("raw"), f"{d}.nationalities", f"array<{schema.COUNTRY}>")
    identifiers = F.try_variant_get(F.col("raw"), f"{d}.identifiers", f"array<{schema.IDENTIFIER}>")
    said = F.concat_ws(" ", F.flatten(F.transform(names, lambda n: F.array(n["fullName"], n["givenName"], n["familyName"]))), _text("raw", f"{d}.details", f"{d}.publicationDetails"))
    return statements.where(statement_kind() == "person").select(*_common(), said.alias("words"), name.alias("name"), _text("raw", f"{d}.personType").alias("person_type"), _text("raw", f"{d}.birthDate").alias("birth_date"), nationalities.alias("nationalities"), identifiers.alias("identifiers"))


def relationships(statements: DataFrame) -> DataFrame:
    subject = endpoint("raw", "subject")[0]
    party, kind, reason, description = endpoint("raw", "interestedParty")
    interests = F.try_variant_get(F.col("raw"), "$.recordDetails.interests", f"array<{schema.INTEREST}>")
    return statements.where(statement_kind() == "relationship").select(*_common(), subject.alias("subject_id"), party.alias("party_id"), kind.alias("party_kind"), reason.alias("unspecified_reason"), description.alias("unspecified_description"), interests.alias("interests"))


def interest_rows(relationships: DataFrame) -> DataFrame:
    """One row an interest, one for a relationship without any: the grain that rules and exports read."""
    one = relationships.select("*", F.explode_outer("interests").alias("i")).drop("interests")
    share = F.coalesce(F.col("i.share.exact"), F.col("i.share.minimum"), F.col("i.share.exclusiveMinimum"))
    return one.select("bundle_id", "statement_id", "record_status", "subject_id", "party_id", "party_kind", F.col("unspecified_reason").alias("reason"), F.col("unspecified_description").alias("description"), F.col("i.type").alias("type"), F.col("i.details").alias("details"), share.alias("share"), F.col("i.startDate").alias("start_date"), F.col("i.endDate").alias("end_date"))


def typed(statements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, persons and interests of parsed statements, as the rules take them."""
    return entities(statements), persons(statements), interest_rows(relationships(statements))
