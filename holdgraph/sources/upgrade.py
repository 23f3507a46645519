"""Statements in the spelling of version 0.2 rewritten as version 0.4, references included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdgraph import schema
from holdgraph.functions import scalars as S

# Interest types of version 0.2 that have a name of their own in version 0.4.
INTERESTS = {
    "shareholding": "shareholding",
    "voting-rights": "votingRights",
    "votingRights": "votingRights",
    "appointment-of-board": "appointmentOfBoard",
    "appointmentOfBoard": "appointmentOfBoard",
    "senior-managing-official": "seniorManagingOfficial",
    "seniorManagingOfficial": "seniorManagingOfficial",
    "other-influence-or-control": "otherInfluenceOrControl",
    "otherInfluenceOrControl": "otherInfluenceOrControl",
    "influence-or-control": "otherInfluenceOrControl",
    "rights-to-surplus-assets-on-dissolution": "rightsToSurplusAssetsOnDissolution",
    "rights-to-profit-or-income": "rightsToProfitOrIncome",
    "rightsToProfitOrIncome": "rightsToProfitOrIncome",
    "unknownInterest": "unknownInterest",
}

_OLD_INTEREST = "struct<type:string,interestLevel:string,beneficialOwnershipOrControl:boolean,details:string,share:struct<exact:string>,startDate:string,endDate:string>"
_NAME = "struct<type:string,fullName:string,givenName:string,familyName:string>"


def _text(path: str) -> Column:
    return F.try_variant_get(F.col("raw"), path, "string")


def _array(path: str, of: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col("raw"), path, f"array<{of}>"), F.array().cast(f"array<{of}>"))


def _interest(i: Column) -> Column:
    kind = F.coalesce(i["type"], F.lit("unknownInterest"))
    known = F.create_map(*(F.lit(x) for kv in INTERESTS.items() for x in kv))
    share = F.try_cast(i["share"]["exact"], "double") if hasattr(F, "try_cast") else i["share"]["exact"].try_cast("double")
    to = F.try_element_at(known, kind)
    return F.struct(
        F.coalesce(to, F.lit("otherInfluenceOrControl")).alias("type"),
        F.when(i["interestLevel"].isin("direct", "indirect"), i["interestLevel"]).otherwise("unknown").alias("directOrIndirect"),
        F.coalesce(i["beneficialOwnershipOrControl"], F.lit(False)).alias("beneficialOwnershipOrControl"),
        F.coalesce(F.nullif(i["details"], F.lit("")), F.when(to.isNull(), F.concat(F.lit("interest type as filed: "), kind))).alias("details"),
        F.when((share > 0) & (share <= 100), F.struct(share.alias("exact"))).alias("share"),
        F.substring(i["startDate"], 1, 10).alias("startDate"),
        F.substring(i["endDate"], 1, 10).alias("endDate"),
    )


def upgraded(lines: DataFrame, source: str) -> DataFrame:
    """bundle_id, value of lines (bundle_id, value): statements of version 0.2 as version 0.4, with new ids that depend on
    source, kind and old id, in every reference too. Interest types get their new names (others become other
    influence or control, with the old one as a detail), birth dates are cut to the month, shares outside 0 to 100
    go, parties that the bundle doesn't hold become unspecified, and relationships whose subject it doesn't hold
    are left out, as are statements without an id and text that isn't JSON. Newer statements stay as they are."""
    read = lines.withColumn("raw", F.try_parse_json("value")).where("raw IS NOT NULL")
    kind = _text("$.statementType")
    old = read.where(kind.isin("entityStatement", "personStatement", "ownershipOrControlStatement") & (F.coalesce(_text("$.statementID"), F.lit("")) != ""))
    old = old.select("bundle_id", "raw", F.regexp_replace(kind, "Statement$", "").alias("kind"), _text("$.statementID").alias("old"))
    newer = read.where(_text("$.recordType").isNotNull()).select("bundle_id", "value")
    new_id = lambda kind, old: S.stable_id(F.lit(source), kind, old)
    ids = old.where("kind <> 'ownershipOrControl'").groupBy("bundle_id", "old").agg(F.max("kind").alias("_kind")).withColumn("new", new_id(F.col("_kind"), F.col("old")))
    date = F.substring(_text("$.statementDate"), 1, 10)
    common = lambda kind: [new_id(F.lit(kind), F.col("old")).alias("statementId"), new_id(F.lit(kind), F.col("old")).alias("recordId"), F.lit(kind).alias("recordType"), F.lit("new").alias("recordStatus"), date.alias("statementDate")]
    line = lambda df, kind, details: df.select("bundle_id", F.to_json(F.struct(*common(kind), details.alias("recordDetails"))).alias("value"))

    names = F.filter(F.concat(F.array(_text("$.name")), _array("$.alternateNames", "string")), lambda n: F.coalesce(n, F.lit("")) != "")
    identifiers = F.filter(F.transform(_array("$.identifiers", schema.IDENTIFIER), lambda i: F.struct(i["id"].alias("id"), i["scheme"].alias("scheme"))), lambda i: (F.coalesce(i["id"], F.lit("")) != "") & (F.coalesce(i["scheme"], F.lit("")) != ""))
    addresses = F.filter(_array("$.addresses", "struct<type:string,address:string,country:string>"), lambda a: F.coalesce(a["address"], F.lit("")) != "")
    country = F.coalesce(_text("$.incorporatedInJurisdiction.code"), _text("$.jurisdiction.code"))
    entity = F.struct(F.coalesce(F.get(names, F.lit(0)), F.col("old")).alias("name"), F.slice(names, 2, 1_000_000).alias("alternateNames"), F.struct(F.lit("registeredEntity").alias("type")).alias("entityType"), F.when(country.isNotNull(), F.struct(country.alias("code"))).alias("jurisdiction"), identifiers.alias("identifiers"), addresses.alias("addresses"))
    entities = line(old.where("kind = 'entity'"), "entity", entity)

    all_names = _array("$.names", _NAME)
    legal = F.coalesce(F.get(F.filter(all_names, lambda n: n["type"].isNull() | n["type"].isin("individual", "legal")), F.lit(0)), F.get(all_names, F.lit(0)))
    main = F.struct(F.lit("individual").alias("type"), F.coalesce(F.nullif(F.trim(legal["fullName"]), F.lit("")), F.col("old")).alias("fullName"))
    others = F.transform(F.filter(all_names, lambda n: (n["type"] == "transliteration") & (F.coalesce(n["fullName"], F.lit("")) != "")), lambda n: F.struct(n["type"].alias("type"), n["fullName"].alias("fullName")))
    nations = F.filter(F.transform(_array("$.nationalities", schema.COUNTRY), lambda n: F.struct(F.coalesce(n["code"], n["name"]).alias("code"))), lambda n: n["code"].isNotNull())
    person = F.struct(F.lit("knownPerson").alias("personType"), F.array_distinct(F.concat(F.array(main), others)).alias("names"), F.nullif(F.substring(F.trim(_text("$.birthDate")), 1, 7), F.lit("")).alias("birthDate"), nations.alias("nationalities"))
    persons = line(old.where("kind = 'person'"), "person", person)

    links = old.where("kind = 'ownershipOrControl'").withColumns({"_subject": _text("$.subject.describedByEntityStatement"), "_party": F.coalesce(_text("$.interestedParty.describedByPersonStatement"), _text("$.interestedParty.describedByEntityStatement"))})
    of = lambda c, to: ids.select("bundle_id", F.col("old").alias(c), F.col("new").alias(to))
    links = links.join(of("_subject", "subject"), ["bundle_id", "_subject"]).join(of("_party", "party"), ["bundle_id", "_party"], "left")
    reason = F.coalesce(_text("$.interestedParty.unspecified.reason"), F.lit("unknown"))
    described = F.coalesce(_text("$.interestedParty.unspecified.description"), F.when(_text("$.interestedParty.unspecified.reason").isNull(), "the party is not in the declaration"))
    party = F.when(F.col("party").isNotNull(), F.col("party").cast("variant")).otherwise(F.to_variant_object(F.struct(reason.alias("reason"), described.alias("description"))))
    interests = F.transform(_array("$.interests", _OLD_INTEREST), _interest)
    relationship = F.struct(F.col("subject"), party.alias("interestedParty"), interests.alias("interests"))
    return newer.unionByName(entities).unionByName(persons).unionByName(line(links, "relationship", relationship))
