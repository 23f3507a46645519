"""Registers of groups and of securities laid over subjects, and whom the screens look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdgraph.functions import scalars as S

# A register's identifier schemes in order, and those that a subject's own can confirm.
GROUP_SCHEMES, CONFIRMABLE = ("opencorporates", "permid", "capiq"), ("opencorporates", "capiq")
#: Securities that a signal names as examples.
SAMPLE = 5


def _plain(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s", ""))


def group_matches(subjects: DataFrame, heads: DataFrame, members: DataFrame) -> DataFrame:
    """bundle_id, lei, mode ('head' or 'subsidiary'), name, parent_name, identifiers (scheme, value, confirmed) of
    subjects (bundle_id, lei, known: map of identifiers) that a register of groups has. heads and members: lei,
    name, parent_name, identifiers (map). A head counts before a member; an identifier is confirmed where the
    subject's own of that scheme is the same. Null LEIs match nothing."""
    key = F.upper(F.trim("lei"))
    one = lambda df, mode, place: df.select(key.alias("lei"), F.lit(mode).alias("mode"), F.lit(place).alias("_place"), "name", "parent_name", "identifiers")
    first = one(heads, "head", 0).unionByName(one(members, "subsidiary", 1)).where("lei <> ''").groupBy("lei").agg(F.min_by(F.struct("mode", "name", "parent_name", "identifiers"), F.struct("_place", "name")).alias("m"))
    both = subjects.select("bundle_id", key.alias("lei"), "known").join(first, "lei")
    value = lambda s: F.trim(F.try_element_at(F.col("m.identifiers"), F.lit(s)))
    confirmed = lambda s: F.coalesce(_plain(F.try_element_at(F.col("known"), F.lit(s))) == _plain(value(s)), F.lit(False)) if s in CONFIRMABLE else F.lit(False)
    each = F.array_compact(F.array(*(F.when(F.coalesce(value(s), F.lit("")) != "", F.struct(F.lit(s).alias("scheme"), value(s).alias("value"), confirmed(s).alias("confirmed"))) for s in GROUP_SCHEMES)))
    return both.select("bundle_id", "lei", F.col("m.mode").alias("mode"), F.col("m.name").alias("name"), F.col("m.parent_name").alias("parent_name"), each.alias("identifiers"))


def security_signals(subjects: DataFrame, index: DataFrame) -> DataFrame:
    """bundle_id, code, confidence, kind, hit_id, n_matches, detail (regimes), sample: one SANCTIONED_SECURITY signal for a
    subject (bundle_id, lei) with securities under sanctions. index: lei, id, regimes (array), isins (array). An
    entry without securities says nothing; an entry without an id is called by its LEI."""
    isins = F.filter("isins", lambda i: F.coalesce(i, F.lit("")) != "")
    held = index.select(F.upper(F.trim("lei")).alias("lei"), "id", "regimes", isins.alias("isins")).where("size(isins) > 0")
    found = subjects.select("bundle_id", F.upper(F.trim("lei")).alias("lei")).join(held, "lei")
    return found.select("bundle_id", F.lit("SANCTIONED_SECURITY").alias("code"), F.lit("high").alias("confidence"), F.lit("risk").alias("kind"), F.coalesce(F.nullif("id", F.lit("")), F.col("lei")).alias("hit_id"), F.size("isins").alias("n_matches"), F.array_join(F.coalesce("regimes", F.array().cast("array<string>")), ", ").alias("detail"), F.slice("isins", 1, SAMPLE).alias("sample"))


def security_rows(listed: DataFrame, index: DataFrame, details: DataFrame) -> DataFrame:
    """lei, isin, name, kind, sanctioned: a subject's securities (listed: lei, isin) and those under sanctions, each once, with
    what is known of them (details: isin, name, kind); without details a security keeps its number alone."""
    barred = index.select("lei", F.explode("isins").alias("isin"), F.lit(True).alias("sanctioned"))
    every = listed.select("lei", "isin", F.lit(False).alias("sanctioned")).unionByName(barred)
    every = every.select(F.upper(F.trim("lei")).alias("lei"), F.upper(F.trim("isin")).alias("isin"), "sanctioned").where("lei <> '' AND isin <> ''")
    one = every.groupBy("lei", "isin").agg(F.bool_or("sanctioned").alias("sanctioned"))
    known = details.select(F.upper(F.trim("isin")).alias("isin"), "name", "kind").groupBy("isin").agg(F.min(F.struct("name", "kind")).alias("d"))
    return one.join(known, "isin", "left").select("lei", "isin", F.col("d.name").alias("name"), F.col("d.kind").alias("kind"), "sanctioned")


def screening_targets(entities: DataFrame, persons: DataFrame) -> DataFrame:
    """statement_id, bundle_id, kind, name, birth_year, countries: whom a screen looks up. Persons that are known (or say
    nothing of it), entities that are not anonymous or unknown, each with a name. entities: bundle_id,
    statement_id, name, entity_type; persons: bundle_id, statement_id, name, person_type, birth_date,
    nationalities (array)."""
    year = F.regexp_extract(F.coalesce("birth_date", F.lit("")), r"^(\d{4})", 1).try_cast("int")
    people = persons.where("coalesce(person_type, '') IN ('', 'knownPerson')").select("statement_id", "bundle_id", F.lit("person").alias("kind"), F.trim("name").alias("name"), year.alias("birth_year"), F.coalesce("nationalities", F.array().cast("array<string>")).alias("countries"))
    firms = entities.where("coalesce(entity_type, '') NOT IN ('anonymousEntity', 'unknownEntity')").select("statement_id", "bundle_id", F.lit("entity").alias("kind"), F.trim("name").alias("name"), F.lit(None).cast("int").alias("birth_year"), F.array().cast("array<string>").alias("countries"))
    return people.unionByName(firms).where("coalesce(name, '') <> '' AND coalesce(statement_id, '') <> ''")


def leak_targets(targets: DataFrame) -> DataFrame:
    """Of screening targets those whose names are long enough to ask a leak service for."""
    return targets.where(S.screenable(F.col("name"))).select("statement_id", "bundle_id", "kind", "name")
