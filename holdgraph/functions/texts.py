"""Small functions on register texts: search questions, leak descriptions, licences, codes, pointers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What has a meaning in the query syntax of search services.
QUERY_SYNTAX = r'["\\/:^~\[\]{}()!*?<>=]|&&|\|\||(?<!\S)[-+]|[-+](?!\S)'
# Registration authorities of national numbers, by country.
AUTHORITIES = {
    "GB": "RA000585",
    "NL": "RA000463",
    "NO": "RA000472",
    "IE": "RA000215",
    "LV": "RA000327",
    "LT": "RA000330",
    "FR": "RA000580",
    "SE": "RA000544",
    "EE": "RA000181",
    "BE": "RA000143",
    "AT": "RA000128",
    "PL": "RA000439",
    "SK": "RA000476",
    "SG": "RA000509",
    "CA": "RA000072",
    "DK": "RA000170",
    "HR": "RA000156",
    "MT": "RA000443",
    "BR": "RA000681",
}
# Names of countries that are in no standard, and their codes.
COUNTRY_NAMES = {
    "england": "GB",
    "england and wales": "GB",
    "england & wales": "GB",
    "scotland": "GB",
    "wales": "GB",
    "northern ireland": "GB",
    "great britain": "GB",
    "united kingdom": "GB",
    "uae": "AE",
    "usa": "US",
    "us": "US",
}
# Leak data sets by the name in a description, lower case.
LEAKS = {
    "panama papers": "Panama Papers",
    "paradise papers": "Paradise Papers",
    "pandora papers": "Pandora Papers",
    "bahamas leaks": "Bahamas Leaks",
    "offshore leaks": "Offshore Leaks",
    "fbme bank": "FBME Bank",
}
# Marks of open licences in their names, lower case.
OPEN_LICENCES = ("ogl", "psi", "nlod", "odc-by", "cc-by", "open licence", "open license", "licence ouverte", "open government", "open data", "opendata", "ogd")
# What an annotation may be for.
MOTIVATIONS = ("commenting", "correcting", "identifying", "linking", "transformation")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def query_text(name: Column) -> Column:
    """A name without query syntax: blanks in its place, and AND or OR at an edge in lower case; '' for null."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), QUERY_SYNTAX, " "), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"^AND(?= |$)", "and"), r"^OR(?= |$)", "or"), r"(?<= )AND$", "and"), r"(?<= )OR$", "or")


_SENTENCE = r"(?i)extracted from the\s+(.+?)\s+data\b"


def leak_parts(description: Column) -> tuple[Column, Column, Column]:
    """Data set, collection and jurisdiction of a leak record's description: a sentence, or pieces between bars
    and dots. What still reads as prose names no data set."""
    text = F.coalesce(description, F.lit(""))
    said = F.regexp_extract(text, _SENTENCE, 1)
    pieces = F.split(text, "[·•|/]")
    raw = F.when(said != "", said).otherwise(F.get(pieces, F.lit(0)))
    leak = F.trim(F.get(F.split(raw, " - ", 2), F.lit(0)))
    name = F.coalesce(_map(LEAKS)[F.lower(leak)], F.when(leak.rlike(r"(?i)\b(node|extracted|from)\b"), "").otherwise(leak))
    collection = F.coalesce(F.trim(F.get(F.split(said, " - ", 2), F.lit(1))), F.lit(""))
    return name, collection, F.when(said != "", "").otherwise(F.coalesce(F.trim(F.get(pieces, F.lit(1))), F.lit("")))


def authority(country: Column) -> Column:
    return _map(AUTHORITIES)[F.upper(F.trim(country))]


def with_country(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with country: two letters stay, in upper case, other names go by a few names of our own, else by codes (name,
    code); '' where nothing is known."""
    key = F.lower(F.trim(column))
    known = df.withColumn("_key", key).join(codes.select(F.lower("name").alias("_key"), F.col("code").alias("_code")).dropDuplicates(["_key"]), "_key", "left")
    own = F.when(F.trim(column).rlike("^[A-Za-z]{2}$"), F.upper(F.trim(column)))
    return known.withColumn("country", F.coalesce(own, _map(COUNTRY_NAMES)[F.col("_key")], "_code", F.lit(""))).drop("_key", "_code")


def with_language(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """df with language: the three-letter code of a language given by two or three letters, with or without a region or
    script behind it; null where codes (alpha2, alpha3) don't know it."""
    key = F.get(F.split(F.lower(F.trim(column)), "[-_]"), F.lit(0))
    both = codes.select(F.col("alpha2").alias("_key"), F.col("alpha3").alias("language")).unionByName(codes.select(F.col("alpha3").alias("_key"), F.col("alpha3").alias("language"))).where("_key IS NOT NULL").dropDuplicates(["_key"])
    return df.withColumn("_key", key).join(both, "_key", "left").drop("_key")


def licence_terms(licence: Column, known: dict[str, str] | None = None) -> Column:
    """yes, no or conditional: commercial use under a licence, by exact name (of `known`), else by what its name says,
    first that it is non-commercial, then public domain, then open; what nothing is known of is conditional."""
    key = F.lower(F.trim(F.coalesce(licence, F.lit(""))))
    said = F.when(key.contains("non-commercial") | key.contains("noncommercial") | key.rlike(r"(^|[^a-z])nc([^a-z]|$)"), "no")
    said = said.when(key.contains("cc0") | key.contains("public domain") | key.contains("publicdomain"), "yes")
    for mark in OPEN_LICENCES:
        said = said.when(key.contains(mark), "yes")
    said = said.otherwise("conditional")
    return F.coalesce(_map({k.lower(): v for k, v in known.items()})[key], said) if known else said


def resolved(document: object, pointer: str) -> object:
    """What a JSON pointer leads to; raises KeyError, IndexError or ValueError where it leads nowhere."""
    if pointer in ("", "/"):
        return document
    for part in pointer.lstrip("/").split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(document, list):
            document = document[int(part)]
        elif isinstance(document, dict):
            document = document[part]
        else:
            raise KeyError(part)
    return document


@F.pandas_udf(T.BooleanType())
def pointer_resolves(documents: pd.Series, pointers: pd.Series) -> pd.Series:
    def one(text: str | None, pointer: str | None) -> bool:
        try:
            resolved(json.loads(text), pointer)
        except (KeyError, IndexError, ValueError, TypeError, AttributeError):
            return False
        return True

    return pd.Series([one(d, p) for d, p in zip(documents, pointers, strict=True)], dtype=bool)


def annotation_problems(statements: DataFrame) -> DataFrame:
    """statement_id, place, problem of annotations: an unknown motivation, no pointer, or one that leads nowhere in its
    statement. statements: statement_id, value (the statement as JSON)."""
    each = statements.select("statement_id", "value", F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$.annotations", "array<struct<motivation:string,statementPointerTarget:string>>")).alias("place", "a"))
    target = F.col("a.statementPointerTarget")
    missing = F.coalesce(target, F.lit("")) == ""
    checked = each.withColumn("resolves", pointer_resolves(F.col("value"), F.coalesce(target, F.lit("")))).withColumn("problems", F.array_compact(F.array(F.when(~F.coalesce(F.col("a.motivation").isin(*MOTIVATIONS), F.lit(False)), "motivation"), F.when(missing, "missing pointer").when(~F.col("resolves"), "dangling pointer"))))
    return checked.select("statement_id", "place", F.explode("problems").alias("problem"))
