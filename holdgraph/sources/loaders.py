"""Loading bulk files: required headers, column spellings, indexes, look-ups and nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header; a missing required column fails at once, before any row is read."""
    df = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def lower_named(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def first_of(df: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """A column under the first of several headers that has a value."""
    there = [F.nullif(F.trim(c), F.lit("")) for c in candidates if c in df.columns]
    return df.withColumn(name, F.coalesce(*there) if there else F.lit(None).cast("string"))


def identifier_index(identifiers: DataFrame, entities: DataFrame, schemes: tuple[str, ...]) -> DataFrame:
    """scheme, id, statement_id: identifiers of some schemes joined to their entities, blanks left out."""
    return identifiers.where(F.col("scheme").isin(*schemes) & (F.coalesce("id", F.lit("")) != "")).join(entities.select("link", "statement_id"), "link").select("scheme", F.upper("id").alias("id"), "statement_id").distinct()


def twins(identifiers: DataFrame, left: str, right: str) -> DataFrame:
    """Two identifiers of one entity side by side."""
    a = identifiers.where(F.col("scheme") == left).select("link", F.col("id").alias("left_id"))
    return a.join(identifiers.where(F.col("scheme") == right).select("link", F.col("id").alias("right_id")), "link")


def registry_twins(identifiers: DataFrame, schemes: tuple[str, ...], begins: str) -> DataFrame:
    """record: records whose id begins so and that share a code under one of the schemes with a record whose id doesn't.
    identifiers: record, scheme, code. Codes meet once each, however many records share one."""
    coded = identifiers.where(F.col("scheme").isin(*schemes) & (F.coalesce("code", F.lit("")) != "")).select("record", "code").distinct()
    others = coded.where(~F.col("record").startswith(begins)).select("code").distinct()
    return coded.where(F.col("record").startswith(begins)).join(others, "code", "left_semi").select("record").distinct()


def lookup(rows: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """key, value: the last non-empty value of each key."""
    return rows.where(F.col(value).isNotNull()).groupBy(key.alias("key")).agg(F.max_by(value, order).alias(value))


def assembled(base: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """Each base row with the rows of other files as arrays (empty where there are none)."""
    out = base
    for name, part in parts.items():
        rest = [c for c in part.columns if c != key]
        lists = part.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(lists, key, "left")
    return out


def both_directions(rows: DataFrame, a: str, b: str) -> DataFrame:
    """company, other, side: a row under each of its two companies."""
    return rows.select(F.col(a).alias("company"), F.col(b).alias("other"), F.lit("subject").alias("side")).unionByName(rows.select(F.col(b).alias("company"), F.col(a).alias("other"), F.lit("object").alias("side")))


def xml_rows(df: DataFrame, column: str, path: str, schema: str) -> DataFrame:
    """Elements of XML payloads as rows: other columns and the fields of schema."""
    other = [c for c in df.columns if c != column]
    parsed = F.from_xml(F.col(column), schema)
    return df.select(*other, F.explode(parsed[path]).alias("_e")).select(*other, "_e.*")


def group_register(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and heads of a register of company groups, a row an LEI (the first by seq). rows: seq, lei, name,
    parent_name, head (boolean), alternative_names (between semicolons). Heads have how many members their
    group has, and how many of them have an LEI."""
    clean = rows.withColumn("lei", F.upper(F.trim("lei"))).withColumn("alternative_names", F.array_except(F.array_distinct(F.filter(F.transform(F.split("alternative_names", ";"), lambda n: F.trim(n)), lambda n: n != "")), F.array("name")))
    count = clean.where("NOT head").groupBy("parent_name").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.coalesce("lei", F.lit("")) != "", 1)).alias("members_with_lei"))
    first = clean.where("coalesce(lei, '') <> ''").groupBy("head", "lei").agg(F.min(F.struct("seq", "name", "parent_name", "alternative_names")).alias("r")).select("head", "lei", "r.name", "r.parent_name", "r.alternative_names")
    heads = first.where("head").join(count, "parent_name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("members", "members_with_lei")})
    return first.where("NOT head").drop("head"), heads.drop("head")


def stacked_sheets(sheets: dict[str, DataFrame], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of several sheets under one set of columns, each the first of its names that a sheet has (null where it
    has none), with the sheet's name."""
    out = None
    for name, sheet in sheets.items():
        pick = [next((F.col(f"`{c}`") for c in names_ if c in sheet.columns), F.lit(None)).cast("string").alias(to) for to, names_ in columns.items()]
        one = sheet.select(F.lit(name).alias("sheet"), *pick)
        out = one if out is None else out.unionByName(one)
    return out


def upserted(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key, the last by seq."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, *(F.col("r")[c].alias(c) for c in rest))


def parent_links(rows: DataFrame, kinds: tuple[str, ...] = ("direct", "ultimate")) -> DataFrame:
    """key and, of each kind, the parent of its last published row (a blank status counts as published). rows: key, seq,
    kind, parent, status."""
    published = rows.where(F.upper(F.coalesce(F.trim("status"), F.lit(""))).isin("", "PUBLISHED"))
    last = lambda kind: F.max_by("parent", F.when(F.col("kind") == kind, F.col("seq"))).alias(f"{kind}_parent")
    return published.groupBy("key").agg(*map(last, kinds))


def preferred_names(rows: DataFrame, languages: list[str]) -> DataFrame:
    """key and a column for each language: the name of the lowest priority, the first row of ties; blanks count for
    nothing. rows: key, lang, priority, seq, name."""
    best = rows.where(F.coalesce(F.trim(F.col("name").cast("string")), F.lit("")) != "").groupBy("key", "lang").agg(F.min_by("name", F.struct("priority", "seq")).alias("name"))
    return best.groupBy("key").pivot("lang", languages).agg(F.first("name"))


def securities_index(rows: DataFrame) -> DataFrame:
    """lei, n_isins, sanctioned, name, first_row of rows (seq, lei, isins: cell of several, name, sanctioned, blocked) of
    which a mark says that trade is barred."""
    barred = rows.where(F.col("sanctioned") | F.col("blocked"))
    each = barred.select("lei", "sanctioned", "seq", "name", F.explode(F.filter(F.split("isins", "[; ]"), lambda c: F.trim(c) != "")).alias("isin"))
    return each.groupBy("lei").agg(F.countDistinct("isin").alias("n_isins"), F.bool_or("sanctioned").alias("sanctioned"), F.min_by("name", "seq").alias("name"), F.min("seq").alias("first_row"))


def scraped(pages: DataFrame, key: str, html: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """key, field, place, value: what each pattern (with the group that counts) finds on a page, in order."""
    found = F.array(*(F.struct(F.lit(name).alias("field"), F.regexp_extract_all(html, F.lit(p), F.lit(g)).alias("values")) for name, (p, g) in patterns.items()))
    each = pages.select(key, F.inline(found))
    return each.select(key, "field", F.posexplode("values").alias("place", "value"))
