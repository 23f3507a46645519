"""Small functions on register texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.functions import names
from holdgraph.functions import texts as X
from holdgraph.plans.registry import query
from holdgraph.sources import derived

table = derived.table
_quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_lits = lambda xs: F.array(*map(F.lit, xs))


def _pick(xs, k):
    return F.element_at(_lits(xs), (k % len(xs) + 1).cast("int"))


_FRAMES = ('AND "', "", "OR (x) && ", "a:")
_ENDS = ('"', " OR", " * AND", " = z")


@query(rf"""WITH q AS (SELECT p_partkey, {_quoted(_FRAMES)}[p_partkey % 4 + 1] || p_name || {_quoted(_ENDS)}[p_partkey % 4 + 1] AS q FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(q, '["\\/:^~\[\]{{}}()!*?<>=]|&&|\|\|', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM q)
SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '^AND( |$)', 'and\1'), '^OR( |$)', 'or\1'), ' AND$', ' and'), ' OR$', ' or') AS question FROM c""")
def query_texts(spark, sf_dir):
    """Names without query syntax (SF19)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", X.query_text(F.concat(_pick(_FRAMES, k), F.col("p_name"), _pick(_ENDS, k))).alias("question"))


_LEAKS = ("Entity node extracted from the Panama Papers data.", "Officer node extracted from the Paradise Papers - Appleby data", "Panama Papers · British Virgin Islands", "New Leak / Malta", "A node from somewhere", "")


@query(rf"""WITH d AS (SELECT p_partkey, {_quoted(_LEAKS)}[p_partkey % 6 + 1] AS d FROM part), s AS (SELECT *, regexp_extract(d, '(?i)extracted from the\s+(.+?)\s+data\b', 1) AS said FROM d),
r AS (SELECT *, trim(string_split(CASE WHEN said <> '' THEN said ELSE regexp_split_to_array(d, '[·•|/]')[1] END, ' - ')[1]) AS leak FROM s)
SELECT p_partkey, CASE lower(leak) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LEAKS.items())} ELSE CASE WHEN regexp_matches(leak, '(?i)\b(node|extracted|from)\b') THEN '' ELSE leak END END AS dataset,
  coalesce(trim(string_split(said, ' - ')[2]), '') AS collection, CASE WHEN said <> '' THEN '' ELSE coalesce(trim(regexp_split_to_array(d, '[·•|/]')[2]), '') END AS jurisdiction FROM r""")
def leak_records(spark, sf_dir):
    """Data set, collection and jurisdiction of leak descriptions (SF24)."""
    parts = X.leak_parts(_pick(_LEAKS, F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for c, n in zip(parts, ("dataset", "collection", "jurisdiction"), strict=True)))


_CODES = "[" + ", ".join(f"'{c}'" for c in derived.COUNTRIES) + "]"
_GIVEN = ("x", "England", " usa ", "fr", "Atlantis")


@query(f"""WITH n AS (SELECT n_name AS name, {_CODES}[n_nationkey + 1] AS code FROM nation), c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN n_name ELSE {_quoted(_GIVEN)}[c_custkey % 5 + 1] END AS given, lower({_CODES}[n_nationkey + 1]) AS two FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN regexp_matches(trim(given), '^[A-Za-z]{{2}}$') THEN upper(trim(given)) ELSE coalesce(CASE lower(trim(given)) WHEN 'england' THEN 'GB' WHEN 'usa' THEN 'US' END, n.code, '') END AS country,
  CASE WHEN c_custkey % 3 = 0 THEN two || 'x' WHEN c_custkey % 3 = 1 THEN two || 'x' END AS language,
  CASE two {' '.join(f"WHEN '{k.lower()}' THEN '{v}'" for k, v in X.AUTHORITIES.items())} END AS authority
FROM c LEFT JOIN n ON lower(n.name) = lower(trim(given))""")
def code_lookups(spark, sf_dir):
    """Country and language codes of free texts, and the authority of national numbers (MP21, SF6, SF36)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.element_at(_lits(derived.COUNTRIES), F.col("n_nationkey").cast("int") + 1).alias("code"))
    k = F.col("c_custkey")
    given = F.when(k % 5 == 0, F.col("n_name")).otherwise(_pick(_GIVEN, k))
    tag = F.when(k % 3 == 0, F.concat("code", F.lit("-Latn"))).when(k % 3 == 1, F.concat(F.lower("code"), F.lit("x"))).otherwise("q")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(nation, "n_nationkey").select(k, given.alias("given"), tag.alias("tag"), X.authority(F.lower("code")).alias("authority"))
    c = X.with_country(c, "given", nation.select(F.col("n_name").alias("name"), "code"))
    languages = nation.select(F.lower("code").alias("alpha2"), F.concat(F.lower("code"), F.lit("x")).alias("alpha3"))
    return X.with_language(c, "tag", languages).select("c_custkey", "country", "language", "authority")


_LICENCES = ("CC-BY-NC-4.0", "Non-Commercial use", "CC0 1.0", "Open Government Licence", "OGL-UK-3.0", "Bespoke terms", "", "Licence-X")


@query(f"""WITH l AS (SELECT p_partkey, {_quoted(_LICENCES)}[p_partkey % 8 + 1] AS l FROM part)
SELECT p_partkey, CASE WHEN l = 'Licence-X' THEN 'no' WHEN contains(lower(l), 'non-commercial') OR contains(lower(l), 'noncommercial') OR regexp_matches(lower(l), '(^|[^a-z])nc([^a-z]|$)') THEN 'no' WHEN contains(lower(l), 'cc0') OR contains(lower(l), 'public domain') THEN 'yes'
  WHEN {' OR '.join(f"contains(lower(l), '{m}')" for m in X.OPEN_LICENCES)} THEN 'yes' ELSE 'conditional' END AS commercial FROM l""")
def licence_names(spark, sf_dir):
    """Commercial use by licence, by name and by what the name says (SF26)."""
    return table(spark, sf_dir, "part").select("p_partkey", X.licence_terms(_pick(_LICENCES, F.col("p_partkey")), {"licence-x": "no"}).alias("commercial"))


_POINTERS = ("/recordDetails/name", "/recordDetails/interests/0/type", "/recordDetails/interests/1", "/nothing", "", "/")


@query(f"""WITH s AS (SELECT p_partkey, {_quoted(_POINTERS)}[p_partkey % 6 + 1] AS pointer, ['linking', 'commenting', 'guessing'][p_partkey % 3 + 1] AS motivation, '{{"recordDetails":{{"name":"x","interests":[{{"type":"a"}}]}}}}' AS doc FROM part),
p AS (SELECT 's' || p_partkey AS statement_id, 0 AS place, unnest([CASE WHEN motivation = 'guessing' THEN 'motivation' END, CASE WHEN pointer = '' THEN 'missing pointer' WHEN pointer <> '/' AND NOT json_exists(doc, pointer) THEN 'dangling pointer' END]) AS problem FROM s)
SELECT statement_id, CAST(place AS INTEGER) AS place, problem FROM p WHERE problem IS NOT NULL""")
def annotation_checks(spark, sf_dir):
    """Annotations whose motivation or pointer is wrong (PF6, SF15)."""
    k = F.col("p_partkey")
    note = F.struct(_pick(("linking", "commenting", "guessing"), k).alias("motivation"), _pick(_POINTERS, k).alias("statementPointerTarget"))
    details = F.struct(F.lit("x").alias("name"), F.array(F.struct(F.lit("a").alias("type"))).alias("interests"))
    value = F.to_json(F.struct(details.alias("recordDetails"), F.array(note).alias("annotations")))
    return X.annotation_problems(table(spark, sf_dir, "part").select(F.concat(F.lit("s"), k.cast("string")).alias("statement_id"), value.alias("value")))


_LATIN, _CYRILLIC = "abvgdezklmnoprstufABVGDEZKLMNOPRSTUF", "абвгдезклмнопрстуфАБВГДЕЗКЛМНОПРСТУФ"


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS latin FROM part")
def display_names(spark, sf_dir):
    """Names in another script, in Latin letters of the same case; null where there is nothing to change (SF4)."""
    k = F.col("p_partkey")
    name = F.when(k % 3 > 0, F.translate("p_type", _LATIN, _CYRILLIC)).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(k, names.latin_name(name).alias("latin"))
