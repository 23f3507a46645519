"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.functions import names
from holdgraph.functions import scalars as S
from holdgraph.plans.registry import query
from holdgraph.sources import derived


@query("SELECT c_custkey, 'hg-' || substr(sha256(c_name || '|' || c_mktsegment || '|' || c_nationkey), 1, 24) AS id FROM customer")
def stable_id(spark, sf_dir):
    """Stable ids from hashed parts (MP4, SF31)."""
    return derived.table(spark, sf_dir, "customer").select("c_custkey", S.stable_id(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("id"))


_LEI = "'HOLD00' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"
_SPELLED = "'17242113' || '00' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')"


@query(f"""WITH k AS (SELECT o_orderkey, {_LEI} AS stem, 98 - CAST(CAST({_SPELLED} || '00' AS HUGEINT) % 97 AS INTEGER) AS ok FROM orders)
SELECT o_orderkey, stem || lpad(CAST(ok AS VARCHAR), 2, '0') AS lei, true AS valid, (ok + 1) % 97 = ok % 97 AS valid_typo FROM k""")
def lei_check(spark, sf_dir):
    """LEI check digits: made from order keys, valid; the next number is a typo (SF7)."""
    o = derived.table(spark, sf_dir, "orders")
    stem = F.concat(F.lit("HOLD00"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    digits = 98 - S.mod97(F.concat(stem, F.lit("00")))
    lei = lambda d: F.concat(stem, F.lpad(d.cast("string"), 2, "0"))
    return o.select("o_orderkey", lei(digits).alias("lei"), S.lei_ok(lei(digits)).alias("valid"), S.lei_ok(lei(digits + 1)).alias("valid_typo"))


@query("""WITH p AS (SELECT p_partkey, 'GB' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS stem FROM part),
d AS (SELECT p_partkey, stem, string_split('1611' || substr(stem, 3), '') AS c FROM p),
l AS (SELECT p_partkey, stem, list_sum(list_transform(list_reverse(c), lambda x, i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END ELSE CAST(x AS INT) END)) AS s FROM d)
SELECT p_partkey, stem || CAST(CAST((10 - s % 10) % 10 AS INTEGER) AS VARCHAR) AS isin, true AS valid FROM l""")
def isin_check(spark, sf_dir):
    """ISIN check digits (SF8)."""
    p = derived.table(spark, sf_dir, "part")
    stem = F.concat(F.lit("GB"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    tries = F.array(*(F.concat(stem, F.lit(str(d))) for d in range(10)))
    isin = F.element_at(F.filter(tries, S.isin_ok), 1)
    return p.select("p_partkey", isin.alias("isin"), S.isin_ok(isin).alias("valid"))


@query(f"""WITH {derived.SQL} SELECT statement_id, founding_date, CASE length(founding_date) WHEN 4 THEN founding_date || '-01-01' WHEN 7 THEN founding_date || '-01' ELSE founding_date END AS rounded,
CASE length(founding_date) WHEN 4 THEN 'year' WHEN 7 THEN 'month' ELSE 'day' END AS precision,
CASE WHEN length(founding_date) = 10 THEN CAST(CAST(substr(founding_date, 9, 2) AS INT) AS VARCHAR) || ' May ' || substr(founding_date, 1, 4) END AS shown FROM entity""")
def partial_dates(spark, sf_dir):
    """Partial dates rounded with their precision, and spoken dates (SF14, SF16)."""
    d = F.col("founding_date")
    return derived.entities(spark, sf_dir).select("statement_id", "founding_date", S.rounded_date(d).alias("rounded"), S.date_precision(d).alias("precision"), S.human_date(d).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(l_quantity AS BIGINT) + 25 AS VARCHAR)
WHEN 2 THEN '>' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 3 THEN '<=' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END AS share FROM lineitem""")
def share_texts(spark, sf_dir):
    """Shares as text (SF17, SF18)."""
    q = F.col("l_quantity").cast("long")
    when = lambda k, v: F.when(q % 5 == k, v.cast("double"))
    share = F.struct(when(0, q).alias("exact"), when(1, q).alias("minimum"), when(2, q).alias("exclusiveMinimum"), F.coalesce(when(1, q + 25), when(3, q)).alias("maximum"), F.lit(None).cast("double").alias("exclusiveMaximum"))
    return derived.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.share_text(share).alias("share"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '/+$', '') AS url,
regexp_replace(substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60), '-$', '') AS slug,
CASE WHEN length(regexp_replace(upper(url), '[^A-Z0-9]', '', 'g')) >= 7 THEN regexp_replace(upper(url), '[^A-Z0-9]', '', 'g') END AS identifier FROM pages""")
def canonical_forms(spark, sf_dir):
    """Canonical URLs, identifiers and slugs (SF10, SF11, SF13)."""
    u = F.col("url")
    return derived.table(spark, sf_dir, "pages").select("page_id", S.canonical_url(u).alias("url"), S.slug(u).alias("slug"), S.canonical_identifier(u).alias("identifier"))


@query(r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS line FROM documents),
m AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM n)
SELECT doc_id, name, instr(name, ' ') > 0 AS matchable, array_to_string(list_sort(list_filter(string_split(name, ' '), lambda t: t <> '')), ' ') AS key FROM m""")
def name_keys(spark, sf_dir):
    """Comparable names and order-free keys (SF2, SF28, PF12)."""
    n = derived.table(spark, sf_dir, "documents").select("doc_id", S.plain_name(F.col("text")).alias("name"))
    return n.select("doc_id", "name", S.matchable(F.col("name")).alias("matchable"), S.sorted_tokens(F.col("name")).alias("key"))


@query()
def name_fold(spark, sf_dir):
    """Case, accents and scripts folded; DuckDB has no such fold, so tests hold it (SF1, SF2)."""
    return derived.table(spark, sf_dir, "documents").select("doc_id", names.normalised_name("text").alias("name"))


@query(r"""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ownership-of-shares-25-to-50-percent' WHEN 1 THEN 'voting-rights-75-to-100-percent-as-firm' WHEN 2 THEN 'right-to-appoint-and-remove-directors' ELSE 'significant-influence-or-control' END AS nature FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'shareholding' WHEN 1 THEN 'votingRights' WHEN 2 THEN 'appointmentOfBoard' ELSE 'otherInfluenceOrControl' END AS type,
TRY_CAST(nullif(regexp_extract(nature, '([0-9]+)-to-([0-9]+)-percent', 1), '') AS DOUBLE) AS lo, TRY_CAST(nullif(regexp_extract(nature, '([0-9]+)-to-([0-9]+)-percent', 2), '') AS DOUBLE) AS hi FROM n""")
def nature_of_control(spark, sf_dir):
    """Filed natures of control as interest types and bands (MP5)."""
    natures = F.array(*map(F.lit, ("ownership-of-shares-25-to-50-percent", "voting-rights-75-to-100-percent-as-firm", "right-to-appoint-and-remove-directors", "significant-influence-or-control")))
    n = S.nature_of_control(F.element_at(natures, (F.col("c_custkey") % 4 + 1).cast("int")))
    return derived.table(spark, sf_dir, "customer").select("c_custkey", n["type"].alias("type"), n["exclusiveMinimum"].alias("lo"), n["maximum"].alias("hi"))
