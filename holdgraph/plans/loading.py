"""Bulk loading and look-ups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdgraph.operators import risk, rollups
from holdgraph.plans.registry import query
from holdgraph.sources import derived
from holdgraph.sources import loaders as B

table = derived.table


def _identifiers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    i = lambda scheme, c: F.struct(F.lit(scheme).alias("scheme"), c.alias("id"))
    ids = F.array(i("LEI", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit("l"), F.col("p_partkey").cast("string")))), i("GB-COH", F.concat(F.lit("c"), (F.col("p_partkey") % 700).cast("string"))))
    return p.select(F.col("p_partkey").alias("link"), F.inline(ids))


_IDS = "ids AS (SELECT p_partkey AS link, 'LEI' AS scheme, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'l' || p_partkey END AS id FROM part UNION ALL SELECT p_partkey, 'GB-COH', 'c' || (p_partkey % 700) FROM part)"


@query(f"WITH {_IDS} SELECT scheme, upper(id) AS id, 's' || link AS statement_id FROM ids WHERE scheme IN ('LEI', 'XI-LEI') AND id <> ''")
def identifier_index(spark, sf_dir):
    """Index from identifiers to statements (SC1, SC3, SC8, JN1)."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("link"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("statement_id"))
    return B.identifier_index(_identifiers(spark, sf_dir), e, ("LEI", "XI-LEI"))


@query(f"WITH {_IDS} SELECT a.link, a.id AS left_id, b.id AS right_id FROM ids a JOIN ids b ON a.link = b.link AND a.scheme = 'LEI' AND b.scheme = 'GB-COH' WHERE a.id <> ''")
def identifier_twins(spark, sf_dir):
    """Two identifiers of one entity (JN2)."""
    return B.twins(_identifiers(spark, sf_dir), "LEI", "GB-COH").where("left_id <> ''").select("link", "left_id", "right_id")


@query("""WITH c AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS code, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS items FROM orders)
SELECT code AS key, (list(items ORDER BY seq DESC) FILTER (items IS NOT NULL))[1] AS items FROM c GROUP BY code HAVING count(items) > 0""")
def code_lookup(spark, sf_dir):
    """Look-up by zero-padded code, the last non-empty list of a code (SC15)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("items"))
    return B.lookup(o, F.lpad(F.col("o_custkey").cast("string"), 8, "0"), "items", "o_orderkey")


@query("""SELECT c_custkey AS code, c_name, coalesce(h.n, 0) AS n_holders, coalesce(o.n, 0) AS n_officers FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) h ON h.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c_custkey""")
def register_assembly(spark, sf_dir):
    """Base file with the rows of others (SC16, JN10)."""
    o = table(spark, sf_dir, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("ref"))
    out = B.assembled(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), "c_name"), "code", holders=part("O"), officers=part("F"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.select("code", "c_name", F.greatest(n("holders"), F.lit(0)).cast("long").alias("n_holders"), F.greatest(n("officers"), F.lit(0)).cast("long").alias("n_officers"))


@query("""SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def people_of_companies(spark, sf_dir):
    """People whose company is in the set (SC18, PF20)."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(c, "user_id", "left_semi").select("event_id", "user_id")


@query("""WITH r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT company, side, count(*) AS n FROM (SELECT 'p' || a AS company, 'subject' AS side FROM r UNION ALL SELECT 's' || b, 'object' FROM r) GROUP BY company, side""")
def network_directions(spark, sf_dir):
    """Relationships found from either end (SC26, SC27)."""
    r = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")).distinct()
    return B.both_directions(r, "a", "b").groupBy("company", "side").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS name, (list(p_type ORDER BY p_partkey) FILTER (p_type <> '' AND p_size % 3 = 0))[1] AS first_type, (list(p_type ORDER BY p_partkey DESC) FILTER (contains(lower(p_type), 'steel')))[1] AS state_type, count(DISTINCT p_size) AS n_years FROM part GROUP BY p_brand""")
def company_map(spark, sf_dir):
    """Per name the first value that is there, the last that says so, and a set (JN23)."""
    p = table(spark, sf_dir, "part")
    first = F.min_by("p_type", F.when((F.col("p_type") != "") & (F.col("p_size") % 3 == 0), F.col("p_partkey")))
    state = F.max_by("p_type", F.when(F.lower("p_type").contains("steel"), F.col("p_partkey")))
    return p.groupBy(F.col("p_brand").alias("name")).agg(first.alias("first_type"), state.alias("state_type"), F.countDistinct("p_size").alias("n_years"))


@query("""SELECT c_custkey, n_suppliers, confirmed FROM (SELECT o_custkey AS c_custkey, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_suppkey) >= 2 AS confirmed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def confirming_sources(spark, sf_dir):
    """How many sources confirm an identifier (AG24)."""
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    return rollups.confirmed(j, ["c_custkey"], "l_suppkey").withColumnRenamed("n_sources", "n_suppliers")


@query("""SELECT user_id, event_id, place FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events) WHERE place <= 3""")
def latest_answers(spark, sf_dir):
    """The latest three answers of a subject (WN13)."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = rollups.top_per(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)
    return top.select("user_id", "event_id", F.row_number().over(order).alias("place"))


@query("""WITH f AS (SELECT user_id, event_id, user_id // 4 AS canonical FROM events) SELECT canonical, min(event_id) AS event_id FROM f GROUP BY canonical""")
def frontier_once(spark, sf_dir):
    """Frontier nodes by canonical id, the first wins (WN17)."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 4).alias("canonical"), "event_id")
    return rollups.first_per(e, ["canonical"], ["event_id"]).select("canonical", "event_id")


@query("""SELECT user_id, count(*) AS n_positions, bool_or(value > 50) AS pep FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id HAVING bool_or(value > 50)""")
def open_positions(spark, sf_dir):
    """Persons with a position that has not ended (RK5)."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase"))
    return risk.open_positions(e, "user_id", F.col("value") <= 50).select("user_id", "n_positions", "pep")


@query("""SELECT o_orderkey, o_custkey, p_brand IS NOT NULL AS sanctioned FROM orders LEFT JOIN (SELECT DISTINCT p_size AS k, min(p_brand) AS p_brand FROM part WHERE contains(p_type, 'STEEL') OR p_size % 7 = 0 GROUP BY p_size) s ON s.k = o_custkey % 50""")
def sanctioned_overlay(spark, sf_dir):
    """Overlay of a small index on subjects."""
    s = table(spark, sf_dir, "part").where(F.col("p_type").contains("STEEL") | (F.col("p_size") % 7 == 0)).groupBy(F.col("p_size").alias("k")).agg(F.min("p_brand").alias("p_brand"))
    o = table(spark, sf_dir, "orders").withColumn("k", (F.col("o_custkey") % 50).cast("int"))
    return o.join(s, "k", "left").select("o_orderkey", "o_custkey", F.col("p_brand").isNotNull().alias("sanctioned"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'context' ELSE 'risk' END AS k, coalesce(k, 'risk') AS kind FROM events) GROUP BY kind""")
def signal_kinds(spark, sf_dir):
    """Signals by kind, a missing kind counts as risk (PF10)."""
    kind = F.when(F.col("event_type") == "view", "context").when(F.col("event_type") != "error", "risk")
    return table(spark, sf_dir, "events").groupBy(risk.signal_kind(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'withheld by licence' ELSE lang END AS shown FROM documents""")
def redacted_payloads(spark, sf_dir):
    """Payloads withheld by licence (PF11)."""
    return table(spark, sf_dir, "documents").select("doc_id", risk.redacted(F.col("lang"), F.col("source"), ("src0", "src1")).alias("shown"))
