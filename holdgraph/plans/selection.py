"""Selections, screening gates and scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.functions import codelists as C
from holdgraph.functions import scalars as S
from holdgraph.operators import graph, risk, screening
from holdgraph.operators import selection as L
from holdgraph.plans.ownership import EDGES, edges
from holdgraph.plans.registry import query
from holdgraph.sources import derived

table = derived.table


@query("""SELECT o_custkey, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) > 0 AS is_current FROM orders GROUP BY o_custkey""")
def current_connections(spark, sf_dir):
    """Connections with a role that has not ended (PF8)."""
    end = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("string"))
    return L.current_of(table(spark, sf_dir, "orders").withColumn("end", end), ["o_custkey"], "end")


@query(f"""WITH {derived.SQL}, w AS (SELECT statement_id FROM person WHERE nationality IN ('IR', 'KP', 'SY'))
SELECT statement_id, 1 AS part FROM w UNION ALL SELECT 'o' || substr(p.statement_id, 2), 2 FROM person p JOIN w USING (statement_id)
UNION ALL SELECT DISTINCT e.statement_id, 0 FROM entity e JOIN person p ON p.subject_id = e.statement_id JOIN w ON w.statement_id = p.statement_id""")
def person_subgraph(spark, sf_dir):
    """Persons of listed nationalities with what they own (PF13)."""
    p = derived.persons(spark, sf_dir)
    r = p.select(F.concat(F.lit("o"), F.expr("substring(statement_id, 2)")).alias("statement_id"), F.col("statement_id").alias("party_id"), "subject_id")
    return L.subgraph(p, r, derived.entities(spark, sf_dir), p.where(F.col("nationality").isin("IR", "KP", "SY")).select("statement_id"))


@query(f"""WITH {derived.SQL}, s AS (SELECT event_id AS signal_id, CASE WHEN event_type IN ('click', 'view') THEN 'RELATED_' || upper(event_type) ELSE upper(event_type) END AS code, ['e' || (user_id * 3), 'e' || (event_id % 3000)] AS ids FROM events),
shown AS (SELECT statement_id FROM entity WHERE entity_type = 'registeredEntity')
SELECT signal_id, code FROM s WHERE NOT starts_with(code, 'RELATED_') OR EXISTS (SELECT 1 FROM shown WHERE list_contains(s.ids, shown.statement_id))""")
def scoped_signals(spark, sf_dir):
    """Cross-source signals kept for shown statements (PF14, PF15)."""
    code = F.upper("event_type")
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("signal_id"), F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("RELATED_"), code)).otherwise(code).alias("code"), F.array(F.concat(F.lit("e"), (F.col("user_id") * 3).cast("string")), F.concat(F.lit("e"), (F.col("event_id") % 3000).cast("string"))).alias("evidence_ids"))
    return L.scoped(s, derived.entities(spark, sf_dir).where("entity_type = 'registeredEntity'").select("statement_id")).select("signal_id", "code")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 5 OR event_type = 'purchase'""")
def deepen_selection(spark, sf_dir):
    """The first five hits of a subject and every carve-out (PF18, WN14)."""
    return L.first_or_flagged(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5, F.col("event_type") == "purchase").select("user_id", "event_id")


@query("""WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST('2024-01-01' AS DATE) + CAST(n_nationkey * 60 AS INTEGER) END AS d FROM nation)
SELECT c_custkey, CASE WHEN d IS NULL THEN NULL WHEN d > DATE '2026-01-01' THEN 'becoming_restricted:' || CAST(d AS VARCHAR) ELSE 'restricted' END AS notice FROM customer JOIN n ON n_nationkey = c_nationkey""")
def access_notices(spark, sf_dir):
    """Access notices by country and date (PF17)."""
    d = F.when(F.col("n_nationkey") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_nationkey") * 60).cast("int")))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), d.alias("d"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").select("c_custkey", L.access_notice(F.col("d"), F.lit("2026-01-01").cast("date")).alias("notice"))


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM documents)
SELECT doc_id, length(replace(n, ' ', '')) >= 3 AS screenable FROM n""")
def screenable_names(spark, sf_dir):
    """Texts long enough to screen (PF23)."""
    return table(spark, sf_dir, "documents").select("doc_id", S.screenable(F.col("text")).alias("screenable"))


@query("""WITH h AS (SELECT user_id, event_type, event_id, CAST(event_id % 3 AS INTEGER) AS r, floor(value / 10) AS score FROM events)
SELECT user_id, event_id, n_copies, n_labels, corroborations FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n_copies, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, score DESC, event_id) AS k FROM h)
JOIN (SELECT user_id, count(DISTINCT event_type) AS n_labels, array_to_string(list_sort(list(DISTINCT CASE r WHEN 0 THEN 'birth_year' WHEN 1 THEN 'nationality' ELSE 'none' END)), ',') AS corroborations FROM h GROUP BY user_id) USING (user_id) WHERE k = 1""")
def collapsed_collections(spark, sf_dir):
    """Copies of one finding across collections: the best survives, corroborations unite (WN7)."""
    r = F.col("event_id") % 3
    also = F.array(F.when(r == 0, "birth_year").when(r == 1, "nationality").otherwise("none"))
    h = table(spark, sf_dir, "events").withColumn("score", F.floor(F.col("value") / 10)).withColumn("also", also)
    out = L.collapsed(h, ["user_id"], r, "score", "event_id", "event_type", "also")
    return out.select("user_id", "survivor.event_id", F.col("copies").alias("n_copies"), "n_labels", F.array_join("corroborations", ",").alias("corroborations"))


@query("""SELECT s_suppkey AS id, s_name AS name, 'entity' AS kind FROM supplier UNION ALL SELECT c_custkey, c_name, 'person' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def kind_fallthrough(spark, sf_dir):
    """Entity first, then person (SC2, SC28)."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("entity").alias("kind"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("kind"))
    return L.fallthrough(a, b, "id")


@query(r"""WITH h AS (SELECT p_partkey AS hit_id, trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')) AS form FROM part WHERE p_partkey % 3 = 0),
t AS (SELECT p_partkey AS target_id, trim(regexp_replace(lower(p_type || ' ' || p_name || ' ' || p_brand), '[^a-z0-9_]+', ' ', 'g')) AS name FROM part)
SELECT hit_id, target_id FROM h JOIN t ON contains(t.name, h.form) WHERE form <> ''""")
def percolated_names(spark, sf_dir):
    """Forms found inside names, as an equi-join on letters in a row (ER14)."""
    p = table(spark, sf_dir, "part")
    return L.contained(p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("hit_id"), F.col("p_name").alias("form")), p.select(F.col("p_partkey").alias("target_id"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("name")))


_GRAMS = lambda c: f"list_transform(range(1, length({c})), lambda i: {c}[i:i + 1])"
_PLAIN = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g'))"
_DICE = f"""CASE WHEN length(a) < 2 OR length(b) < 2 THEN 0.0 ELSE 2.0 * list_sum(list_transform(list_distinct({_GRAMS('a')}), lambda g: least(len(list_filter({_GRAMS('a')}, lambda h: h = g)), len(list_filter({_GRAMS('b')}, lambda h: h = g))))) / (length(a) + length(b) - 2) END"""


@query(f"""WITH p AS (SELECT p_partkey, {_PLAIN("CASE p_size % 4 WHEN 0 THEN p_type WHEN 1 THEN p_brand || ' ' || p_type WHEN 2 THEN p_type || ' ' || p_brand ELSE p_name END")} AS a, {_PLAIN("p_type || ' ' || p_brand")} AS b FROM part),
t AS (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb, {_DICE} AS dice FROM p),
s AS (SELECT *, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS few, CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END AS many FROM t)
SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 WHEN list_sort(ta) = list_sort(tb) THEN 0.97 WHEN len(few) >= 2 AND few[1][1] = many[1][1] AND few[-1] = many[-1] AND len(list_filter(few, lambda x: list_contains(many, x))) = len(few) THEN 0.9 WHEN dice >= 0.8 THEN 0.8 WHEN dice >= 0.6 THEN 0.6 ELSE dice END, 6) AS score FROM s""")
def name_ladders(spark, sf_dir):
    """The rungs of the name ladder (SF29, SF30, ER18)."""
    size = F.col("p_size") % 4
    a = F.when(size == 0, F.col("p_type")).when(size == 1, F.concat_ws(" ", "p_brand", "p_type")).when(size == 2, F.concat_ws(" ", "p_type", "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(screening.name_ladder(S.plain_name(a), S.plain_name(F.concat_ws(" ", "p_type", "p_brand"))), 6).alias("score"))


@query("""WITH x AS (SELECT o_orderkey, o_orderstatus = 'O' AS a, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_custkey % 3 = 0 END AS b FROM orders)
SELECT o_orderkey, round(1 / (1 + power(2.0, -(log2(0.000416 / (1 - 0.000416)) + CASE WHEN a THEN log2(0.9 / 0.01) ELSE log2(0.1 / 0.99) END + CASE WHEN b IS NULL THEN 0 WHEN b THEN log2(0.95 / 0.1) ELSE log2(0.05 / 0.9) END))), 9) AS p FROM x""")
def match_probability(spark, sf_dir):
    """Fellegi-Sunter match probabilities from agreement levels (ER19)."""
    a = F.col("o_orderstatus") == "O"
    b = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey") % 3 == 0)
    p = L.fellegi_sunter({"name": (a, 0.9, 0.01), "jurisdiction": (b, 0.95, 0.1)}, 0.000416)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(p, 9).alias("p"))


def _layer(d: int, most: int) -> str:
    """The d-th layer: what the one before leads to, less what is known, ranked; its first `most` go on."""
    known = " AND ".join(f"NOT EXISTS (SELECT 1 FROM keep{k} s WHERE s.root = x.root AND s.node = x.node)" for k in range(d))
    return f"""next{d} AS (SELECT DISTINCT k.root, e.owner_id AS node FROM keep{d - 1} k JOIN live e ON e.subject_id = k.node), rank{d} AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY node) AS place FROM next{d} x WHERE {known}), keep{d} AS (SELECT root, node FROM rank{d} WHERE place <= {most})"""


@query(f"""WITH {derived.SQL}, live AS (SELECT subject_id, party_id AS owner_id FROM relationship WHERE party_id IS NOT NULL AND status <> 'closed'), keep0 AS (SELECT statement_id AS root, statement_id AS node FROM entity), {_layer(1, 1)}, {_layer(2, 1)}, {_layer(3, 1)},
cut AS (SELECT DISTINCT root FROM (SELECT root FROM rank1 WHERE place > 1 UNION ALL SELECT root FROM rank2 WHERE place > 1 UNION ALL SELECT root FROM rank3 WHERE place > 1))
SELECT e.statement_id AS root, u.node, u.depth, c.root IS NOT NULL AS truncated FROM entity e LEFT JOIN (SELECT root, node, 1 AS depth FROM keep1 UNION ALL SELECT root, node, 2 FROM keep2 UNION ALL SELECT root, node, 3 FROM keep3) u ON u.root = e.statement_id LEFT JOIN cut c ON c.root = e.statement_id""")
def corporate_recursion(spark, sf_dir):
    """Owners in layers to depth three, each once, ended links left out; a bounded layer says when it was cut."""
    e, r = derived.entities(spark, sf_dir), derived.relationships(spark, sf_dir)
    edges_ = r.select(F.col("party_id").alias("owner_id"), "subject_id", (F.col("status") == "closed").alias("ended"))
    nodes, cut = graph.expansion(edges_, e.select(F.col("statement_id").alias("root")), 3, 1)
    return cut.join(nodes, "root", "left").select("root", "node", "depth", "truncated")


@query("""SELECT source AS source_id, count(DISTINCT doc_id) AS n_leads FROM documents WHERE starts_with(source, 'src1') OR contains(lower(text), 'http') GROUP BY source""")
def leak_collections(spark, sf_dir):
    """Collections told by how their id begins, else by a fragment of their label (RK4)."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("bundle_id"), F.col("doc_id").alias("hit_id"), F.col("source").alias("foreign_id"), F.col("text").alias("label"))
    hits = risk.leak_collections(d, ("src1",), ("http",))
    return hits.groupBy(F.col("bundle_id").alias("source_id")).agg(F.countDistinct("hit_id").alias("n_leads"))


_EU = "(" + ", ".join(f"'{c}'" for c in C.EU_EEA) + ")"


@query(f"""WITH {derived.SQL} SELECT jurisdiction, jurisdiction IN {_EU} OR jurisdiction IN ('GB', 'CH') AS equivalent, count(*) AS n FROM entity GROUP BY 1, 2""")
def equivalent_jurisdictions(spark, sf_dir):
    """Code sets with configured additions (ST7, RK9)."""
    j = F.col("jurisdiction")
    return derived.entities(spark, sf_dir).groupBy("jurisdiction", j.isin(*C.EU_EEA, "GB", "CH").alias("equivalent")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_quantity END AS share, strftime(l_shipdate, '%d.%m.%Y') AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN share <= 1 THEN share * 100 ELSE share END, 6) AS percent, CAST(strptime(d, '%d.%m.%Y') AS DATE)::VARCHAR AS day FROM r""")
def register_values(spark, sf_dir):
    """Proportions as percent and register dates parsed (SF20, SF21)."""
    share = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity"))
    day = F.try_to_date(F.date_format("l_shipdate", "dd.MM.yyyy"), "dd.MM.yyyy").cast("string")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.percent_of(share), 6).alias("percent"), day.alias("day"))


@query(r"""WITH t AS (SELECT p_partkey, 'E' || p_partkey || ' [' || p_size || '.0%]; E' || (p_partkey + 1) || ' [unknown %]' AS cell FROM part), x AS (SELECT p_partkey, unnest(string_split(cell, ';')) AS token FROM t)
SELECT p_partkey, regexp_extract(trim(token), '^(\S+)', 1) AS owner, TRY_CAST(regexp_extract(trim(token), '\[([0-9.]+)%\]', 1) AS DOUBLE) AS share FROM x""")
def parent_tokens(spark, sf_dir):
    """Owner cells split into id and share (SF23, SF25)."""
    k = F.col("p_partkey")
    cell = F.concat(F.lit("E"), k.cast("string"), F.lit(" ["), F.col("p_size").cast("string"), F.lit(".0%]; E"), (k + 1).cast("string"), F.lit(" [unknown %]"))
    x = table(spark, sf_dir, "part").select("p_partkey", F.explode(S.split_values(cell)).alias("token"))
    return x.select("p_partkey", F.regexp_extract("token", r"^(\S+)", 1).alias("owner"), F.regexp_extract("token", r"\[([0-9.]+)%\]", 1).try_cast("double").alias("share"))
