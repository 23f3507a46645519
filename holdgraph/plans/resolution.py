"""Entity resolution over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from holdgraph.functions import names
from holdgraph.functions import scalars as S
from holdgraph.lineage import shared_folder
from holdgraph.operators import graph, screening, search
from holdgraph.operators import resolution as R
from holdgraph.plans.registry import query
from holdgraph.plans.selection import _DICE
from holdgraph.sources import derived


@query("""WITH p AS (SELECT p_partkey AS hit_id, unnest([struct_pack(key := 'lei', value := CASE WHEN p_size = 1 THEN '00000000' ELSE p_brand || '-' || p_size END), struct_pack(key := 'wikidata_qid', value := CASE WHEN p_partkey % 5 = 0 THEN 'q' ELSE 'Q' END || (p_partkey % 900)), struct_pack(key := 'other', value := p_type)]) AS i FROM part)
SELECT CASE i.key WHEN 'wikidata_qid' THEN 1 ELSE 2 END AS place, i.key AS key, i.value AS value, count(*) AS n, array_to_string(list_sort(list(hit_id)), ',') AS hits FROM p
WHERE i.key IN ('lei', 'wikidata_qid') AND upper(i.value) NOT IN ('Q0', '00000000') AND (i.key <> 'wikidata_qid' OR regexp_matches(i.value, '^Q[1-9][0-9]*$')) GROUP BY 1, 2, 3 HAVING count(*) >= CASE i.key WHEN 'lei' THEN 2 ELSE 1 END""")
def identifier_bridge(spark, sf_dir):
    """Hits that share a strong identifier, without placeholders and misshapen numbers (ER1, JN11)."""
    k = F.col("p_partkey")
    qid = F.concat(F.when(k % 5 == 0, "q").otherwise("Q"), (k % 900).cast("string"))
    m = F.create_map(F.lit("lei"), F.when(F.col("p_size") == 1, "00000000").otherwise(F.concat_ws("-", "p_brand", "p_size")), F.lit("wikidata_qid"), qid, F.lit("other"), F.col("p_type"))
    hits = derived.table(spark, sf_dir, "part").select(k.alias("hit_id"), m.alias("identifiers"))
    return R.strong_bridges(hits, {"wikidata_qid": 1, "lei": 2}).select("place", "key", "value", "n", F.array_join(F.transform("hits", lambda h: h.cast("string")), ",").alias("hits"))


@query("""WITH h AS (SELECT p_partkey AS hit_id, lower(p_type || ' ' || p_brand) AS name, p_partkey % 50 = 3 AS stub FROM part WHERE p_partkey % 7 <> 0),
k AS (SELECT hit_id, stub, trim(regexp_replace(regexp_replace(name, '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS key FROM h)
SELECT key, count(*) AS n, min(hit_id) AS first FROM k GROUP BY key HAVING count(*) >= 2 AND NOT bool_or(stub)""")
def weak_bridge(spark, sf_dir):
    """Persons of one name that nothing stronger links (ER2)."""
    p = derived.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    hits = p.select(k.alias("hit_id"), F.lit("person").alias("kind"), F.concat_ws(" ", "p_type", "p_brand").alias("name"), (k % 50 == 3).alias("is_stub"))
    out = R.weak_bridges(hits, p.where(k % 7 == 0).select(k.alias("hit_id")))
    return out.select("key", F.size("hits").cast("long").alias("n"), F.array_min("hits").alias("first"))


@query("""WITH e AS (SELECT p_partkey AS id, unnest(list_distinct([lower(p_type) || CASE WHEN p_partkey % 2 = 0 THEN ' x' ELSE '' END, replace(lower(p_type), ' ', '')])) AS name_key, p_brand AS jurisdiction, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 10 END AS year, ['K:' || (p_partkey % 11)] AS keys FROM part)
SELECT DISTINCT x.id AS a, y.id AS b FROM e x JOIN e y ON x.name_key = y.name_key AND x.jurisdiction = y.jurisdiction AND x.id < y.id AND (x.year IS NULL OR y.year IS NULL OR x.year = y.year) AND NOT list_has_any(x.keys, y.keys)""")
def same_name_pairs(spark, sf_dir):
    """Possibly the same: a name and the jurisdiction agree, nothing conflicts (ER3, JN12)."""
    k = F.col("p_partkey")
    names_ = F.array(F.concat(F.lower("p_type"), F.when(k % 2 == 0, " x").otherwise("")), F.regexp_replace(F.lower("p_type"), " ", ""))
    e = derived.table(spark, sf_dir, "part").select(k.alias("id"), names_.alias("name_keys"), F.col("p_brand").alias("jurisdiction"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 10).alias("year"), F.array(F.concat(F.lit("K:"), (k % 11).cast("string"))).alias("keys"))
    return R.possibly_same(e)


@query("""WITH RECURSIVE k AS (SELECT s_suppkey AS id, unnest(['A:' || (s_suppkey % 37), 'B:' || (s_suppkey // 5)]) AS key FROM supplier),
link AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key),
reach(id, r) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.id)
SELECT id, min(r) AS canonical FROM reach GROUP BY id""")
def entity_merge(spark, sf_dir):
    """Entities merged over shared identifier keys: entity and key are the two sides of the graph (ER5, GR8)."""
    s = derived.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    keys = F.array(F.concat(F.lit("A:"), (F.col("id") % 37).cast("string")), F.concat(F.lit("B:"), F.floor(F.col("id") / 5).cast("string")))
    links = s.select(F.lpad(F.col("id").cast("string"), 12, "0").alias("a"), F.explode(keys).alias("b"))
    parts = graph.components(links)
    return parts.where("node NOT LIKE '%:%'").select(F.col("node").cast("long").alias("id"), F.col("component").cast("long").alias("canonical"))


_IDS = """ids AS (SELECT p_partkey AS id, unnest([struct_pack(scheme := 'XI-LEI', id := printf('L%017d00', p_partkey % 500)), struct_pack(scheme := 'GB-COH', id := 'c' || p_size), struct_pack(scheme := 'GB-VAT', id := 'v' || p_size), struct_pack(scheme := '', id := CASE WHEN p_partkey % 3 = 0 THEN 'gb/' || p_size ELSE 'c' || p_size END)]) AS i FROM part),
keyed AS (SELECT id, 'LEI:' || upper(i.id) AS key FROM ids WHERE i.scheme = 'XI-LEI' UNION SELECT id, i.scheme || ':' || upper(i.id) FROM ids WHERE i.scheme <> 'XI-LEI' UNION SELECT id, 'JUR:GB:' || upper(i.id) FROM ids WHERE i.scheme IN ('GB-COH', '') AND NOT contains(i.id, '/'))"""


def _identified(spark, sf_dir):
    ident = lambda scheme, c: F.struct(c.alias("id"), F.lit(scheme).alias("scheme"))
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    ids = F.array(ident("XI-LEI", F.format_string("L%017d00", k % 500)), ident("GB-COH", F.concat(F.lit("c"), size)), ident("GB-VAT", F.concat(F.lit("v"), size)), ident("", F.when(k % 3 == 0, F.concat(F.lit("gb/"), size)).otherwise(F.concat(F.lit("c"), size))))
    return derived.table(spark, sf_dir, "part").withColumn("ids", ids)


@query(f"WITH {_IDS} SELECT key, count(*) AS n FROM keyed GROUP BY key")
def merge_keys(spark, sf_dir):
    """Merge keys of identifiers, without those that aren't registers (ER4)."""
    return _identified(spark, sf_dir).select(F.explode(R.merge_keys(F.col("ids"), F.lit("gb"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS k, 'e' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, 's' || (c_custkey % 4) AS source, ['GB-COH:' || (c_custkey // 3), 'GB-VAT:' || (c_custkey // 7)] AS keys, CASE WHEN c_custkey % 9 = 0 THEN ['LEI:' || printf('A%017d00', c_custkey)] ELSE [] END AS lei FROM customer),
x AS (SELECT k, id, unnest(list_concat([keys[1], 'JUR:GB:' || split_part(keys[1], ':', 2)], lei)) AS key FROM e), link AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.key = b.key),
reach(id, r) AS (SELECT id, id FROM e UNION SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.id), part AS (SELECT id, min(r) AS p FROM reach GROUP BY id),
name_ AS (SELECT p, 'recon:' || coalesce(min(CASE WHEN starts_with(key, 'LEI:') THEN key END), min(key)) AS canonical FROM part JOIN x USING (id) GROUP BY p), of AS (SELECT id, canonical FROM part JOIN name_ USING (p)),
one AS (SELECT canonical, coalesce(min_by(name, k) FILTER (name <> ''), canonical) AS name, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM e JOIN of USING (id) GROUP BY canonical),
r AS (SELECT 'e' || o_custkey AS subject, 'e' || (o_custkey + 1) AS party, o_orderstatus AS types, 's' || (o_orderkey % 3) AS source FROM orders),
l AS (SELECT coalesce(s.canonical, subject) AS subject, coalesce(p.canonical, party) AS party, types, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM r LEFT JOIN of s ON s.id = subject LEFT JOIN of p ON p.id = party GROUP BY 1, 2, 3)
SELECT 'entity' AS kind, canonical AS a, name AS b, n, sources FROM one UNION ALL SELECT 'link', subject, party || ' ' || types, 1, sources FROM l""")
def merged_network(spark, sf_dir):
    """Entities merged over their keys with attributes and sources, relationships between them once (ER5)."""
    k = F.col("c_custkey")
    ident = lambda scheme, c: F.struct(c.alias("id"), F.lit(scheme).alias("scheme"))
    ids = F.array_compact(F.array(ident("GB-COH", F.floor(k / 3).cast("string")), F.when(k % 9 == 0, ident("XI-LEI", F.format_string("A%017d00", k)))))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = derived.table(spark, sf_dir, "customer").select(k.alias("seq"), text("e", k).alias("statement_id"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.lit("GB").alias("jurisdiction"), F.lit("registeredEntity").alias("entity_type"), F.lit("").alias("founding_date"), ids.alias("identifiers"), text("s", k % 4).alias("source"))
    o = F.col("o_custkey")
    r = derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), text("e", o).alias("subject_id"), text("e", o + 1).alias("party_id"), F.col("o_orderstatus").alias("types"), text("s", F.col("o_orderkey") % 3).alias("source"))
    one, links = R.merged_network(e, r)
    out = one.select(F.lit("entity").alias("kind"), F.col("canonical_id").alias("a"), F.col("name").alias("b"), F.col("n_members").alias("n"), F.array_join("sources", ",").alias("sources"))
    return out.unionByName(links.select(F.lit("link").alias("kind"), F.col("subject_id").alias("a"), F.concat_ws(" ", "party_id", "types").alias("b"), F.lit(1).cast("long").alias("n"), F.array_join("sources", ",").alias("sources")))


_A, _B = "list_filter(string_split(lower(x.p_name), ' '), lambda t: t <> '')", "list_filter(string_split(lower(y.p_name), ' '), lambda t: t <> '')"
_HARD = lambda t: f"list_sort(list_distinct(list_filter({t}, lambda q: length(q) = 1 OR regexp_matches(q, '^[0-9]+$'))))"
_COVER = lambda s, t: f"len(list_filter({s}, lambda u: len(list_filter({t}, lambda v: u = v OR (length(u) >= 4 AND levenshtein(u, v) <= 1))) > 0)) = len({s})"


@query(f"""WITH q AS (SELECT p_partkey, p_name, p_brand, p_size FROM part)
SELECT x.p_partkey AS a, y.p_partkey AS b FROM q x JOIN q y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey
WHERE {_HARD(_A)} = {_HARD(_B)} AND CASE WHEN len({_A}) <= len({_B}) THEN {_COVER(_A, _B)} ELSE {_COVER(_B, _A)} END""")
def token_gate(spark, sf_dir):
    """Agreement on distinctive tokens within blocks (ER7)."""
    p = derived.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.filter(F.split(F.lower("p_name"), " "), lambda t: t != "").alias("t"))
    q = p.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", F.col("t").alias("u"))
    return p.withColumnRenamed("p_partkey", "a").join(q, ["p_brand", "p_size"]).where("a < b").where(S.token_gate(F.col("t"), F.col("u"))).select("a", "b")


@query()
def name_screening(spark, sf_dir):
    """Names of suppliers against customers, blocked on tokens, scored and graded (ER6, ER8-ER10, ER12, JN13).
    DuckDB has no sequence matcher, so tests hold the score."""
    c = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.col("c_name").alias("a_name"))
    s = derived.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), F.regexp_replace("s_name", "Supplier", "Customer").alias("b_name"))
    block = lambda df, n: df.withColumn("block", F.filter(names.distinctive_tokens(n), lambda t: ~t.isin("customer")))
    return R.screened(R.blocked_pairs(block(c, "a_name"), block(s, "b_name"), "block")).select("a", "b", F.round("score", 6).alias("score"), "confidence")


def _persons(spark, sf_dir):
    """Persons of small bundles: every one stands twice, the second time under another form of its name."""
    k = F.col("c_custkey")
    base = derived.table(spark, sf_dir, "customer").select(k, F.floor(k / 4).alias("bundle"), F.concat_ws(" ", F.lower("c_mktsegment"), (k % 100).cast("string"), F.lit("von"), F.lower("c_mktsegment")).alias("name"), (k % 5).alias("step"))
    second = F.when(k % 3 == 0, F.regexp_replace("name", "^([a-z])[a-z]+", "$1")).when(k % 3 == 1, F.regexp_replace("name", " von", "")).otherwise(F.col("name"))
    row = lambda n, name, born: F.struct((k * 2 + n).alias("id"), name.alias("name"), born.cast("int").alias("birth_year"), F.array((k % 7).cast("string")).alias("companies"), F.array(F.concat(F.lit("id"), (k + n * (k % 2)).cast("string"))).alias("keys"))
    return base.select("bundle", F.inline(F.array(row(0, F.col("name"), 1950 + k % 50), row(1, second, 1950 + k % 50 + F.col("step") % 3)))).withColumn("nationality", F.lit("xx"))


_PERSONS = """base AS (SELECT c_custkey AS k, c_custkey // 4 AS bundle, lower(c_mktsegment) || ' ' || (c_custkey % 100) || ' von ' || lower(c_mktsegment) AS name FROM customer),
person_ AS (SELECT bundle, k * 2 AS id, name, 1950 + k % 50 AS born, [CAST(k % 7 AS VARCHAR)] AS companies, ['id' || k] AS keys FROM base
  UNION ALL SELECT bundle, k * 2 + 1, CASE k % 3 WHEN 0 THEN regexp_replace(name, '^([a-z])[a-z]+', '\\1') WHEN 1 THEN regexp_replace(name, ' von', '') ELSE name END, 1950 + k % 50 + k % 5 % 3, [CAST(k % 7 AS VARCHAR)], ['id' || (k + k % 2)] FROM base),
pair AS (SELECT x.id AS i, y.id AS j, x.name AS a, y.name AS b, abs(x.born - y.born) AS years, list_has_any(x.companies, y.companies) AS company, list_has_any(x.keys, y.keys) AS shared FROM person_ x JOIN person_ y ON x.bundle = y.bundle AND x.id < y.id),
tok AS (SELECT *, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb, """ + _DICE + """ AS dice FROM pair),
few AS (SELECT *, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS few, CASE WHEN len(ta) <= len(tb) THEN tb ELSE ta END AS many FROM tok),
rung AS (SELECT *, CASE WHEN a = b THEN 1.0 WHEN list_sort(ta) = list_sort(tb) THEN 0.97
  WHEN len(few) >= 2 AND few[1][1] = many[1][1] AND few[-1] = many[-1] AND len(list_filter(few, lambda x: len(list_filter(many, lambda m: m = x OR (length(x) = 1 AND m[1] = x) OR (length(m) = 1 AND x[1] = m))) > 0)) = len(few) THEN 0.9
  WHEN dice >= 0.8 THEN 0.8 WHEN dice >= 0.6 THEN 0.6 ELSE dice END AS ladder FROM few),
score_ AS (SELECT i, j, shared OR (ladder >= 0.9 AND years = 0) AS high, CASE WHEN shared THEN greatest(raw, 0.95) ELSE raw END AS score FROM (SELECT *, CASE WHEN years > 1 THEN least(total, 0.7) ELSE least(total, 1.0) END AS raw FROM (SELECT *, ladder + CASE WHEN years = 0 THEN 0.1 ELSE 0 END + 0.05 + CASE WHEN company THEN 0.05 ELSE 0 END AS total FROM rung)))"""


@query(f"WITH {_PERSONS} SELECT i AS a, j AS b, round(score, 6) AS score, high FROM score_ WHERE score >= 0.62")
def person_scores(spark, sf_dir):
    """Pair scores of a bundle's persons: the ladder, bonuses, caps and floors (ER11, ER16, ER18, JN14, JN15)."""
    return screening.person_pairs(_persons(spark, sf_dir), "bundle").withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_PERSONS}, kept AS (SELECT i AS a, j AS b, high FROM score_ WHERE score >= 0.62), two AS (SELECT a, b FROM kept UNION SELECT b, a FROM kept),
reach(node, r) AS (SELECT a, a FROM two UNION SELECT two.a, reach.r FROM reach JOIN two ON two.b = reach.node), part AS (SELECT node, min(r) AS cluster FROM reach GROUP BY node)
SELECT p.node, p.cluster, s.high FROM part p JOIN (SELECT cluster, bool_or(high) AS high FROM kept JOIN part ON part.node = kept.a GROUP BY cluster) s USING (cluster)""")
def person_clusters(spark, sf_dir):
    """Persons clustered over kept pairs, sure where any pair is (ER17)."""
    return screening.person_clusters(screening.person_pairs(_persons(spark, sf_dir), "bundle"))


@query(r"""WITH p AS (SELECT p_partkey, p_size, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda t: t <> '')) AS a, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda t: t <> '')) AS b FROM part)
SELECT p_partkey, CASE WHEN p_size = p_partkey % 50 THEN 'high' WHEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM p""")
def address_tiers(spark, sf_dir):
    """Postal point, equal text, token Jaccard (ER21, SF27)."""
    tier = S.address_tier(F.col("p_size"), F.col("p_partkey") % 50, F.col("p_name"), F.concat_ws(" ", "p_type", "p_name"))
    return derived.table(spark, sf_dir, "part").select("p_partkey", tier.alias("tier"))


@query("""WITH h AS (SELECT user_id, event_id % 40 AS hit, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS strategy, event_id FROM events),
b AS (SELECT *, min(strategy) OVER (PARTITION BY user_id) AS best FROM h)
SELECT user_id, hit, CAST(strategy AS INTEGER) AS strategy, min(event_id) AS event_id FROM b WHERE strategy = best GROUP BY user_id, hit, strategy""")
def search_strategies(spark, sf_dir):
    """The first search strategy with any hit wins (ER22)."""
    order = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 4).otherwise(5)
    h = derived.table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("hit"), order.alias("strategy"), "event_id")
    return R.first_strategy(h, "user_id", "strategy", "hit", F.col("event_id"))


@query("""WITH h AS (SELECT user_id AS g, event_id % 25 AS id, event_type AS variant, CAST(floor(value) AS BIGINT) AS rank FROM events),
v AS (SELECT g, id, count(DISTINCT variant) AS votes, min(rank) AS best FROM h GROUP BY g, id)
SELECT "group", id, votes, best, place FROM (SELECT g AS "group", id, votes, best, row_number() OVER (PARTITION BY g ORDER BY votes DESC, best, id) AS place FROM v) WHERE place <= 5""")
def vote_rank(spark, sf_dir):
    """Relaxed search: votes of query variants, then best rank (WN3)."""
    h = derived.table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), (F.col("event_id") % 25).alias("id"), F.col("event_type").alias("variant"), F.floor("value").alias("rank"))
    return R.votes(h, 5)


_FORMS = ("", " Ltd", " Public Limited Company", " P.L.C.", " GmbH & Co. KG", " limited liability company", " (ООО)")
_CLASSES = ("", " llc", " jsc", " jsc", " lp", " llc", " llc")


@query(f"""WITH e AS (SELECT p_partkey AS id, p_brand AS jurisdiction, p_size % 4 AS year, lower(p_name) || {list(_CLASSES)!r}[p_partkey % {len(_CLASSES)} + 1] AS key FROM part)
SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.key = y.key AND x.jurisdiction = y.jurisdiction AND x.id < y.id AND x.year = y.year""")
def comparable_pairs(spark, sf_dir):
    """Possibly the same by names whose legal forms compare across countries (ER3, ER8)."""
    k = F.col("p_partkey")
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, _FORMS)), (k % len(_FORMS) + 1).cast("int")))
    e = derived.table(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"), F.col("p_brand").alias("jurisdiction"), (F.col("p_size") % 4).alias("year"), F.array(F.concat(F.lit("K:"), k.cast("string"))).alias("keys"))
    return R.possibly_same(R.with_name_keys(e))


_QUERIES = "['customer 000000' || (r_regionkey + 11), 'Customer', '00000001' || r_regionkey || ' cust', 'customer 9999999', '00000001' || r_regionkey || ', Customer#', 'c 00000001']"


def _search_sql(table: str, key: str, name: str, queries: str) -> str:
    plain = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""q AS (SELECT r_regionkey AS query_id, unnest({queries}) AS query FROM region), t AS (SELECT *, {plain('query')} AS asked FROM q),
n AS (SELECT {key} AS id, {name} AS name, {plain(name)} AS plain FROM {table}),
phrase AS (SELECT query_id, query, id, name, 'phrase' AS how FROM t JOIN n ON contains(' ' || plain || ' ', ' ' || asked || ' ')),
prefix AS (SELECT query_id, query, id, name, 'prefix' AS how FROM t JOIN n ON len(list_filter(string_split(asked, ' '), lambda a: len(list_filter(string_split(plain, ' '), lambda h: starts_with(h, a))) = 0)) = 0 WHERE (query_id, query) NOT IN (SELECT (query_id, query) FROM phrase)),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY name, id) AS place FROM (FROM phrase UNION ALL FROM prefix))"""


@query(f"WITH {_search_sql('customer', 'c_custkey', 'c_name', _QUERIES)} SELECT query_id, query, id AS c_custkey, how, CAST(place AS INTEGER) AS place FROM found WHERE place <= 20")
def prefix_search(spark, sf_dir):
    """Search over a written token index: phrases, then beginnings of tokens, the first twenty of each question
    (SC5, SC6)."""
    k = F.col("r_regionkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    asked = F.array(text("customer 000000", k + 11), F.lit("Customer"), text("00000001", k, " cust"), F.lit("customer 9999999"), text("00000001", k, ", Customer#"), F.lit("c 00000001"))
    q = derived.table(spark, sf_dir, "region").select(k.alias("query_id"), F.explode(asked).alias("query"))
    path = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    search.write_index(derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), path)
    return search.search(q, path).select("query_id", "query", F.col("id").alias("c_custkey"), "how", "place")


_NAMED = "(SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) ELSE s_name END AS first_ FROM supplier)"
_ASKED = "['supplier 00000000' || r_regionkey, '00000001', '00000001' || r_regionkey]"


@query(f"""WITH {_search_sql(_NAMED, 's_suppkey', 'first_', _ASKED)}
SELECT query_id, query, id, name, how, CAST(place AS INTEGER) AS place, CASE WHEN id % 4 <> 0 THEN 'n' || s_nationkey END AS nationality FROM found JOIN supplier ON s_suppkey = id WHERE place <= 20""")
def person_search(spark, sf_dir):
    """Persons by their first name that isn't blank, with their nationality (SC7)."""
    s, k = derived.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    names_ = s.select(k.alias("id"), F.inline(F.array(F.struct(F.lit(0).alias("place"), F.when(k % 3 == 0, " ").otherwise(F.col("s_name")).alias("name")), F.struct(F.lit(1).alias("place"), F.lower("s_name").alias("name")))))
    nations = s.where("s_suppkey % 4 <> 0").select(k.alias("id"), F.lit(0).alias("place"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("nationality"))
    path = f"{shared_folder(spark)}/persons-{uuid.uuid4().hex}"
    search.write_index(search.person_names(s.select(k.alias("id")), names_, nations), path)
    r = F.col("r_regionkey").cast("string")
    asked = F.array(F.concat(F.lit("supplier 00000000"), r), F.lit("00000001"), F.concat(F.lit("00000001"), r))
    q = derived.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.explode(asked).alias("query"))
    return search.search(q, path).select("query_id", "query", "id", "name", "how", "place", "nationality")
