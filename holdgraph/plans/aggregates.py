"""Aggregations, windows and roll-ups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from holdgraph.operators import rollups as U
from holdgraph.plans.registry import query
from holdgraph.sources import derived
from holdgraph.sources import loaders as B

table = derived.table


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def latest_version(spark, sf_dir):
    """Latest version of each record, closed ones dropped (WN1, AG15, AG16)."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    e = e.withColumn("status", F.when(F.col("status") == "error", "closed").otherwise(F.col("status")))
    return U.latest_open(e, ["user_id", "status"], [F.desc("ts"), F.desc("event_id")], "status").select("user_id", F.col("status").alias("event_type"), "event_id", "value")


@query("SELECT n_name AS country, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> '' GROUP BY n_name")
def entities_per_country(spark, sf_dir):
    """Entities by country (AG1)."""
    n = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").count().join(n, F.col("c_nationkey") == n["n_nationkey"]).where("n_name <> ''").select(F.col("n_name").alias("country"), F.col("count").alias("n"))


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS k FROM customer) WHERE k > 10 AND k <= 20")
def browse_page(spark, sf_dir):
    """The second page of each country's entities by name (WN12, SK23)."""
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_name", "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("k", k).where("k > 10 AND k <= 20").select("c_nationkey", "c_custkey", "c_name")


@query("""SELECT c_nationkey, n, place, c_name FROM (SELECT c_nationkey, c_name, count(*) OVER (PARTITION BY c_nationkey) AS n, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS INTEGER) AS place FROM customer) WHERE place <= 5""")
def children_topk(spark, sf_dir):
    """Count of children and the first five by name (AG2)."""
    c = table(spark, sf_dir, "customer")
    n = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return U.top_per(c, ["c_nationkey"], ["c_name", "c_custkey"], 5).join(n, "c_nationkey").select("c_nationkey", "n", "place", "c_name")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS parent, l_suppkey AS child FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'), u AS (SELECT DISTINCT o_custkey AS parent, l_suppkey AS child FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A')
SELECT coalesce(d.parent, u.parent) AS parent, coalesce(d.child, u.child) AS child, CASE WHEN d.child IS NULL THEN 'ultimate' WHEN u.child IS NULL THEN 'direct' ELSE 'both' END AS relation FROM d FULL JOIN u ON d.parent = u.parent AND d.child = u.child""")
def relation_tag(spark, sf_dir):
    """Direct and ultimate children in one list, tagged (JN19)."""
    j = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("parent")).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("child"), "l_returnflag"), "o_orderkey")
    has = lambda flag: F.max((F.col("l_returnflag") == flag).cast("int")) == 1
    t = j.where(F.col("l_returnflag").isin("R", "A")).groupBy("parent", "child").agg(has("R").alias("direct"), has("A").alias("ultimate"))
    return t.select("parent", "child", F.when(F.col("direct") & F.col("ultimate"), "both").when(F.col("direct"), "direct").otherwise("ultimate").alias("relation"))


@query("""WITH c AS (SELECT c_nationkey, count(*) AS n_children, count(DISTINCT c_mktsegment) AS n_segments, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS n_indirect FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, n_children, n_segments, n_indirect, CASE WHEN n_children > 150 THEN 'summary' ELSE 'full' END AS mode FROM c""")
def subsidiary_summary(spark, sf_dir):
    """Subsidiary totals and how they are shown (AG6)."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_children"), F.countDistinct("c_mktsegment").alias("n_segments"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("n_indirect"))
    return c.withColumn("mode", F.when(F.col("n_children") > 150, "summary").otherwise("full"))


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS parent, l_returnflag AS tracker, l_partkey AS project, l_quantity AS share, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS bucket FROM lineitem),
s AS (SELECT parent, tracker, project, least(100, sum(share)) AS share, min(bucket) AS bucket FROM u GROUP BY ALL)
SELECT parent, tracker, count(*) AS n_live, count(CASE WHEN bucket = 0 THEN 1 END) AS n_operating, count(CASE WHEN share >= 50 THEN 1 END) AS n_controlled FROM s GROUP BY parent, tracker""")
def capped_shares(spark, sf_dir):
    """Project shares summed to a cap, best status first, totals by tracker (AG12)."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("parent"), F.col("l_returnflag").alias("tracker"), F.col("l_partkey").alias("project"), F.col("l_quantity").alias("share"), U.rank_of(["O", "F"], F.col("l_linestatus")).alias("bucket")).distinct()
    s = r.groupBy("parent", "tracker", "project").agg(F.least(F.lit(100.0), F.sum("share")).alias("share"), F.min("bucket").alias("bucket"))
    return s.groupBy("parent", "tracker").agg(F.count(F.lit(1)).alias("n_live"), F.count(F.when(F.col("bucket") == 0, 1)).alias("n_operating"), F.count(F.when(F.col("share") >= 50, 1)).alias("n_controlled"))


@query("""WITH l AS (SELECT source, doc_id % 7 AS k FROM documents), t AS (SELECT source, ['cc0', 'cc-by', 'cc-by-sa', 'cc-by-nc', 'odbl', 'unknown', 'mit'][k + 1] AS licence, [0, 1, 2, 5, 3, 4, 1][k + 1] AS r FROM l)
SELECT source, max_r, licence, CASE WHEN max_r = 5 THEN 'no' WHEN max_r = 4 THEN 'conditional' ELSE 'yes' END AS commercial, share_alike FROM (
  SELECT source, licence, r, max(r) OVER (PARTITION BY source) AS max_r, bool_or(licence IN ('cc-by-sa', 'odbl')) OVER (PARTITION BY source) AS share_alike, row_number() OVER (PARTITION BY source ORDER BY r DESC, licence) AS k FROM t) WHERE k = 1""")
def licence_rollup(spark, sf_dir):
    """Most restrictive licence of contributing records, commercial use and share-alike (AG21, AG22, SK9, SF26)."""
    k = (F.col("doc_id") % 7 + 1).cast("int")
    names = F.array(*map(F.lit, ("cc0", "cc-by", "cc-by-sa", "cc-by-nc", "odbl", "unknown", "mit")))
    rank = F.array(*map(F.lit, (0, 1, 2, 5, 3, 4, 1)))
    t = table(spark, sf_dir, "documents").select("source", F.element_at(names, k).alias("licence"), F.element_at(rank, k).alias("r"))
    worst = t.groupBy("source").agg(F.max("r").alias("max_r"), F.max(F.struct("r", F.lit(0))).alias("_"), F.max(F.col("licence").isin("cc-by-sa", "odbl").cast("int")).alias("sa"), F.min_by("licence", F.struct(-F.col("r"), "licence")).alias("licence"))
    use = F.when(F.col("max_r") == 5, "no").when(F.col("max_r") == 4, "conditional").otherwise("yes")
    return worst.select("source", "max_r", "licence", use.alias("commercial"), (F.col("sa") == 1).alias("share_alike"))


@query("""WITH p AS (SELECT user_id, event_type AS liveness, CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS s, event_id, CASE WHEN event_id % 3 = 0 THEN props END AS detail FROM events)
SELECT user_id, (list(liveness ORDER BY s DESC, liveness DESC))[1] AS liveness, min(event_id) AS oldest, (list(detail ORDER BY event_id) FILTER (detail IS NOT NULL))[1] AS detail FROM p GROUP BY user_id""")
def provenance_rollup(spark, sf_dir):
    """Worst liveness, oldest retrieval, first detail (AG23, SC28)."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("liveness"), "event_id", F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("detail"))
    severity = F.when(F.col("liveness") == "error", 4).when(F.col("liveness") == "view", 3).when(F.col("liveness") == "click", 2).otherwise(1)
    return U.provenance(e, ["user_id"], severity, "event_id", "detail", "event_id")


@query("""SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS last_open, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS last_done, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY o_custkey""")
def conditional_pivot(spark, sf_dir):
    """Rows to columns by conditional maxima (AG18)."""
    last = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(last("O").alias("last_open"), last("F").alias("last_done"), F.countDistinct("o_orderpriority").alias("n_priorities"))


@query("SELECT person, n FROM (SELECT o_custkey AS person, count(DISTINCT l_suppkey) AS n, row_number() OVER (ORDER BY count(DISTINCT l_suppkey) DESC, o_custkey) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey) WHERE k <= 5")
def busiest_people(spark, sf_dir):
    """The five with most companies (AG19)."""
    j = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person")).join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey")
    return U.busiest(j, "person", "l_suppkey", 5)


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS kind, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS n_ceased FROM events GROUP BY 1, 2""")
def event_mix(spark, sf_dir):
    """Event mix by type and kind (AG29)."""
    kind = F.get_json_object("props", "$.k").cast("long") % 10
    return U.tallied(table(spark, sf_dir, "events"), ["event_type", kind.alias("kind")], F.col("value") > 50)


@query("""WITH t AS (SELECT threshold FROM (VALUES (0.2), (0.5), (0.8)) AS v(threshold)), p AS (SELECT value / 100 AS score, event_type = 'purchase' AS good FROM events WHERE event_type <> 'error')
SELECT CAST(threshold AS DOUBLE) AS threshold, round(count(CASE WHEN good AND score >= threshold THEN 1 END) / nullif(count(CASE WHEN score >= threshold THEN 1 END), 0), 9) AS precision, round(count(CASE WHEN good AND score >= threshold THEN 1 END) / count(CASE WHEN good THEN 1 END), 9) AS recall FROM p, t GROUP BY threshold""")
def gate_quality(spark, sf_dir):
    """Precision and recall of a gate over thresholds (AG27)."""
    p = table(spark, sf_dir, "events").select((F.col("value") / 100).alias("score"), F.when(F.col("event_type") != "error", F.col("event_type") == "purchase").alias("good"))
    return U.gate_quality(p, "score", "good", [0.2, 0.5, 0.8]).select("threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS total, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS total_urgent FROM orders GROUP BY 1""")
def payments_by_year(spark, sf_dir):
    """Payments by year, one kind apart (AG14, AG11)."""
    out = U.paid(table(spark, sf_dir, "orders"), F.year("o_orderdate"), "o_totalprice", F.col("o_orderpriority") == "1-URGENT")
    return out.select("year", F.round("total", 2).alias("total"), F.round("total_apart", 2).alias("total_urgent"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda t: t <> ''))) AS token FROM documents)
SELECT token, n FROM (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS k FROM t GROUP BY token) WHERE k <= 40""")
def token_frequency(spark, sf_dir):
    """The forty most frequent tokens over distinct names (AG26)."""
    words = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]+", " ")), " "), lambda t: t != ""))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(40)


@query("""WITH r AS (SELECT user_id, event_id, event_type, value FROM events)
SELECT user_id, count(DISTINCT event_type) AS n_roles, CASE max(CASE WHEN value > 90 THEN 3 WHEN value > 50 THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS roles, (list(event_id ORDER BY event_id) FILTER (event_id % 2 = 1))[1] AS first_share FROM r GROUP BY user_id""")
def association_summary(spark, sf_dir):
    """A person's other companies: role sets, strongest confidence, first share that is there (AG7-AG10, WN10)."""
    level = F.when(F.col("value") > 90, 3).when(F.col("value") > 50, 2).otherwise(1)
    e = table(spark, sf_dir, "events").withColumn("share", F.when(F.col("event_id") % 2 == 1, F.col("event_id")))
    return U.associations(e, ["user_id"], "event_type", level, "share", "event_id")


@query("""WITH o AS (SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem), x AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT c_nationkey AS nation, s_nationkey = c_nationkey AS home, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT o_custkey) AS n_customers FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def twin_join(spark, sf_dir):
    """Distinct counts over a join of four tables."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = o.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey")
    return j.groupBy("nation", (F.col("nation") == F.col("s_nationkey")).alias("home")).agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("o_custkey").alias("n_customers"))


@query("""WITH f AS (SELECT p_partkey, unnest([struct_pack(form := CAST(p_partkey AS VARCHAR), k := 0), struct_pack(form := ltrim(lpad(CAST(p_size AS VARCHAR), 4, '0'), '0'), k := 1)]) AS f FROM part),
i AS (SELECT CAST(s_suppkey AS VARCHAR) AS form, s_name FROM supplier)
SELECT p_partkey, s_name, CAST(k AS INTEGER) AS form_rank FROM (SELECT p_partkey, s_name, f.k AS k, row_number() OVER (PARTITION BY p_partkey ORDER BY f.k) AS r FROM f JOIN i ON i.form = f.f.form) WHERE r = 1""")
def identifier_forms(spark, sf_dir):
    """Lookups by forms of a number: the first form that hits (JN21, JN22, ER20)."""
    form = lambda c, k: F.struct(c.alias("form"), F.lit(k).alias("form_rank"))
    forms = F.array(form(F.col("p_partkey").cast("string"), 0), form(F.ltrim(F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lit("0")), 1))
    f = table(spark, sf_dir, "part").select("p_partkey", F.inline(forms))
    i = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("form"), "s_name")
    return U.first_per(f.join(i, "form"), ["p_partkey"], ["form_rank"]).select("p_partkey", "s_name", "form_rank")


@query("""WITH m AS (SELECT o_custkey AS lei, o_orderkey AS pos, o_orderpriority AS name FROM orders), p AS (SELECT o_custkey AS lei, o_orderkey AS pos, CASE WHEN o_orderstatus = 'O' THEN 'direct' ELSE 'ultimate' END AS kind, o_totalprice AS parent FROM orders WHERE o_orderstatus <> 'P')
SELECT m.lei, (list(m.name ORDER BY m.pos DESC))[1] AS name, (SELECT (list(parent ORDER BY pos DESC))[1] FROM p WHERE p.lei = m.lei AND kind = 'direct') AS direct_parent, (SELECT (list(parent ORDER BY pos DESC))[1] FROM p WHERE p.lei = m.lei AND kind = 'ultimate') AS ultimate_parent FROM m GROUP BY m.lei""")
def master_upsert(spark, sf_dir):
    """Upserts by key: the last row wins, and the last published parent of each kind (SC11, SC12, SC20)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("parent"), F.when(F.col("o_orderstatus") == "O", "direct").otherwise("ultimate").alias("kind"), F.when(F.col("o_orderstatus") == "P", "LAPSED").otherwise("published").alias("status"))
    master = B.upserted(o.select("key", "seq", "name"), "key", "seq")
    return master.join(B.parent_links(o), "key", "left").select(F.col("key").alias("lei"), "name", "direct_parent", "ultimate_parent")


@query("""WITH s AS (SELECT p_partkey, p_brand AS lei, string_split(p_name, ' ') AS cells, p_size % 4 = 0 AS sanctioned FROM part),
x AS (SELECT lei, sanctioned, p_partkey, unnest(list_filter(cells, lambda c: c <> '')) AS isin FROM s WHERE sanctioned OR p_partkey % 2 = 0)
SELECT lei, count(DISTINCT isin) AS n_isins, bool_or(sanctioned) AS sanctioned, min(p_partkey) AS first_row FROM x GROUP BY lei""")
def securities_index(spark, sf_dir):
    """Multi-valued cells exploded and merged by key (SC21, JN17, SF25)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("lei"), F.col("p_name").alias("isins"), F.col("p_type").alias("name"), (F.col("p_size") % 4 == 0).alias("sanctioned"), (F.col("p_partkey") % 2 == 0).alias("blocked"))
    return B.securities_index(p).select("lei", "n_isins", "sanctioned", "first_row")


@query("""WITH n AS (SELECT o_custkey AS enterprise, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'fr' WHEN 'F' THEN 'nl' ELSE 'de' END AS lang, o_orderpriority AS denomination FROM orders),
b AS (SELECT enterprise, lang, (list(seq ORDER BY denomination, seq))[1] AS seq FROM n GROUP BY enterprise, lang)
SELECT enterprise, max(CASE WHEN lang = 'fr' THEN seq END) AS fr, max(CASE WHEN lang = 'nl' THEN seq END) AS nl, max(CASE WHEN lang = 'de' THEN seq END) AS de FROM b GROUP BY enterprise""")
def bilingual_names(spark, sf_dir):
    """By language the name of the lowest denomination, first row of ties (SC13, SC14)."""
    o = table(spark, sf_dir, "orders")
    lang = F.when(F.col("o_orderstatus") == "O", "fr").when(F.col("o_orderstatus") == "F", "nl").otherwise("de")
    rows = o.select(F.col("o_custkey").alias("key"), lang.alias("lang"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("name"))
    return B.preferred_names(rows, ["fr", "nl", "de"]).withColumnRenamed("key", "enterprise")


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS n_links, len(regexp_extract_all(html, '<p[^>]*>')) AS n_paragraphs, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages""")
def html_scrape(spark, sf_dir):
    """Fields scraped from pages (SC30)."""
    pages = table(spark, sf_dir, "pages")
    found = B.scraped(pages, "page_id", "html", {"link": (r'<a[^>]*href="([^"]*)"', 1), "paragraph": ("<p[^>]*>", 0), "title": ("<title>([^<]*)</title>", 1)})
    of = lambda f: F.col("field") == f
    per = found.groupBy("page_id").agg(F.count(F.when(of("link"), 1)).alias("n_links"), F.count(F.when(of("paragraph"), 1)).alias("n_paragraphs"), F.min_by("value", F.when(of("title"), F.col("place"))).alias("title"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return pages.select("page_id").join(per, "page_id", "left").select("page_id", zero("n_links"), zero("n_paragraphs"), F.nullif("title", F.lit("")).alias("title"))


@query("""WITH b AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), x AS (SELECT c_custkey AS id, c_name AS name FROM customer)
SELECT id, name, 'base' AS origin FROM b UNION ALL SELECT id, name, 'extra' FROM x WHERE id NOT IN (SELECT id FROM b)""")
def base_wins_merge(spark, sf_dir):
    """Union in which the base keeps its ids (WN16, ST1-ST4, SK4)."""
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("base").alias("origin"))
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("extra").alias("origin"))
    return U.base_wins(b, x, ["id"])
