"""Risk rules over the derived statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from holdgraph.functions import codelists as C
from holdgraph.operators import risk
from holdgraph.plans.ownership import CHAINS, EDGES
from holdgraph.plans.registry import query
from holdgraph.sources import derived, statements

_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_any = lambda column, xs: "(" + " OR ".join(f"contains(lower({column}), '{x}')" for x in xs) + ")"


def filings(spark, sf_dir):
    """Natures of control as filed: every supplier files one, a few of them nominee arrangements."""
    k = F.col("s_suppkey")
    natures = F.array(*map(F.lit, ("ownership-of-shares-25-to-50-percent", C.NOMINEE_NATURES[0], C.NOMINEE_NATURES[4])))
    return derived.table(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), (k % derived.BUNDLES).cast("string")).alias("bundle_id"), F.element_at(natures, F.when(k % 13 == 0, (k % 2 + 2).cast("int")).otherwise(1)).alias("nature"), F.when(k % 26 == 0, "2020-01-01").alias("ceased_on"))


def signals(spark, sf_dir):
    return risk.assessed(*derived.typed(spark, sf_dir), filings(spark, sf_dir))


SIGNALS = f"""{EDGES}, {CHAINS}, filing AS (
  SELECT 'b' || (s_suppkey % {derived.BUNDLES}) AS bundle_id, CASE WHEN s_suppkey % 13 <> 0 THEN 'ownership-of-shares-25-to-50-percent' WHEN s_suppkey % 2 = 0 THEN '{C.NOMINEE_NATURES[0]}' ELSE '{C.NOMINEE_NATURES[4]}' END AS nature, CASE WHEN s_suppkey % 26 = 0 THEN '2020-01-01' END AS ceased_on FROM supplier
), found AS (
  SELECT bundle_id, statement_id, unnest([
    CASE WHEN jurisdiction IN {_in(C.FATF_BLACK)} THEN struct_pack(code := 'FATF_BLACK_LIST', grade := 3, value := jurisdiction) END,
    CASE WHEN jurisdiction IN {_in(C.FATF_GREY)} THEN struct_pack(code := 'FATF_GREY_LIST', grade := 2, value := jurisdiction) END,
    CASE WHEN jurisdiction IN {_in(C.EU_HIGH_RISK)} THEN struct_pack(code := 'EU_HIGH_RISK_THIRD_COUNTRY', grade := 3, value := jurisdiction) END,
    CASE WHEN jurisdiction NOT IN {_in(C.EU_EEA)} THEN struct_pack(code := 'NON_EU_JURISDICTION', grade := 1, value := jurisdiction) END,
    CASE WHEN entity_type = 'arrangement' OR {_any("legal_form", C.TRUST_FRAGMENTS)} THEN struct_pack(code := 'TRUST_OR_ARRANGEMENT', grade := 3, value := NULL::VARCHAR) END,
    CASE WHEN entity_type = 'anonymousEntity' THEN struct_pack(code := 'OPAQUE_OWNERSHIP', grade := 3, value := NULL::VARCHAR) END]) AS m FROM entity
), match AS (
  SELECT bundle_id, statement_id, m.code AS code, m.grade AS grade, m.value AS value FROM found WHERE m IS NOT NULL
  UNION ALL SELECT bundle_id, statement_id, 'OPAQUE_OWNERSHIP', 3, NULL FROM person WHERE person_type = 'anonymousPerson'
  UNION ALL SELECT bundle_id, statement_id, 'NOMINEE', 2, NULL FROM person WHERE {_any("words", C.NOMINEE_FRAGMENTS)}
  UNION ALL SELECT bundle_id, statement_id, 'OPAQUE_OWNERSHIP', 3, NULL FROM relationship WHERE reason IN {_in(C.OPAQUE_PARTY_REASONS)}
  UNION ALL SELECT bundle_id, statement_id, 'NOMINEE', 2, NULL FROM relationship WHERE {_any("concat_ws(' ', type, details)", C.NOMINEE_FRAGMENTS)}
  UNION ALL SELECT bundle_id, nature, 'NOMINEE', 3, nature FROM filing WHERE ceased_on IS NULL AND nature IN {_in(C.NOMINEE_NATURES)}
  UNION ALL SELECT r.bundle_id, e.statement_id, 'STATE_CONTROLLED', 2, e.name FROM (SELECT DISTINCT bundle_id, party_id FROM relationship) r JOIN entity e ON e.statement_id = r.party_id AND e.entity_type IN ('state', 'stateBody')
), first AS (
  SELECT m.bundle_id, m.code, ['low', 'medium', 'high'][m.grade] AS confidence, CASE WHEN m.code = 'NON_EU_JURISDICTION' THEN 'context' ELSE 'risk' END AS kind, count(DISTINCT statement_id) AS n_matches, string_agg(DISTINCT value, ',' ORDER BY value) AS detail
  FROM match m JOIN (SELECT bundle_id, code, max(grade) AS grade FROM match GROUP BY ALL) b ON b.bundle_id = m.bundle_id AND b.code = m.code AND b.grade = m.grade GROUP BY m.bundle_id, m.code, m.grade
  UNION ALL SELECT bundle_id, 'COMPLEX_OWNERSHIP_LAYERS', 'medium', 'risk', layers, array_to_string(path, '>') FROM chain WHERE layers >= 3
), trigger AS (
  SELECT c.bundle_id, list_filter([
    CASE WHEN EXISTS (SELECT 1 FROM match m WHERE m.code = 'TRUST_OR_ARRANGEMENT' AND m.bundle_id = c.bundle_id AND list_contains(c.path, m.statement_id)) THEN 'trust/arrangement' END,
    CASE WHEN EXISTS (SELECT 1 FROM match m WHERE m.code = 'NON_EU_JURISDICTION' AND m.bundle_id = c.bundle_id AND list_contains(c.path, m.statement_id)) THEN 'non-EU jurisdiction' END,
    CASE WHEN EXISTS (SELECT 1 FROM match m WHERE m.code = 'NOMINEE' AND m.bundle_id = c.bundle_id) THEN 'nominee' END], lambda t: t IS NOT NULL) AS t FROM chain c WHERE layers >= 3
), both_ AS (
  FROM first UNION ALL SELECT bundle_id, 'COMPLEX_CORPORATE_STRUCTURE', 'high', 'risk', len(t), array_to_string(t, ', ') FROM trigger WHERE len(t) >= 2
), signal AS (FROM both_ UNION ALL
  SELECT bundle_id, 'POSSIBLE_OBFUSCATION', 'low', 'risk', count(DISTINCT code), string_agg(DISTINCT code, ',' ORDER BY code) FROM both_
  WHERE code IN ('OPAQUE_OWNERSHIP', 'COMPLEX_CORPORATE_STRUCTURE', 'COMPLEX_OWNERSHIP_LAYERS', 'NON_EU_JURISDICTION', 'NOMINEE') GROUP BY bundle_id
  HAVING bool_or(code = 'OPAQUE_OWNERSHIP') AND (bool_or(code = 'COMPLEX_CORPORATE_STRUCTURE') OR (bool_or(code = 'COMPLEX_OWNERSHIP_LAYERS') AND (bool_or(code = 'NON_EU_JURISDICTION') OR bool_or(code = 'NOMINEE')))))"""
_ALL = "SELECT bundle_id, code, confidence, kind, CAST(n_matches AS BIGINT) AS n_matches, detail FROM signal"


@query(f"WITH RECURSIVE {SIGNALS} {_ALL}")
def risk_signals(spark, sf_dir):
    """All statement rules at once (RK7-RK18, RK24)."""
    return signals(spark, sf_dir)


@query(f"WITH RECURSIVE {SIGNALS} {_ALL}")
def statement_signals(spark, sf_dir):
    """The same rules from statements as published: JSON lines parsed, typed, assessed (SC4, PF1-PF4, RK7-RK18)."""
    parsed = statements.parsed(derived.statement_lines(spark, sf_dir))
    return risk.assessed(*statements.typed(parsed), filings(spark, sf_dir))


@query(f"WITH RECURSIVE {SIGNALS} SELECT bundle_id, code, statement_id, value FROM match")
def signal_evidence(spark, sf_dir):
    """Every match behind a signal (PF15, RK25)."""
    return risk.matches_of(*derived.typed(spark, sf_dir), filings(spark, sf_dir)).select("bundle_id", "code", "statement_id", "value")


@query(f"WITH RECURSIVE {SIGNALS} SELECT code, kind, count(*) AS n, count(DISTINCT bundle_id) AS n_bundles FROM signal GROUP BY code, kind")
def signal_stats(spark, sf_dir):
    """Signals by code (AG3, AG5)."""
    return signals(spark, sf_dir).groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bundle_id").alias("n_bundles"))


_when = " ".join(f"CASE WHEN list_has_any(codes, [{', '.join(repr(c) for c in cs)}]) THEN ['{t}'] ELSE [] END," for cs, t in risk.CLAUSES)
_READ = ", ".join(repr(c) for c in (*(c for cs, _ in risk.CLAUSES for c in cs), *risk.STRUCTURE_CODES))


@query(f"""WITH RECURSIVE {SIGNALS}, lost AS (SELECT 'b' || (user_id % {derived.BUNDLES}) AS bundle_id, event_type AS source FROM events WHERE event_id % 997 = 0),
subject AS (SELECT 'b' || (c_custkey % {derived.BUNDLES + 10}) AS bundle_id FROM customer UNION SELECT 'b' || c_custkey FROM customer WHERE c_custkey BETWEEN 70 AND 90),
screened AS (SELECT bundle_id, code, kind, n_matches FROM signal WHERE bundle_id <> 'b7' UNION ALL SELECT 'b' || (event_id % {derived.BUNDLES * 2}), 'RELATED_' || CASE event_type WHEN 'purchase' THEN 'SANCTIONED' WHEN 'signup' THEN 'PEP' ELSE 'OTHER' END, 'risk', 1 FROM events WHERE event_id % 89 = 0),
per AS (SELECT bundle_id, coalesce(list(DISTINCT code) FILTER (kind = 'risk'), []) AS codes, max(CASE WHEN code = 'COMPLEX_OWNERSHIP_LAYERS' THEN n_matches END) AS depth FROM screened GROUP BY bundle_id),
said AS (SELECT s.bundle_id, coalesce(codes, []) AS codes, 'an ownership chain ' || depth || ' layers deep' AS structure, coalesce(l.n, 0) AS missing FROM subject s LEFT JOIN per USING (bundle_id) LEFT JOIN (SELECT bundle_id, count(DISTINCT source) AS n FROM lost GROUP BY 1) l USING (bundle_id)),
head AS (SELECT *, array_to_string(flatten([{_when.rstrip(',')}])[1:2], ', and ') AS head FROM said)
SELECT bundle_id, CASE WHEN head <> '' THEN upper(head[1:1]) || head[2:] || coalesce(', over ' || structure, '') || '.'
  WHEN structure IS NULL AND len(list_filter(codes, lambda c: c NOT IN ({_READ}))) > 0 THEN NULL
  ELSE CASE WHEN structure IS NOT NULL AND len(codes) > 0 THEN 'The records show ' || structure WHEN structure IS NOT NULL THEN 'No risk signals surfaced, over ' || structure WHEN missing > 0 THEN 'No risk signals surfaced' ELSE 'No risk signals surfaced across the sources that answered' END
    || CASE WHEN missing > 0 THEN ', but ' || CASE WHEN missing = 1 THEN 'one check did not run' ELSE missing || ' checks did not run' END || ' — an empty result there is not a clean screen' ELSE '' END || '.' END AS verdict FROM head""")
def verdict_sentence(spark, sf_dir):
    """One sentence a subject, over statement rules and screened parties (RK22)."""
    bundle = lambda c, n: F.concat(F.lit("b"), (c % n).cast("string")).alias("bundle_id")
    events, customer = derived.table(spark, sf_dir, "events"), derived.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    subjects = customer.select(bundle(k, derived.BUNDLES + 10)).unionByName(customer.where(k.between(70, 90)).select(F.concat(F.lit("b"), k.cast("string")).alias("bundle_id")))
    lost = events.where("event_id % 997 = 0").select(bundle(F.col("user_id"), derived.BUNDLES), F.col("event_type").alias("source"))
    code = F.concat(F.lit("RELATED_"), F.when(F.col("event_type") == "purchase", "SANCTIONED").when(F.col("event_type") == "signup", "PEP").otherwise("OTHER"))
    screened = events.where("event_id % 89 = 0").select(bundle(F.col("event_id"), 2 * derived.BUNDLES), code.alias("code"), F.lit("risk").alias("kind"), F.lit(1).cast("long").alias("n_matches"))
    found = signals(spark, sf_dir).where("bundle_id <> 'b7'").select("bundle_id", "code", "kind", "n_matches").unionByName(screened)
    return risk.verdicts(subjects, found, lost)


_TOPICS = ("role.pep", "sanction", "sanction.counter", "sanction.control", "sanction.linked", "debarment", "export.control", "export.risk", "sanction.new", "crime")


@query(f"""WITH hit AS (SELECT 'u' || user_id AS bundle_id, event_id AS hit_id, list_distinct([[{', '.join(repr(t) for t in _TOPICS)}][event_id % 10 + 1], [{', '.join(repr(t) for t in _TOPICS)}][event_id // 7 % 10 + 1]]) AS t FROM events), code AS (
  SELECT bundle_id, hit_id, unnest([CASE WHEN list_contains(t, 'role.pep') THEN 'PEP' END, CASE WHEN list_contains(t, 'sanction') THEN 'SANCTIONED' END, CASE WHEN list_contains(t, 'sanction.counter') THEN 'COUNTER_SANCTIONED' END, CASE WHEN list_contains(t, 'sanction.control') THEN 'SANCTIONS_CONTROLLED' END,
    CASE WHEN NOT list_contains(t, 'sanction.control') AND (list_contains(t, 'sanction.linked') OR list_contains(t, 'sanction.new')) THEN 'SANCTIONS_LINKED' END, CASE WHEN list_contains(t, 'debarment') THEN 'DEBARMENT' END, CASE WHEN list_contains(t, 'export.control') THEN 'EXPORT_CONTROLLED' END, CASE WHEN list_contains(t, 'export.risk') THEN 'EXPORT_RISK' END]) AS code FROM hit)
SELECT bundle_id, code, count(*) AS n FROM code WHERE code IS NOT NULL GROUP BY bundle_id, code""")
def topic_signals(spark, sf_dir):
    """Topic families of screening hits (RK1-RK3)."""
    topics = F.array(*map(F.lit, _TOPICS))
    e = derived.table(spark, sf_dir, "events")
    pick = lambda k: F.element_at(topics, (k % 10 + 1).cast("int"))
    hits = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("bundle_id"), F.col("event_id").alias("hit_id"), F.array_distinct(F.array(pick(F.col("event_id")), pick(F.floor(F.col("event_id") / 7)))).alias("topics"))
    return risk.topic_signals(hits).groupBy("bundle_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id AS bundle_id, event_type AS code, event_id AS seq, CAST(event_id % 3 AS INTEGER) AS source, CAST(value AS INTEGER) AS layers FROM events)
SELECT bundle_id, code, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, code, CASE WHEN code = 'signup' THEN -1 ELSE source END
  ORDER BY CASE WHEN code = 'signup' THEN layers END DESC NULLS LAST, CASE WHEN code = 'signup' THEN seq ELSE -seq END) AS k FROM s) WHERE k = 1""")
def signal_merge(spark, sf_dir):
    """Merging passes: the last of a key wins, but one code keeps its deepest evidence (WN6)."""
    # DuckDB rounds when it casts to an integer, halves to the even one, and puts nulls last.
    s = derived.table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), F.col("event_type").alias("code"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("source"), F.rint("value").cast("int").alias("layers"))
    deep = F.col("code") == "signup"
    s = s.withColumn("_part", F.when(deep, -1).otherwise(F.col("source")))
    return risk.merged(s, ["bundle_id", "code", "_part"], [F.when(deep, F.col("layers")).desc_nulls_last(), F.when(deep, F.col("seq")).otherwise(-F.col("seq")).asc_nulls_last()]).select("bundle_id", "code", "source", "seq")


@query("""WITH s AS (SELECT user_id AS bundle_id, event_type AS code, event_id AS seq, CAST(event_id % 3 AS INTEGER) AS rank FROM events)
SELECT bundle_id, code, rank, seq FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, code ORDER BY rank DESC, seq) AS k FROM s) WHERE k = 1""")
def signal_dedupe(spark, sf_dir):
    """Highest confidence of a key, the first of equals (WN4, WN5, WN8)."""
    s = derived.table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), F.col("event_type").alias("code"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).cast("int").alias("rank"))
    return risk.merged(s, ["bundle_id", "code"], [F.desc("rank"), F.col("seq")])


@query("""WITH s AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN event_type ELSE 'upstream' END AS source, CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'error' END AS reason FROM events),
n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT s.user_id AS bundle_id, source, count(*) AS n_failed, n.n AS n_names, CASE min(CASE reason WHEN 'rate_limited' THEN 1 WHEN 'timeout' THEN 2 ELSE 3 END) WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'timeout' ELSE 'error' END AS reason,
  CASE source WHEN 'click' THEN 'RELATED_SANCTIONED,RELATED_PEP' WHEN 'view' THEN 'RELATED_PEP' ELSE 'RELATED_PEP,RELATED_SANCTIONED' END AS codes FROM s JOIN n USING (user_id) WHERE reason IS NOT NULL GROUP BY s.user_id, source, n.n""")
def degraded_sources(spark, sf_dir):
    """Screens that did not run: for how many names, why, and which signals may be missing (RK21, AG4, AG25)."""
    e, k = derived.table(spark, sf_dir, "events"), F.col("event_id") % 4
    failures = e.select(F.col("user_id").alias("bundle_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("source"), F.when(k == 0, "timeout").when(k == 1, "rate_limited").when(k == 2, "error").alias("reason")).where("reason IS NOT NULL")
    names = e.groupBy(F.col("user_id").alias("bundle_id")).agg(F.count(F.lit(1)).alias("n_names"))
    out = risk.degraded(failures, names, {"click": ("RELATED_SANCTIONED", "RELATED_PEP"), "view": ("RELATED_PEP",)})
    return out.withColumn("codes", F.array_join("codes", ","))
