"""Risk rules over typed statements of all bundles at once.

Rules find matches (bundle_id, code, grade, statement_id, value): one pass over the entities, one over the
persons, one over the relationships' interests. A signal is what a bundle's matches of one code say
together: bundle_id, code, confidence, kind, n_matches, detail; so a code comes once a bundle.

entities: bundle_id, statement_id, name, entity_type, legal_form (array), jurisdiction.
persons: bundle_id, statement_id, person_type, words (names and details).
interests: bundle_id, statement_id, subject_id, party_id, party_kind, reason, description, type, details; one
row an interest, one for a relationship without any.
filings: bundle_id, nature, ceased_on; natures of control as filed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph.functions import codelists as C
from holdgraph.lineage import written
from holdgraph.operators import cycles

MATCH = ("bundle_id", "code", "grade", "statement_id", "value")
GRADES = ("low", "medium", "high")
CONTEXT = ("NON_EU_JURISDICTION", "GLEIF_REPORTING_EXCEPTION")
LEAST_LAYERS = 3


def contains_any(text: Column, fragments: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(f) for f in fragments))


def _grade(name: str) -> Column:
    return F.lit(GRADES.index(name))


def _match(df: DataFrame, code: str, grade: str, value: Column | None = None, statement: str = "statement_id") -> DataFrame:
    value = F.lit(None).cast("string") if value is None else value
    return df.select("bundle_id", F.lit(code).alias("code"), _grade(grade).alias("grade"), F.col(statement).alias("statement_id"), value.alias("value"))


def entity_matches(entities: DataFrame, equivalent: tuple[str, ...] = C.EU_EEA) -> DataFrame:
    """Watch lists (black before grey), jurisdictions outside the EU, the EEA or what counts as equivalent,
    arrangements and legal forms that say trust or the like (names are not looked at), withheld entities."""
    j = F.upper("jurisdiction")
    trust = (F.col("entity_type") == "arrangement") | F.exists(F.coalesce("legal_form", F.array().cast("array<string>")), lambda f: contains_any(f, C.TRUST_FRAGMENTS))
    say = lambda when, code, grade, value=None: F.when(when, F.struct(F.lit(code).alias("code"), _grade(grade).alias("grade"), (F.lit(None).cast("string") if value is None else value).alias("value")))
    found = F.array(
        say(j.isin(*C.FATF_BLACK), "FATF_BLACK_LIST", "high", j),
        say(j.isin(*C.FATF_GREY) & ~j.isin(*C.FATF_BLACK), "FATF_GREY_LIST", "medium", j),
        say(j.isin(*C.EU_HIGH_RISK), "EU_HIGH_RISK_THIRD_COUNTRY", "high", j),
        say((j != "") & ~j.isin(*equivalent), "NON_EU_JURISDICTION", "low", j),
        say(trust, "TRUST_OR_ARRANGEMENT", "high"),
        say(F.col("entity_type") == "anonymousEntity", "OPAQUE_OWNERSHIP", "high"),
    )
    return entities.select("bundle_id", "statement_id", F.inline(F.array_compact(found))).select(*MATCH)


def person_matches(persons: DataFrame) -> DataFrame:
    """Withheld persons, and persons whose names or details speak of nominees."""
    return _match(persons.where("person_type = 'anonymousPerson'"), "OPAQUE_OWNERSHIP", "high").unionByName(_match(persons.where(contains_any(F.col("words"), C.NOMINEE_FRAGMENTS)), "NOMINEE", "medium"))


def interest_matches(interests: DataFrame) -> DataFrame:
    """Parties left open for want of an answer, and interests that speak of nominees."""
    nominee = contains_any(F.concat_ws(" ", "type", "details"), C.NOMINEE_FRAGMENTS)
    return _match(interests.where(F.col("reason").isin(*C.OPAQUE_PARTY_REASONS)), "OPAQUE_OWNERSHIP", "high").unionByName(_match(interests.where(nominee), "NOMINEE", "medium"))


def filed_nominees(filings: DataFrame) -> DataFrame:
    """Nominee arrangements that the register itself filed, ceased ones left out; a filing has no statement."""
    now = filings.where(F.col("ceased_on").isNull() & F.lower(F.trim("nature")).isin(*C.NOMINEE_NATURES))
    return _match(now, "NOMINEE", "high", F.col("nature"), "nature")


def state_matches(entities: DataFrame, interests: DataFrame) -> DataFrame:
    """Interested parties that are a state or state body."""
    state = entities.where(F.col("entity_type").isin("state", "stateBody")).select("bundle_id", F.col("statement_id").alias("party_id"), F.coalesce("name", "statement_id").alias("name"))
    return _match(interests.select("bundle_id", "party_id").distinct().join(state, ["bundle_id", "party_id"]), "STATE_CONTROLLED", "medium", F.col("name"), "party_id")


def ownership(entities: DataFrame, interests: DataFrame) -> DataFrame:
    """Edges (bundle_id, owner_id, subject_id) between entities; persons end a chain."""
    node = entities.select("bundle_id", "statement_id").distinct()
    edge = interests.where(F.col("party_kind").isNull() | (F.col("party_kind") == "entity")).select("bundle_id", F.col("party_id").alias("owner_id"), "subject_id").distinct()
    for side in ("owner_id", "subject_id"):
        edge = edge.join(node.withColumnRenamed("statement_id", side), ["bundle_id", side], "left_semi")
    return edge


def signals_of(matches: DataFrame) -> DataFrame:
    """One signal a bundle and code, of the matches of its best grade: a filed arrangement stands for itself,
    and texts count only where there is none."""
    at = matches.groupBy("bundle_id", "code", "grade").agg(F.countDistinct("statement_id").alias("n"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("detail"))
    best = at.groupBy("bundle_id", "code").agg(F.max(F.struct("grade", "n", "detail")).alias("b"))
    kind = F.when(F.col("code").isin(*CONTEXT), "context").otherwise("risk")
    return best.select("bundle_id", "code", F.element_at(F.array(*map(F.lit, GRADES)), F.col("b.grade") + 1).alias("confidence"), kind.alias("kind"), F.col("b.n").alias("n_matches"), F.nullif("b.detail", F.lit("")).alias("detail"))


def _derived(df: DataFrame, code: str, confidence: str, n: Column, detail: Column) -> DataFrame:
    return df.select("bundle_id", F.lit(code).alias("code"), F.lit(confidence).alias("confidence"), F.lit("risk").alias("kind"), n.cast("long").alias("n_matches"), detail.cast("string").alias("detail"))


def layers(chains: DataFrame) -> DataFrame:
    return _derived(chains.where(F.col("layers") >= LEAST_LAYERS), "COMPLEX_OWNERSHIP_LAYERS", "medium", F.col("layers"), F.array_join("path", ">"))


def complex_structure(chains: DataFrame, matches: DataFrame) -> DataFrame:
    """Layers, and two of: a trust on the path, a jurisdiction outside the EU on the path, a nominee anywhere
    in the bundle."""
    deep = chains.where(F.col("layers") >= LEAST_LAYERS)
    on = deep.select("bundle_id", F.explode("path").alias("statement_id")).join(matches.where(F.col("code").isin("TRUST_OR_ARRANGEMENT", "NON_EU_JURISDICTION")).select("bundle_id", "statement_id", "code"), ["bundle_id", "statement_id"]).select("bundle_id", "code")
    said = on.unionByName(matches.where("code = 'NOMINEE'").select("bundle_id", "code")).groupBy("bundle_id").agg(F.collect_set("code").alias("codes"))
    names = (("TRUST_OR_ARRANGEMENT", "trust/arrangement"), ("NON_EU_JURISDICTION", "non-EU jurisdiction"), ("NOMINEE", "nominee"))
    triggers = F.array_compact(F.array(*(F.when(F.array_contains("codes", c), t) for c, t in names)))
    both = deep.select("bundle_id").join(said, "bundle_id").withColumn("triggers", triggers).where(F.size("triggers") >= 2)
    return _derived(both, "COMPLEX_CORPORATE_STRUCTURE", "high", F.size("triggers"), F.array_join("triggers", ", "))


def obfuscation(signals: DataFrame) -> DataFrame:
    """Opaque, and a complex structure, or layers with a jurisdiction outside the EU or a nominee."""
    used = ("OPAQUE_OWNERSHIP", "COMPLEX_CORPORATE_STRUCTURE", "COMPLEX_OWNERSHIP_LAYERS", "NON_EU_JURISDICTION", "NOMINEE")
    codes = signals.where(F.col("code").isin(*used)).groupBy("bundle_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    has = lambda c: F.array_contains("codes", c)
    hit = has(used[0]) & (has(used[1]) | (has(used[2]) & (has(used[3]) | has(used[4]))))
    return _derived(codes.where(hit), "POSSIBLE_OBFUSCATION", "low", F.size("codes"), F.array_join("codes", ","))


def matches_of(entities: DataFrame, persons: DataFrame, interests: DataFrame, filings: DataFrame | None = None, equivalent: tuple[str, ...] = C.EU_EEA) -> DataFrame:
    """What every rule on single statements finds: the evidence behind the signals, a row each."""
    found = entity_matches(entities, equivalent).unionByName(person_matches(persons)).unionByName(interest_matches(interests)).unionByName(state_matches(entities, interests))
    return found if filings is None else found.unionByName(filed_nominees(filings))


def assessed(entities: DataFrame, persons: DataFrame, interests: DataFrame, filings: DataFrame | None = None, equivalent: tuple[str, ...] = C.EU_EEA) -> DataFrame:
    """All signals of all bundles."""
    chains = written(cycles.longest_chains(ownership(entities, interests)), "chains")
    found = written(matches_of(entities, persons, interests, filings, equivalent), "matches")
    signals = signals_of(found).unionByName(layers(chains)).unionByName(complex_structure(chains, found))
    signals = written(signals, "signals")
    return signals.unionByName(obfuscation(signals))


def topic_signals(hits: DataFrame) -> DataFrame:
    """hits (bundle_id, hit_id, topics array): codes of the topic families. Control hides linked; unknown
    sanction and export topics count as linked."""
    t = F.col("topics")
    has = lambda *xs: F.arrays_overlap(t, F.array(*map(F.lit, xs)))
    unknown = lambda prefix, known: F.exists(t, lambda x: x.startswith(prefix) & ~x.isin(*known))
    codes = [
        F.when(has(*C.PEP_TOPICS), "PEP"),
        F.when(has("sanction"), "SANCTIONED"),
        F.when(has("sanction.counter"), "COUNTER_SANCTIONED"),
        F.when(has("sanction.control"), "SANCTIONS_CONTROLLED"),
        F.when(~has("sanction.control") & (has("sanction.linked") | unknown("sanction", C.SANCTION_TOPICS)), "SANCTIONS_LINKED"),
        F.when(has("debarment"), "DEBARMENT"),
        F.when(has("export.control"), "EXPORT_CONTROLLED"),
        F.when(has("export.control.linked") | unknown("export", C.EXPORT_TOPICS), "EXPORT_CONTROL_LINKED"),
        F.when(has("export.risk"), "EXPORT_RISK"),
    ]
    return hits.select("bundle_id", "hit_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def related(hits: DataFrame) -> DataFrame:
    """Topic signals of parties that were screened by name, as codes of the subject's bundle: RELATED_ before
    each. hits: bundle_id, hit_id, topics, statement_id (the party), confidence; of several hits of one party
    and code the one with the higher confidence, then the smaller hit id."""
    code = topic_signals(hits).withColumn("code", F.concat(F.lit("RELATED_"), "code"))
    all_ = code.join(hits.select("bundle_id", "hit_id", "statement_id", "confidence").distinct(), ["bundle_id", "hit_id"])
    grade = F.array_position(F.array(*map(F.lit, GRADES)), F.col("confidence"))
    return merged(all_, ["bundle_id", "code", "statement_id"], [grade.desc(), F.col("hit_id")])


def merged(signals: DataFrame, key: list[str], order: list) -> DataFrame:
    """One signal a key, the first by the given order."""
    return signals.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


# The verdict's clauses and the codes of each, in the order they are read.
#: A sentence takes two at most.
CLAUSES = (
    (("SANCTIONED", "SANCTIONS_CONTROLLED", "SANCTIONED_SECURITY"), "sanctions findings on the company itself"),
    (("EXPORT_CONTROLLED", "EXPORT_CONTROL_LINKED", "EXPORT_RISK"), "export-control findings on the company itself"),
    (("DEBARMENT", "RELATED_DEBARMENT"), "procurement debarment findings"),
    (("RELATED_SANCTIONED", "RELATED_SANCTIONS_CONTROLLED", "RELATED_SANCTIONS_LINKED"), "sanctions findings on parties connected to it"),
    (("RELATED_EXPORT_CONTROLLED", "RELATED_EXPORT_CONTROL_LINKED", "RELATED_EXPORT_RISK"), "export-control findings on parties connected to it"),
    (("SANCTIONS_LINKED", "COUNTER_SANCTIONED", "RELATED_COUNTER_SANCTIONED"), "records linking it to sanctioned parties"),
    (("PEP", "RELATED_PEP"), "a politically exposed person among the parties named"),
    (("FATF_BLACK_LIST", "FATF_GREY_LIST", "EU_HIGH_RISK_THIRD_COUNTRY"), "a jurisdiction on an international watch list"),
    (("OFFSHORE_LEAKS",), "an appearance in offshore-leaks data"),
    (("OPAQUE_OWNERSHIP", "NOMINEE", "TRUST_OR_ARRANGEMENT", "POSSIBLE_OBFUSCATION"), "ownership recorded in a form that obscures who benefits"),
    (("STATE_CONTROLLED",), "state ownership recorded on the company"),
)
STRUCTURE_CODES = ("COMPLEX_OWNERSHIP_LAYERS", "GLEIF_REPORTING_EXCEPTION")


def verdicts(subjects: DataFrame, signals: DataFrame, degraded: DataFrame) -> DataFrame:
    """bundle_id, verdict: one sentence for each subject, null where there is nothing true to say. signals:
    bundle_id, code, kind, n_matches (of layers: how many); degraded (bundle_id, source): screens that
    didn't run, one that reached no source (null) among them, which only matter where nothing was found."""
    risk = F.collect_set(F.when(F.coalesce("kind", F.lit("risk")) == "risk", F.col("code")))
    depth = F.max(F.when(F.col("code") == "COMPLEX_OWNERSHIP_LAYERS", F.col("n_matches")))
    excepted = F.coalesce(F.bool_or(F.col("code") == "GLEIF_REPORTING_EXCEPTION"), F.lit(False))
    per = signals.groupBy("bundle_id").agg(risk.alias("codes"), depth.alias("depth"), excepted.alias("excepted"))
    missing = degraded.groupBy("bundle_id").agg(F.countDistinct(F.coalesce("source", F.lit(""))).alias("missing"))
    all_ = subjects.select("bundle_id").distinct().join(per, "bundle_id", "left").join(missing, "bundle_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))).withColumn("missing", F.coalesce("missing", F.lit(0)))
    clauses = F.slice(F.array_compact(F.array(*(F.when(F.arrays_overlap("codes", F.array(*map(F.lit, cs))), text) for cs, text in CLAUSES))), 1, 2)
    head = F.array_join(clauses, ", and ")
    structure = F.when(F.col("depth").isNotNull(), F.concat(F.lit("an ownership chain "), F.col("depth").cast("string"), F.lit(" layers deep"))).when(F.col("excepted"), "no parent filed with GLEIF, under a permitted exception")
    unread = F.size(F.array_except("codes", F.array(*(F.lit(c) for cs, _ in CLAUSES for c in cs), *map(F.lit, STRUCTURE_CODES)))) > 0
    many = F.when(F.col("missing") == 1, "one check did not run").otherwise(F.concat(F.col("missing").cast("string"), F.lit(" checks did not run")))
    suffix = F.when(F.col("missing") > 0, F.concat(F.lit(", but "), many, F.lit(" — an empty result there is not a clean screen"))).otherwise("")
    found = F.concat(F.upper(F.substring("head", 1, 1)), F.expr("substring(head, 2)"), F.coalesce(F.concat(F.lit(", over "), "structure"), F.lit("")), F.lit("."))
    base = F.when(F.col("structure").isNotNull() & (F.size("codes") > 0), F.concat(F.lit("The records show "), "structure")).when(F.col("structure").isNotNull(), F.concat(F.lit("No risk signals surfaced, over "), "structure")).when(F.col("missing") > 0, "No risk signals surfaced").otherwise("No risk signals surfaced across the sources that answered")
    said = all_.withColumn("head", head).withColumn("structure", structure).withColumn("unread", unread)
    return said.select("bundle_id", F.when(F.col("head") != "", found).when(F.col("unread") & F.col("structure").isNull(), None).otherwise(F.concat(base, suffix, F.lit("."))).alias("verdict"))


def open_positions(positions: DataFrame, key: str, ended: Column) -> DataFrame:
    """key, n_positions of persons with a position that has not ended: politically exposed, medium."""
    per = positions.groupBy(key).agg(F.count(F.lit(1)).alias("n_positions"), F.bool_or(~ended).alias("pep"))
    return per.where("pep").withColumn("confidence", F.lit("medium"))


def leak_collections(hits: DataFrame, prefixes: tuple[str, ...], fragments: tuple[str, ...]) -> DataFrame:
    """bundle_id, hit_id of hits from a leak collection: told by how its foreign id begins, else by its label. One signal a
    hit, medium. hits: bundle_id, hit_id, foreign_id, label."""
    begins = reduce(lambda a, b: a | b, (F.col("foreign_id").startswith(p) for p in prefixes))
    named = contains_any(F.col("label"), fragments)
    hit = F.coalesce(begins, F.lit(False)) | F.coalesce(named, F.lit(False))
    return hits.where(hit).select("bundle_id", "hit_id", F.lit("OFFSHORE_LEAKS").alias("code"), F.lit("medium").alias("confidence")).distinct()


def signal_kind(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("risk"))


def redacted(payload: Column, licence: Column, withheld: tuple[str, ...]) -> Column:
    """The payload, or a note in its place where its licence doesn't allow to show it."""
    return F.when(licence.isin(*withheld), "withheld by licence").otherwise(payload)


def degraded(failures: DataFrame, names: DataFrame, affected: dict[str, tuple[str, ...]]) -> DataFrame:
    """bundle_id, source, n_failed, n_names, reason, codes: screens that failed for some of a bundle's names, with the reason
    that counts most and the signals that may be missing. A failure before any source was reached has no source and
    is a record of its own, over all codes. failures: bundle_id, source, reason; names: bundle_id, n_names."""
    order = F.when(F.col("reason") == "rate_limited", 1).when(F.col("reason") == "timeout", 2).otherwise(3)
    every = sorted({c for cs in affected.values() for c in cs})
    codes = F.create_map(*(x for s, cs in affected.items() for x in (F.lit(s), F.array(*map(F.lit, cs)))))
    per = failures.withColumn("source", F.coalesce("source", F.lit("upstream"))).groupBy("bundle_id", "source").agg(F.count(F.lit(1)).alias("n_failed"), F.min_by("reason", order).alias("reason"))
    return per.join(names, "bundle_id", "left").withColumn("codes", F.coalesce(codes[F.col("source")], F.array(*map(F.lit, every))))
