"""Entity resolution: bridges on identifiers and names, candidate pairs, scores and clusters. Candidates
always come from an equi-join on a block; nothing is compared across blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph.functions import names
from holdgraph.functions import scalars as S
from holdgraph.lineage import written
from holdgraph.operators import graph
from holdgraph.operators.classes import expanded


# Identifiers that stand for nothing.
PLACEHOLDERS = ("Q0", "STUB000000000000LEI0", "00000000")


def strong_bridges(hits: DataFrame, least: dict[str, int], check_lei: bool = False) -> DataFrame:
    """hits (hit_id, identifiers map): place, key, value, n and hits that share it, keys in the order of `least`, which says
    how many hits a key needs. Placeholders, entity numbers that have no such shape and, if asked for, LEIs with a
    wrong check digit bridge nothing. Hits are counted, whatever their sources."""
    pairs = hits.select("hit_id", F.explode("identifiers").alias("key", "value")).where(F.col("key").isin(*least) & (F.coalesce("value", F.lit("")) != "") & ~F.upper("value").isin(*PLACEHOLDERS))
    pairs = pairs.where((F.col("key") != "wikidata_qid") | S.qid_ok(F.col("value")))
    if check_lei:
        pairs = pairs.where((F.col("key") != "lei") | S.lei_ok(F.col("value")))
    need = F.create_map(*(F.lit(x) for kv in least.items() for x in kv))
    place = F.array_position(F.array(*map(F.lit, least)), F.col("key")).cast("int")
    found = pairs.distinct().groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("hit_id")).alias("hits"))
    return found.where(F.col("n") >= need[F.col("key")]).select(place.alias("place"), "key", "value", "n", "hits")


def weak_bridges(hits: DataFrame, linked: DataFrame) -> DataFrame:
    """Persons of one matchable name that no strong bridge holds, two at least, without a stub among them.
    hits: hit_id, kind, name, is_stub; linked: hit_id."""
    open_ = hits.where("kind = 'person'").join(linked, "hit_id", "left_anti").withColumn("key", S.plain_name(F.col("name"))).where(S.matchable(F.col("key")))
    return open_.groupBy("key").agg(F.array_sort(F.collect_set("hit_id")).alias("hits"), F.max(F.col("is_stub").cast("int")).alias("stub")).where("size(hits) >= 2 AND stub = 0").drop("stub")


# Parts of identifier schemes that aren't registers of companies.
NOT_REGISTERS = ("VAT", "UID", "TVA", "MOMS", "MWST", "KMKR", "DIC", "NIP", "OIB", "BN", "EIN", "FEIN", "UTR", "TAX", "CIK", "ISIN", "CUSIP", "NACE", "SIC", "TOL")


def merge_keys(identifiers: Column, jurisdiction: Column) -> Column:
    """Keys that say 'the same entity': a global LEI, told by its shape; scheme with value; and jurisdiction with value for
    numbers without a scheme or under one of the jurisdiction's registers, unless the number is composite."""
    jur = F.upper(F.get(F.split(F.trim(F.coalesce(jurisdiction, F.lit(""))), "-"), F.lit(0)))

    def of(i: Column) -> Column:
        value = F.upper(F.trim(F.coalesce(i["id"], F.lit(""))))
        scheme = F.upper(F.trim(F.coalesce(i["scheme"], F.lit("?"))))
        lei = value.rlike("^[A-Z0-9]{18}[0-9]{2}$")
        parts = F.split(scheme, "[-_]")
        register = (scheme == "") | (scheme.startswith(F.concat(jur, F.lit("-"))) & ~F.arrays_overlap(F.slice(parts, 2, 100), F.array(*map(F.lit, NOT_REGISTERS))))
        return F.when(
            value != "",
            F.array(
                F.when(lei, F.concat(F.lit("LEI:"), value)).otherwise(F.concat(scheme, F.lit(":"), value)),
                F.when(~lei & (jur != "") & register & ~value.contains("/"), F.concat(F.lit("JUR:"), jur, F.lit(":"), value)),
            ),
        )

    return F.array_distinct(F.array_compact(F.flatten(F.array_compact(F.transform(F.coalesce(identifiers, F.array().cast("array<struct<id:string,scheme:string>>")), of)))))


def merged_network(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that share a key are one, and relationships between them once. entities: seq, statement_id, name,
    jurisdiction, entity_type, founding_date, identifiers, source; relationships: seq, subject_id, party_id, types, source.
    The one is called after its LEI, else its smallest key, else its smallest statement; of every attribute the first
    that is there counts (by seq); sources gather. Gives entities (canonical_id, ..., n_members, sources) and
    relationships (subject_id, party_id, types, sources)."""
    keyed = entities.select("statement_id", F.explode_outer(merge_keys(F.col("identifiers"), F.col("jurisdiction"))).alias("key"))
    node, key = F.concat(F.lit("1"), "statement_id"), F.coalesce(F.concat(F.lit("0"), "key"), F.concat(F.lit("1"), "statement_id"))
    part = graph.components(keyed.select(node.alias("a"), key.alias("b")))
    of = part.where("node LIKE '1%'").select(F.expr("substring(node, 2)").alias("statement_id"), "component")
    lei = F.min(F.when(F.col("node").startswith("0LEI:"), F.expr("substring(node, 2)")))
    name = part.groupBy("component").agg(F.concat(F.lit("recon:"), F.coalesce(lei, F.min(F.when(F.col("node").startswith("0"), F.expr("substring(node, 2)"))), F.min(F.expr("substring(node, 2)")))).alias("canonical_id"))
    remap = written(of.join(name, "component").select("statement_id", "canonical_id"), "remap")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("seq"))).alias(c)
    all_ = entities.join(remap, "statement_id")
    one = all_.groupBy("canonical_id").agg(*(first(c) for c in ("name", "jurisdiction", "entity_type", "founding_date")), F.countDistinct("statement_id").alias("n_members"), F.array_sort(F.collect_set("source")).alias("sources"))
    to = lambda df, c: df.join(remap.select(F.col("statement_id").alias(c), F.col("canonical_id").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    links = to(to(relationships, "subject_id"), "party_id").groupBy("subject_id", "party_id", "types").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return one.withColumn("name", F.coalesce("name", "canonical_id")), links


def with_name_keys(entities: DataFrame) -> DataFrame:
    """entities (with name) and name_keys, as possibly_same takes them: legal forms stand as their classes."""
    name = names.comparable_name("name")
    return entities.withColumn("name_keys", F.array(name, F.regexp_replace(name, " ", "")))


def possibly_same(entities: DataFrame) -> DataFrame:
    """a, b (a < b): one name in one jurisdiction, founding years that don't conflict, no shared key.
    entities: id, name_keys (the name as compared and without its blanks: one that agrees is enough), jurisdiction,
    year (null: unknown), keys array. Names or jurisdictions that are missing agree with nothing. Ids of which all
    this is equal are a class, called after the smallest; classes are compared, then members take their places."""
    row = F.struct(F.array_sort(F.array_distinct("name_keys")).alias("name_keys"), "jurisdiction", "year", "keys")
    said = written(entities.where("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set(row)).alias("said")), "said")
    classes = said.groupBy("said").agg(F.min("id").alias("class"))
    of = written(said.join(classes, "said").select("id", "class"), "classes")
    each = classes.select("class", F.inline("said")).withColumn("name_key", F.explode("name_keys")).where("name_key <> '' AND jurisdiction <> ''")
    side = lambda p: each.select("name_key", "jurisdiction", F.col("class").alias(f"{p}_class"), F.col("year").alias(f"{p}_year"), F.col("keys").alias(f"{p}_keys"))
    j = side("a").join(side("b"), ["name_key", "jurisdiction"]).where("a_class <= b_class")
    years = F.col("a_year").isNull() | F.col("b_year").isNull() | (F.col("a_year") == F.col("b_year"))
    pairs = j.where(years & ~F.arrays_overlap("a_keys", "b_keys")).select("a_class", "b_class").distinct()
    both = expanded(pairs.withColumn("one", F.col("a_class") == F.col("b_class")), of, of)
    return both.where("NOT one OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def blocked_pairs(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """Pairs that share a value of the array column `block`, each once. left: a, a_name; right: b, b_name."""
    l, r = left.select("a", "a_name", F.explode(block).alias("_block")), right.select("b", "b_name", F.explode(block).alias("_block"))  # noqa: E741
    return l.join(r, "_block").drop("_block").distinct()


def screened(pairs: DataFrame, least: float = 0.88) -> DataFrame:
    """Pairs whose normalised names score at least so much, with a confidence."""
    scored = pairs.withColumn("score", names.name_similarity(names.normalised_name("a_name"), names.normalised_name("b_name"))).where(F.col("score") >= least)
    return scored.withColumn("confidence", match_confidence(F.col("score"), F.lit(False), F.lit(False)))


def match_confidence(score: Column, is_person: Column, corroborated: Column) -> Column:
    """A person without corroboration: medium from 0.95, else low; otherwise high from 0.95, else medium."""
    alone = is_person & ~corroborated
    return F.when(alone & (score >= 0.95), "medium").when(alone, "low").when(score >= 0.95, "high").otherwise("medium")


def person_pair_score(name_score: Column, same_year: Column, same_nationality: Column, same_company: Column, conflict: Column, shared_id: Column) -> Column:
    """Name score with bonuses; a conflict caps it at 0.7, a shared identifier lifts it to 0.95."""
    raw = name_score + F.when(same_year, 0.1).otherwise(0.0) + F.when(same_nationality, 0.05).otherwise(0.0) + F.when(same_company, 0.05).otherwise(0.0)
    capped = F.when(conflict, F.least(raw, F.lit(0.7))).otherwise(F.least(raw, F.lit(1.0)))
    return F.when(shared_id, F.greatest(capped, F.lit(0.95))).otherwise(capped)


def first_strategy(hits: DataFrame, group: str, strategy: str, hit: str, order: Column) -> DataFrame:
    """Of the strategies that found anything for a group, the first one's hits, each once."""
    best = F.min(strategy).over(Window.partitionBy(group))
    k = F.row_number().over(Window.partitionBy(group, hit).orderBy(order))
    return hits.withColumn("_best", best).where(F.col("_best") == F.col(strategy)).withColumn("_k", k).where("_k = 1").drop("_best", "_k")


def votes(hits: DataFrame, most: int) -> DataFrame:
    """group, id, votes, best: distinct variants that found an id, then its best rank, then the id."""
    v = hits.groupBy("group", "id").agg(F.countDistinct("variant").alias("votes"), F.min("rank").alias("best"))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("votes"), "best", "id"))).where(F.col("place") <= most)
