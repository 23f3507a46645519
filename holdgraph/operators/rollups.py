"""Windows and roll-ups: latest versions, precedence, capped shares, licences, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def latest_open(df: DataFrame, key: list[str], order: list, status: str) -> DataFrame:
    """The latest version of each record, and of those the ones that are not closed."""
    return first_per(df, key, order).where(F.col(status) != "closed")


def top_per(df: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= most)


def base_wins(base: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """All of base, and of extra what base lacks."""
    return base.unionByName(extra.join(base.select(*key), key, "left_anti"))


def capped(df: DataFrame, key: list[str], share: str, most: float = 100.0) -> DataFrame:
    """Shares of equal rows once, summed up to a cap."""
    return df.distinct().groupBy(*key).agg(F.least(F.lit(most), F.sum(share)).alias(share))


def rank_of(values: list[str], column: Column) -> Column:
    """0 for the first of the values, 1 for the next, ...; null for others."""
    at = F.array_position(F.array(*map(F.lit, values)), column)
    return F.when(at > 0, at - 1)


def most_restrictive(df: DataFrame, key: list[str], licence: str, restrictiveness: Column) -> DataFrame:
    """Each key's most restrictive licence, ties to the smaller id."""
    return first_per(df.withColumn("_r", restrictiveness), key, [F.desc("_r"), F.col(licence)]).drop("_r")


def provenance(df: DataFrame, key: list[str], severity: Column, time: str, detail: str, order: str) -> DataFrame:
    """Worst liveness, oldest time, first detail that is there."""
    return df.withColumn("_s", severity).groupBy(*key).agg(F.max_by("liveness", F.struct("_s", "liveness")).alias("liveness"), F.min(time).alias("oldest"), F.min_by(detail, F.when(F.col(detail).isNotNull(), F.col(order))).alias("detail"))


def gate_quality(pairs: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Precision and recall of a gate at each threshold over labelled pairs."""
    at = F.explode(F.array(*map(F.lit, thresholds)))
    hit = F.col(score) >= F.col("threshold")
    t = pairs.where(F.col(label).isNotNull()).select(score, label, at.alias("threshold")).groupBy("threshold").agg(F.sum((hit & F.col(label)).cast("long")).alias("tp"), F.sum(hit.cast("long")).alias("picked"), F.sum(F.col(label).cast("long")).alias("positive"))
    return t.select("threshold", F.try_divide("tp", "picked").alias("precision"), F.try_divide("tp", "positive").alias("recall"))


def confirmed(hits: DataFrame, key: list[str], source: str, least: int = 2) -> DataFrame:
    """key, n_sources, confirmed: distinct sources that name it, and whether they are enough."""
    return hits.groupBy(*key).agg(F.countDistinct(source).alias("n_sources")).withColumn("confirmed", F.col("n_sources") >= least)


def busiest(rows: DataFrame, person: str, company: str, most: int) -> DataFrame:
    """The persons with most distinct companies, ties to the smaller person: person, n."""
    return rows.groupBy(F.col(person).alias("person")).agg(F.countDistinct(company).alias("n")).orderBy(F.desc("n"), "person").limit(most)


def associations(rows: DataFrame, key: list[str], role: str, grade: Column, share: str, order: str) -> DataFrame:
    """key, n_roles, grade (the strongest), roles, first_share (the first that is there): rows of one association collapsed.
    grade: 1 low to 3 high."""
    level = F.max(grade)
    roles = rows.select(*key, role).distinct().groupBy(*key).agg(F.array_sort(F.collect_list(role)).alias("roles"))
    per = rows.groupBy(*key).agg(level.alias("_level"), F.min_by(share, F.when(F.col(share).isNotNull(), F.col(order))).alias("first_share"))
    return per.join(roles, key).select(*key, F.size("roles").cast("long").alias("n_roles"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("_level")).alias("confidence"), F.array_join("roles", ",").alias("roles"), "first_share")


def tallied(events: DataFrame, by: list, ceased: Column) -> DataFrame:
    """Events and how many of them have ceased, by type and kind."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(ceased, 1)).alias("n_ceased"))


def paid(rows: DataFrame, year: Column, amount: str, apart: Column) -> DataFrame:
    """year, total, and the total of the payments that count apart (of one currency, say)."""
    return rows.groupBy(year.alias("year")).agg(F.sum(amount).alias("total"), F.sum(F.when(apart, F.col(amount)).otherwise(0.0)).alias("total_apart"))


def search_quality(answers: DataFrame, expected: DataFrame, places: tuple[int, ...] = (1, 5)) -> DataFrame:
    """category ('' is all of them), n, and for each of `places` how many questions have what was expected up to that
    place. answers: query_id, id, place (of repeated answers the first counts); expected: query_id, category, id."""
    rank = answers.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    judged = expected.join(rank, ["query_id", "id"], "left").select(F.explode(F.array(F.lit(""), F.col("category"))).alias("category"), "place")
    return judged.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("place") <= k, 1)).alias(f"hit_{k}") for k in places))
