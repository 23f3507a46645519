"""Evidence packets, and claims held against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evidence(entities: DataFrame, interests: DataFrame, signals: DataFrame, degraded: DataFrame) -> DataFrame:
    """bundle_id, evidence_id, part, ref, text: facts f1, f2, ... (entities, then relationships, by statement), risks
    r1, ... (signals of the kind risk, by code) and gaps g1, ... (screens that did not run, by source)."""
    fact = entities.select("bundle_id", F.lit("f").alias("part"), F.lit(0).alias("group"), F.col("statement_id").alias("ref"), F.concat_ws(" ", "name", F.concat(F.lit("("), F.col("jurisdiction"), F.lit(")"))).alias("text"))
    first = interests.groupBy("bundle_id", "statement_id").agg(F.min(F.concat_ws(" ", F.coalesce("party_id", F.lit("an unnamed party")), F.coalesce("type", F.lit("unknown interest")), "subject_id")).alias("text"))
    link = first.select("bundle_id", F.lit("f").alias("part"), F.lit(1).alias("group"), F.col("statement_id").alias("ref"), "text")
    risk = signals.where("kind = 'risk'").select("bundle_id", F.lit("r").alias("part"), F.lit(0).alias("group"), F.col("code").alias("ref"), F.concat_ws(": ", "code", "detail").alias("text")).distinct()
    gap = degraded.select("bundle_id", F.lit("g").alias("part"), F.lit(0).alias("group"), F.col("source").alias("ref"), F.concat("source", F.lit(" did not run")).alias("text")).distinct()
    every = fact.unionByName(link).unionByName(risk).unionByName(gap)
    k = F.row_number().over(Window.partitionBy("bundle_id", "part").orderBy("group", "ref", "text"))
    return every.withColumn("evidence_id", F.concat("part", k.cast("string"))).select("bundle_id", "evidence_id", "part", "ref", "text")


def validated(claims: DataFrame, evidence_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims (bundle_id, claim_id, cited array) held against a bundle's evidence: claims with kept and unknown (cited
    ids that aren't there); whether each bundle's summary stands (no claim was dropped); gaps that no kept
    claim cites."""
    one = claims.select("bundle_id", "claim_id", F.explode_outer(F.array_distinct("cited")).alias("evidence_id"))
    seen = one.join(evidence_.select("bundle_id", "evidence_id", F.lit(True).alias("there")), ["bundle_id", "evidence_id"], "left")
    lost = F.col("evidence_id").isNotNull() & F.col("there").isNull()
    judged = seen.groupBy("bundle_id", "claim_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("kept"), F.sum(lost.cast("int")).alias("unknown"))
    summaries = judged.groupBy("bundle_id").agg(F.bool_and("kept").alias("stands"))
    cited = one.join(judged.where("kept"), ["bundle_id", "claim_id"], "left_semi").select("bundle_id", "evidence_id").distinct()
    gaps = evidence_.where("part = 'g'").join(claims.select("bundle_id").distinct(), "bundle_id", "left_semi").join(cited, ["bundle_id", "evidence_id"], "left_anti")
    return judged, summaries, gaps.select("bundle_id", "evidence_id", "ref")
