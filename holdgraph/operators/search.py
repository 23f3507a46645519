"""Search of names over a written index of tokens and their places.

An index has a row for every token of every name (token, place, and the name's tokens beside it), in folders by
the token's first letters, sorted by token; and how often every token occurs. A question is looked up by its
rarest token and compared whole at the places around it: its tokens one after another (a phrase). Questions
without such a name are looked up by the beginning of their longest token: every token of the question must
begin a token of the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters of a token that choose its folder, folders, and rows of one file of a folder.
HEAD, FOLDERS, FILE_ROWS = 2, 64, 2_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def _folder(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, HEAD)), F.lit(FOLDERS)).cast("int")


def write_index(named: DataFrame, path: str) -> None:
    """Writes the index of named (id, name, and columns that hits shall have). Names that are null or without a
    letter or digit are left out. A folder's rows are dealt into as many files as they need."""
    each = named.withColumn("tokens", tokens(F.col("name"))).select("*", F.posexplode("tokens").alias("place", "token"))
    each = each.withColumn("folder", _folder(F.col("token")))
    files = max(1, -(-named.count() // FILE_ROWS))
    placed = each.repartition("folder", F.pmod(F.xxhash64("id", "token"), F.lit(files))).sortWithinPartitions("folder", "token", "id")
    placed.write.partitionBy("folder").parquet(f"{path}/places")
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("folder", _folder(F.col("token")))
    counts.repartition("folder").sortWithinPartitions("folder", "token").write.partitionBy("folder").parquet(f"{path}/counts")


def person_names(persons: DataFrame, names: DataFrame, nationalities: DataFrame) -> DataFrame:
    """id, name, nationality as person indexes hold them: a person's first name that isn't blank and first
    nationality, by place. persons: id; names: id, place, name; nationalities: id, place, nationality."""
    first = lambda df, c: df.where(F.trim(c) != "").groupBy("id").agg(F.min_by(c, F.struct("place", c)).alias(c))
    return persons.select("id").distinct().join(first(names, "name"), "id").join(first(nationalities, "nationality"), "id", "left")


def _places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/places")


def search(queries: DataFrame, path: str, most: int = 20) -> DataFrame:
    """query_id, query, place (from 1), how ('phrase' or 'prefix') and the hit's columns: the first `most` names of
    each question, by name and id. queries: query_id, query. A question without letters and digits finds
    nothing, and of names only those of the kind of match that comes first."""
    spark = queries.sparkSession
    places, counts = _places(spark, path), spark.read.parquet(f"{path}/counts")
    hit = [c for c in places.columns if c not in ("tokens", "place", "token", "folder")]
    asked = queries.select("query_id", "query", tokens(F.col("query")).alias("asked")).where("size(asked) > 0").distinct()
    each = asked.select("*", F.posexplode("asked").alias("at", "token")).withColumn("folder", _folder(F.col("token")))
    known = each.join(counts, ["folder", "token"], "left").groupBy("query_id", "query", "asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("rare"))
    known = known.where("rare.n > 0").select("query_id", "query", "asked", F.col("rare.token").alias("token"), F.col("rare.at").alias("at")).withColumn("folder", _folder(F.col("token")))
    begins = F.col("place") - F.col("at")
    here = F.when(begins >= 0, F.slice("tokens", begins + 1, F.size("asked")) == F.col("asked"))
    phrase = places.join(known, ["folder", "token"]).where(here).select("query_id", "query", F.lit("phrase").alias("how"), *hit).distinct()

    # Questions without a phrase.
    rest = asked.join(phrase.select("query_id", "query").distinct(), ["query_id", "query"], "left_anti")
    longest = F.get(F.array_sort("asked", lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    rest = rest.withColumn("begin", longest)
    fits = F.col("token").startswith(F.col("begin")) & F.forall("asked", lambda a: F.exists("tokens", lambda h: h.startswith(a)))
    long_ = places.join(rest.where(F.length("begin") >= HEAD).withColumn("folder", _folder(F.col("begin"))), "folder")
    short = places.withColumn("one", F.substring("token", 1, 1)).join(rest.where(F.length("begin") < HEAD).withColumn("one", F.col("begin")), "one").drop("one")
    prefix = long_.unionByName(short).where(fits).select("query_id", "query", F.lit("prefix").alias("how"), *hit).distinct()
    order = Window.partitionBy("query_id", "query").orderBy("name", "id")
    return phrase.unionByName(prefix).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
