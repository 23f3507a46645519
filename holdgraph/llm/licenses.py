"""Operator 10: license scans by diagonal voting, in DataFrame expressions alone.

Every rolling word k-gram of every text is hashed and joined to the positions that the same hash has
in the templates (a constant table, so it is broadcast). A hit votes for the offset between text and
template, its diagonal. Votes are gathered by diagonal, diagonals that lie next to each other (a word
put in or left out) are merged, and the words behind each vote are compared, so a hash alone never
makes a find. A diagonal with every vote is a literal occurrence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdgraph.llm.session import id_and_text


@dataclass(frozen=True)
class Template:
    words: str
    label: str
    #: Counted literally: its places are the base.
    base: bool = False


# The base phrases, and sentences of well-known public licences.
TEMPLATES = (
    Template("under the mit license", "mit", True),
    Template("apache license version 2", "apache-2", True),
    Template("cc by nc", "cc-by-nc", True),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    Template("licensed under the apache license version 2 0", "apache-2"),
    Template("creative commons attribution noncommercial", "cc-by-nc"),
    Template("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    Template("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    Template("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3"),
    Template("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    Template("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    Template("under the terms of the gnu affero general public license", "agpl"),
    Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    Template("this is free and unencumbered software released into the public domain", "unlicense"),
    Template("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    Template("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    Template("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    Template("boost software license version 1 0", "bsl-1"),
)
#: Words in a hashed gram; diagonals at most so far apart are one find; template words that a find must cover.
GRAM, NEIGHBOURS, COVER = 2, 2, 0.75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOCUMENT = -1  # the template number of the row that stands for the document itself


def words(text):
    r"""A-Z lowered, then `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """gram, template, place, first, second: one row for each word pair of each template."""
    rows = [(k, i, w[i], w[i + 1]) for k, t in enumerate(templates) for w in [t.words.split()] for i in range(len(w) - 1)]
    pairs = spark.createDataFrame(rows, "template int, place int, first string, second string").withColumn("gram", F.xxhash64("first", "second"))
    whole = spark.createDataFrame([(_DOCUMENT, 0, None, None)], "template int, place int, first string, second string").withColumn("gram", F.lit(0).cast("long"))
    return pairs.unionByName(whole)


def votes(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, text_hash, n_words, template, place, diagonal: one row for each pair of words that a text
    shares with a template, and one (template -1) for each document."""
    w = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    grams = F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.xxhash64(a, b))
    # The document's own row stands first, with gram 0.
    each = w.select("doc_id", "text_hash", "w", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), grams)).alias("at", "gram"))
    hits = each.join(F.broadcast(template_grams(docs.sparkSession, templates)), "gram")
    own = (F.col("template") == _DOCUMENT) & (F.col("at") == 0)
    same = (F.col("template") != _DOCUMENT) & (F.col("at") > 0) & (F.try_element_at("w", F.greatest("at", F.lit(1))) == F.col("first")) & (F.try_element_at("w", F.col("at") + 1) == F.col("second"))
    return hits.where(own | same).select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), "template", "place", F.when(own, 0).otherwise(F.col("at") - 1 - F.col("place")).cast("long").alias("diagonal"))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Row by row: doc_id, n_words, n_base (places where a base template's words stand consecutively),
    first_word and last_word (their smallest and largest start; null without one), base_labels, labels
    (with those of near finds), score (the largest share of a template's words that a find covers).

    A null text counts as empty: no words, no labels ('' in both columns), score 0. Rows with a null
    id are scanned too; repeated rows give repeated results; rows that share an id but not a text are
    kept apart. Other columns are ignored. Texts are read whole."""
    key = ["doc_id", "text_hash"]
    # One exchange: each later step groups by these columns and more.
    dealt = votes(docs, templates).repartition(*key)
    diagonals = dealt.groupBy(*key, "n_words", "template", "diagonal").agg(F.collect_set("place").alias("places"), F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(True))
    finds = diagonals.withColumn("far", far.cast("int")).withColumn("find", F.sum("far").over(order))

    size = F.create_map(*(F.lit(x) for k, t in enumerate(templates) for x in (k, len(t.words.split()))))
    label = F.create_map(*(F.lit(x) for k, t in enumerate(templates) for x in (k, t.label)))
    base = F.col("template").isin([k for k, t in enumerate(templates) if t.base])
    exact = base & (F.size("places") == size[F.col("template")] - 1)
    own = F.col("template") == _DOCUMENT
    found = finds.groupBy(*key, "n_words", "template", "find").agg(
        F.array_distinct(F.flatten(F.collect_list(F.concat("places", F.transform("places", lambda p: p + 1))))).alias("covered"),
        F.sum(exact.cast("long")).alias("n_base"),
        F.min(F.when(exact, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(exact, F.col("diagonal"))).alias("last_word"),
        F.sum(F.when(own, F.col("rows"))).alias("rows"),
    )
    share = F.when(~own, F.size("covered") / size[F.col("template")]).otherwise(0.0)
    named = F.when(~own, label[F.col("template")])
    out = found.withColumn("share", share).withColumn("label", named).groupBy(*key, "n_words").agg(
        F.sum("n_base").alias("n_base"),
        F.min("first_word").alias("first_word"),
        F.max("last_word").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("n_base") > 0, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("share") >= COVER, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.sum("rows").alias("rows"),
    )
    # Repeated rows vote once for each of them; places and labels are sets, so only the row count tells.
    again = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score", again.alias("_row")).drop("_row")


def _sql() -> str:
    rows = ", ".join(f"({k}, {i}, '{w[i]}', '{w[i + 1]}')" for k, t in enumerate(TEMPLATES) for w in [t.words.split()] for i in range(len(w) - 1))
    info = ", ".join(f"({k}, {len(t.words.split())}, '{t.label}', {str(t.base).lower()})" for k, t in enumerate(TEMPLATES))
    return rf"""
WITH pair(template, place, first, second) AS (VALUES {rows}),
info(template, size, label, base) AS (VALUES {info}),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), word AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM doc),
vote AS (
  SELECT doc_id, template, place, pos - place AS diagonal
  FROM word JOIN pair ON w[pos + 1] = first AND w[pos + 2] = second
), far AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS k FROM vote
), diag AS (
  SELECT doc_id, template, diagonal, list(DISTINCT place) AS places, count(DISTINCT place) AS n FROM far GROUP BY ALL
), step AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {NEIGHBOURS} THEN 1 ELSE 0 END AS s FROM diag WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)
), find AS (
  SELECT *, sum(s) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS find FROM step
), cover AS (
  SELECT f.doc_id, f.template, f.find, count(DISTINCT p.place + e.e) AS covered
  FROM find f, unnest(f.places) AS p(place), (VALUES (0), (1)) AS e(e) GROUP BY ALL
), part AS (
  SELECT c.doc_id, i.label, CAST(c.covered AS DOUBLE) / i.size AS share,
    (SELECT count(*) FROM find f WHERE f.doc_id = c.doc_id AND f.template = c.template AND f.find = c.find AND i.base AND f.n = i.size - 1) AS n_base,
    (SELECT min(diagonal) FROM find f WHERE f.doc_id = c.doc_id AND f.template = c.template AND f.find = c.find AND i.base AND f.n = i.size - 1) AS first_word,
    (SELECT max(diagonal) FROM find f WHERE f.doc_id = c.doc_id AND f.template = c.template AND f.find = c.find AND i.base AND f.n = i.size - 1) AS last_word
  FROM cover c JOIN info i USING (template)
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(sum(p.n_base), 0) AS BIGINT) AS n_base,
  min(p.first_word) AS first_word, max(p.last_word) AS last_word,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (p.n_base > 0), '') AS base_labels,
  coalesce(string_agg(DISTINCT p.label, ',' ORDER BY p.label) FILTER (p.share >= {COVER}), '') AS labels,
  coalesce(max(p.share), 0.0) AS score
FROM doc d LEFT JOIN part p USING (doc_id) GROUP BY d.doc_id, d.w"""


SCAN_SQL = _sql()
