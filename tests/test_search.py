"""The token index against plain loops."""

import random
import re

from pyspark.sql import functions as F

from holdgraph.operators import search


def plain_tokens(text):
    return re.sub(r"[^\w]|_", " ", (text or "").lower()).split()


def plain_search(named, queries, most):
    out = set()
    for qid, q in queries:
        asked = plain_tokens(q)
        if not asked:
            continue
        cut = {i: plain_tokens(n) for i, n in named}
        phrase = [i for i, has in cut.items() if any(has[k : k + len(asked)] == asked for k in range(len(has)))]
        prefix = [i for i, has in cut.items() if all(any(h.startswith(a) for h in has) for a in asked)]
        hits = sorted((n, i) for i, n in named if i in (phrase or prefix))
        out |= {(qid, q, i, "phrase" if phrase else "prefix", k + 1) for k, (_, i) in enumerate(hits[:most])}
    return out


def test_search_equals_plain_loops(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "alp", "a", "beta", "bet", "gamma", "Ünal", "42", "4", "the", "of"]
    named = [(i, rng.choice(["", "  ", ", "]).join([""]) + rng.choice([" ", "-", ", "]).join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(200)] + [(900, None), (901, "..."), (902, "alpha alpha beta")]
    queries = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for k in range(60)] + [(100, "alp be"), (101, "ün"), (102, "zz"), (103, ""), (104, None), (105, "b"), (106, "The, of!"), (107, "alpha beta")]
    search.write_index(spark.createDataFrame(named, "id long, name string").withColumn("kind", F.lit("x")), f"{tmp_path}/index")
    got = search.search(spark.createDataFrame(queries, "query_id long, query string"), f"{tmp_path}/index", most=7)
    assert "kind" in got.columns
    assert {(r.query_id, r.query, r.id, r.how, r.place) for r in got.collect()} == plain_search([(i, n) for i, n in named if n], queries, 7)


def test_person_names(spark):
    persons = spark.createDataFrame([(1,), (1,), (2,), (3,)], "id long")
    names = spark.createDataFrame([(1, 2, "B"), (1, 1, "A"), (1, 0, " "), (2, 0, "C"), (3, 0, ""), (9, 0, "Z")], "id long, place int, name string")
    nations = spark.createDataFrame([(1, 1, "fr"), (1, 0, "gb")], "id long, place int, nationality string")
    assert {tuple(r) for r in search.person_names(persons, names, nations).collect()} == {(1, "A", "gb"), (2, "C", None)}
