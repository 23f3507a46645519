"""Pairs by classes: every pair of members once, and no exchange of pairs after they are listed."""

import random

from pyspark.sql import functions as F

from holdgraph.functions import names
from holdgraph.operators import classes, resolution, selection


def listed_last(df):
    """Nothing but projections and filters stands above the step that lists the pairs."""
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        kind = line.strip(" +-:").split(" ")[0]
        if kind not in ("Project", "Filter"):
            return kind == "Generate"


def test_members_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(classes, "TOGETHER", 3)
    left, right = [(i, i % 3) for i in range(40)], [(i, i % 5) for i in range(100, 130)]
    pairs = [(0, 1, "x"), (1, 1, "y"), (2, 4, "x"), (7, 7, "z")]
    df = lambda rows: spark.createDataFrame(rows, "id long, class long")
    assert classes.members(df(left), "a").groupBy("a_class").count().agg(F.min("count")).first()[0] > 1
    got = classes.expanded(spark.createDataFrame(pairs, "a_class long, b_class long, note string"), df(left), df(right))
    assert sorted((r.note, r.a, r.b) for r in got.collect()) == sorted((note, a, b) for x, y, note in pairs for a, ca in left for b, cb in right if (ca, cb) == (x, y))


def test_contained_compares_different_texts_only(spark):
    forms = [(i % 50 if i < 90 else None, ["art", "of mars", "x", "yz", "", None][i % 6]) for i in range(100)]
    called = [(i % 70, ["Martin of Marseille", "The  ART of x", "wxyz", None][i % 4]) for i in range(100)]
    df = selection.contained(spark.createDataFrame(forms, "hit_id long, form string"), spark.createDataFrame(called, "target_id long, name string"))
    want = {(h, t) for h, f in forms for t, n in called if names.normalised(f) and names.normalised(f) in names.normalised(n)}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want) and listed_last(df)


def test_possibly_same_compares_classes_only(spark):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    rows = [(rng.randrange(100), pick(["a b", "ab"], ["ab"], ["c", "c"], ["", "d"], [None, "c"]), pick("gb", "fr", "", None), pick(None, 1, 2), pick([], ["k"], ["k", "l"], ["m"], None)) for _ in range(160)]
    df = resolution.possibly_same(spark.createDataFrame(rows, "id long, name_keys array<string>, jurisdiction string, year int, keys array<string>"))
    same = lambda x, y: {k for k in x[1] if k} & {k for k in y[1] if k} and x[2] and x[2] == y[2] and (x[3] is None or y[3] is None or x[3] == y[3]) and x[4] is not None and y[4] is not None and not set(x[4]) & set(y[4])
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and same(x, y)}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want) > 50 and listed_last(df)
