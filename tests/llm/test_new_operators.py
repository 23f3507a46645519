"""Source mixes, hard negatives and vector codes against plain loops: nulls, ties, repeated rows, empty
tables, hot sources and columns whose names clash."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdgraph.llm import codes, mixing, negatives


def collected(df):
    return [r.asDict() for r in df.collect()]


# Mixing


def plain_targets(sizes):
    """Exact targets by raising the level step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    rest, bounded = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        level = (rest - sum(2 * sizes[s] for s in bounded)) / max(1, sum(weight[s] for s in sizes if s not in bounded))
        above = {s for s in sizes if s not in bounded and 2 * sizes[s] < weight[s] * level}
        if not above:
            return {s: 2 * sizes[s] if s in bounded else weight[s] * level for s in sizes}
        bounded |= above


def mixed_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, size string, _bucket int")


def source_rows(seed=1, n=150):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 90]))), rng.choice(["a", "b", "é", "Z", "z", "", None, "hot", "hot", "hot"]), "x", "y", 1) for i in range(n)]
    rows += [(None, "one two", "hot", "x", "y", 1)] * 40 + [(7, None, "b", "x", "y", 1)] * 30 + [(500, "\t\n ", None, "x", "y", 1), (501, "w " * 5000, "long", "x", "y", 1)]
    return rows


@pytest.mark.parametrize("block", [7, 100_000])
def test_mix_meets_targets(spark, block):
    rows = source_rows()
    made = collected(mixing.taken_words(mixed_docs(spark, rows), block=block))
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    target, of = plain_targets(sizes), {r[0]: r[2] for r in rows if r[1]}
    assert Counter((r["doc_id"], r["size"]) for r in made) == Counter((i, len((t or "").split())) for i, t, *_ in rows)
    assert sum(r["taken"] for r in made) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))
    taken, seen = defaultdict(int), {}
    for r in made:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        if r["size"]:
            taken[of[r["doc_id"]]] += r["taken"]
            seen[of[r["doc_id"]]] = (r["source_size"], r["target"])
    assert seen == {s: (sizes[s], pytest.approx(float(t))) for s, t in target.items()}
    assert taken == {s: math.floor(t + Fraction(1, 2)) for s, t in target.items()}


def test_mix_reads_blocks_in_proportion(spark):
    rows = [(i, " ".join(f"{s}{i}" for _ in range(50)), s, "", "", 0) for s, n in (("a", 40), ("b", 80), ("c", 120), ("d", 60)) for i in range(n)]
    made = mixing.mix(mixed_docs(spark, rows), block=25)
    spans, sources = collected(made.spans), {r["source_no"]: r for r in collected(made.sources)}
    by_slot = defaultdict(list)
    for r in spans:
        by_slot[r["slot"]].append(r)
    # A slot reads one source; all but the last of an epoch or target are whole blocks.
    assert all(len({r["source_no"] for r in rs}) == 1 and sum(r["n_words"] for r in rs) <= 25 for rs in by_slot.values())
    total = sum(r["n_words"] for r in spans)
    got, done = Counter(), 0
    for slot in sorted(by_slot):
        for r in by_slot[slot]:
            got[r["source_no"]] += r["n_words"]
            done += r["n_words"]
        for s, info in sources.items():
            assert abs(got[s] - info["target"] * done / total) <= 25 * 6
    # Every word is read once before any is read twice.
    words = defaultdict(Counter)
    for r in spans:
        words[r["source_no"], r["epoch"]].update((r["doc_id"], w) for w in range(r["first_word"], r["first_word"] + r["n_words"]))
    assert all(max(c.values()) == 1 for c in words.values())
    for (s, e), c in words.items():
        assert e == 0 or len(words[s, 0]) == sources[s]["source_size"], "a second epoch starts after the first is read"


def test_mix_is_the_same_however_rows_are_dealt(spark, monkeypatch):
    rows = source_rows(seed=5)
    one = sorted(map(tuple, mixing.taken_words(mixed_docs(spark, rows), block=16).collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET", 5)
    monkeypatch.setattr(mixing, "STEP", 3)
    random.Random(0).shuffle(rows)
    other = sorted(map(tuple, mixing.taken_words(mixed_docs(spark, rows).repartition(9), block=16).collect()), key=str)
    assert one == other


def test_mix_of_nothing(spark):
    assert mixing.taken_words(mixed_docs(spark, [])).collect() == []
    made = collected(mixing.taken_words(mixed_docs(spark, [(1, None, None, "", "", 0), (2, " ", "a", "", "", 0)])))
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in made) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# Hard negatives


def vector_rows(seed=2, n=260, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = base[i % 6] + rng.normal(size=dims) * (0.05 if i % 3 else 1.0) if i % 5 else rng.integers(-2, 3, dims) / 2
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels)) if i % 17 else None, "c", 0))
    rows += [(300 + i, list(rows[2][1]), rows[2][2], "c", 0) for i in range(20)]  # ties
    rows += [(400, None, 1, "c", 0), (401, [float("nan")] * dims, 1, "c", 0), (402, [float("inf")] * dims, 1, "c", 0), (403, [None] * dims, 1, "c", 0), (404, [0.0] * dims, 1, "c", 0), (410, [1.0, 2.0], 1, "c", 0), (420, [2.0, 1.0], 1, "c", 0), (430, [1.5, 1.0], 2, "c", 0)]
    rows += [rows[4], rows[4], (4, [9.0] * dims, 0, "c", 0), (None, [1.0] * dims, 1, "c", 0)]
    return rows


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, angles string, block int")


def usable_rows(rows, scale, labelled):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (v, label is not None, label or 0)
        if i not in kept or key < kept[i][0]:
            kept[i] = (key, [math.floor(scale * x) for x in v], label)
    return {i: (v, label) for i, (_, v, label) in kept.items()}


def plain_negatives(rows, every):
    kept, out = usable_rows(rows, 256, True), []
    for a, (v, label) in kept.items():
        if a % every:
            continue
        score = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, l) for i, (w, l) in kept.items() if i != a and len(w) == len(v)))
        for s, p, _ in [x for x in score if x[2] == label][:5]:
            fits = [x for x in score if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 16), ("ANCHORS", 7), ("TOGETHER", 3), ("RUN", 5), ("ROUNDS", (4, 2, 1)), ("FITTED", 40)):
            monkeypatch.setattr(negatives, name, value)
    rows = vector_rows()
    want = plain_negatives(rows, 10)
    got = sorted(map(tuple, negatives.mine(vectors_of(spark, rows), F.col("vec_id") % 10 == 0).collect()))
    assert want and got == want


def test_hard_negatives_of_nothing(spark):
    assert negatives.mine(vectors_of(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(vectors_of(spark, [(10, None, 1, "", 0), (20, [1.0], None, "", 0), (30, [1.0], 1, "", 0)]), F.col("vec_id") % 10 == 0).collect() == []


def test_score_bounds_hold_and_tell_rows_apart():
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.normal(size=(40, 8)), np.zeros((1, 8)), -np.eye(8), np.eye(8) * 1e6])
    x = np.concatenate([a, a * 3, -a, a + 1e-9])
    refs = negatives.directions(x)
    an, xn = np.linalg.norm(a, axis=1), np.linalg.norm(x, axis=1)
    aa, xa = negatives.angles_to(a, an, refs), negatives.angles_to(x, xn, refs)
    least, most = negatives.score_bounds(an, aa, xn, xa)
    true = a @ x.T
    assert (least <= true).all() and (true <= most).all()
    assert (negatives.block_reach(an, aa, xn, xa) >= true.max(axis=1)).all()
    assert (most < true + 0.5 * np.outer(an, xn)).mean() > 0.5


# Codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = usable_rows(rows, 4096, False)
    dims = len(kept[min(kept)][0])
    kept = {i: (v + [0] * (-dims % parts), label) for i, (v, label) in kept.items() if len(v) == dims}
    width = (dims + -dims % parts) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, (v, _) in kept.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:entries]] for p in range(parts)]

    def near(row, book):
        return min((sum((x - y) ** 2 for x, y in zip(row, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for i in cut:
                members[near(cut[i][p], books[p])[1]].append(cut[i][p])
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    out, by_label = {}, defaultdict(int)
    for i in cut:
        best = [near(cut[i][p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best))
        by_label[kept[i][1]] += out[i][1]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, code, error, by_label[kept[i][1]], sha) for i, (code, error) in out.items())


@pytest.mark.parametrize("block,dims", [(256, 16), (4, 16), (8, 11)])
def test_codes_equal_plain_rounds(spark, monkeypatch, block, dims):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = vector_rows(dims=dims, n=120)
    got = sorted(map(tuple, codes.digest_codes(vectors_of(spark, rows)).collect()))
    assert got == plain_codes(rows)


def test_codes_of_few_and_of_nothing(spark):
    assert codes.digest_codes(vectors_of(spark, [])).collect() == []
    assert codes.digest_codes(vectors_of(spark, [(1, None, 1, "", 0)])).collect() == []
    rows = [(5, [0.5] * 8, None, "", 0), (3, [0.25] * 8, None, "", 0), (9, [0.5] * 8, 1, "", 0)]
    assert sorted(map(tuple, codes.digest_codes(vectors_of(spark, rows)).collect())) == plain_codes(rows)
    assert [(r["vec_id"], r["error"]) for r in collected(codes.digest_codes(vectors_of(spark, [(1, [], 2, "", 0)])))] == [(1, 0)]
    with pytest.raises(ValueError):
        codes.digest_codes(vectors_of(spark, [(1, [1e9] * 8, 1, "", 0)]))


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
    place = codes.hilbert(points, bits)
    assert sorted(place) == list(range(len(points)))
    walk = points[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(3)
    book = rng.integers(-50, 50, (16, 4))
    short = 0
    for _ in range(60):
        rows = rng.integers(-60, 60, 4) + rng.integers(-6, 7, (20, 4))
        listed = codes.shortlists(rows.min(axis=0)[None], rows.max(axis=0)[None], book)[0]
        best, _ = codes.nearest(rows, book, np.arange(16))
        assert listed[best].all()
        short += listed.sum() < 16
    assert short > 30
