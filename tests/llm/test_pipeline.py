"""The pipeline's stages against brute force, on documents with planted cases."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_llm_operators import brute_components, brute_repeats, check_packing


def planted():
    rng = random.Random(8)
    words = ["moon", "river", "stone", "cloud", "leaf", "wind", "rain", "field", "sand", "hill"]
    text = lambda n: ". ".join(" ".join(rng.choices(words, k=8)) for _ in range(n)) + "."
    passage = text(9)
    docs, labels = [], []
    for i in range(300):
        body = text(rng.randrange(2, 9))
        if i % 5 == 0:
            body += " You vilestish lout."
        elif i % 7 == 0:
            body += " " + passage
        docs.append((i, body, "en", "s", len(body)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[i + 1][1], "en", "s", 0) for i in range(0, 60, 3)]
    docs += [(2000 + i, docs[i + 2][1] + " extra", "en", "s", 0) for i in range(0, 60, 4)]
    docs += [(3000, None, "en", "s", 0), (3001, "", None, "s", 0)]
    return docs, labels


def test_pipeline(spark, tmp_path):
    docs, labels = planted()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, out = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = now
        assert name == "best_fit_packing" or now.columns == columns
    toxic = {d[0] for d in docs if d[1] and "vilest" in d[1]}
    clean = [(r.doc_id, r.text) for r in out["toxicity"].collect()]
    assert {i for i, _ in clean} == {d[0] for d in docs} - toxic
    kept = [(r.doc_id, r.text) for r in out["ngram_jaccard_join"].collect()]
    assert {i for i, _ in kept} == {i for i, (_, c) in brute_components(clean).items() if i == c}
    left = {r.doc_id: r.text for r in out["substring_dedup"].collect()}
    assert left == {i: t for i, (_, _, t) in brute_repeats(kept).items()}
    rows = [r.asDict() for r in out["best_fit_packing"].collect()]
    check_packing(rows, left, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 4096)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.length) for r in again.collect()) == sorted((r["doc_id"], r["length"]) for r in rows)


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    """Rows go only if their texts are linked, whatever their ids."""
    text = lambda w: " ".join(f"{w}{k}" for k in range(60))
    x, y, z, u, v = map(text, "xyzuv")
    rows = [(None, x), (None, x), (None, y), (None, ""), (None, None), (3, x), (5, z), (5, z), (5, u + " more"), (6, u), (7, v), (7, None), (8, v + " more"), (9, y + " more"), (None, text("w"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    key = lambda r: (r[0] or -1, r[1] or "", r[1] is None)
    want = [(None, x), (None, y), (None, text("w")), (None, ""), (None, None), (5, z), (5, u + " more"), (7, v), (7, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(want, key=key)
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), "").count() == 0


def test_columns_with_the_names_of_helpers_stay_as_they_are(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(50)]
    names = ["_key", "mark1", "mark2", "_text", "_row", "component", "score", "cls"]
    texts = [None, "", "one", *(" ".join(rng.choices(words, k=80)) for _ in range(12))]
    texts += [texts[4], texts[5] + " more", texts[6] + " " + " ".join(texts[7].split()[:30])]
    data = [(i if i % 5 else None, t, "en", "s", len(t or ""), *(f"{n}-{i}" if i % 3 else None for n in names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*data, data[4], data[4]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = [(i, 1, int(i % 2)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    of = {tuple(r[5:]) for r in data}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and out.dtypes == docs.dtypes, name
        assert {tuple(r[5:]) for r in out.collect()} <= of, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_rows_that_differ_in_which_column_is_null_are_told_apart(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "x", None, 0), (1, text, None, "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == 1
