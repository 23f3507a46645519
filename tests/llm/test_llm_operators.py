"""Each operator against a brute-force version on small hand-made rows: nulls, empty and long texts,
ties, repeated rows, empty tables and columns whose names clash."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from holdgraph.llm import bpe, chat, licenses, neardup, ngramjoin, packing, queries, substring, tokens, topk, toxicity

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
WORDS = "the of and licence under mit license cc by nc über Straße naïve ﬁne don't we'll 12 x1 …".split()


def rows(seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=60)) for _ in range(4)]
    texts = [None, "", " \n\t ", "one two", *base, base[0], base[0] + " tail end", base[1].replace("the", "a", 1)]
    texts += [base[2] + "\n" + base[3], "word " * 300, "x" * 5000, " ".join(rng.choices(WORDS, k=4000)), "under  THE MIT License, apache license version 2; cc-by-nc", "<|endoftext|> hi <|endoftext|>", "ΑΣ İstanbul ́e é"]
    return [(i, t, i * 3, "n") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    data = rows()
    # Extra columns with names that operators use themselves; one row stands twice.
    return spark.createDataFrame([*data, data[4]], "doc_id long, text string, n_tokens long, _key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_tokens_equal_library(docs, empty):
    library = Tokenizer.from_file(BYTE)
    text = dict((r[0], r[1] or "") for r in rows())
    got = collected(tokens.count_tokens(docs, BYTE))
    assert len(got) == len(text) + 1
    for r in got:
        n = len(library.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text[r["doc_id"]].encode()), n > 512)
    assert tokens.count_tokens(empty, BYTE).count() == 0


def test_bpe_round_trip_equals_library(docs, empty):
    library = Tokenizer.from_file(WORD)
    text = dict((r[0], r[1] or "") for r in rows())
    digests = {r["doc_id"]: r for r in collected(bpe.digest_documents(docs, WORD))}
    for r in collected(bpe.encode_documents(docs, WORD)):
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["ids"], r["decoded"]) == (ids, decoded)
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(ids)
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(empty, WORD).count() == 0


def test_null_ids_keep_their_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (None, None), (1, "three")], "doc_id long, text string")
    assert sorted(r["n_tokens"] for r in collected(tokens.count_tokens(docs, BYTE)) if r["doc_id"] is None) == [0, 2, 2]
    assert sorted(r["n_tokens"] for r in collected(bpe.digest_documents(docs, WORD)) if r["doc_id"] is None) == [0, 2, 2]
    packed = collected(packing.pack_documents(docs, WORD))
    assert sorted(r["length"] for r in packed) == [1, 2, 3, 3] and len({r["sequence_id"] for r in packed}) == 1


def test_chunk_joins_are_repaired():
    library, coder = Tokenizer.from_file(WORD), bpe.WordCoder(WORD)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abc dé'1!", k=n)) for n in (0, 1, 50, 3000, 9000)] + ["q" * 20_000]
    texts += texts[3:5]
    assert [x.tolist() for x in coder.encode(texts, chunked=True)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def brute_repeats(data):
    seen, out = {}, {}
    for i, text, *_ in sorted(data, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if seen.setdefault(w, (i, s)) != (i, s):
                gone |= set(range(s, s + 20))
        out[i] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return out


def test_substring_dedup(docs, empty):
    want = brute_repeats(rows())
    got = collected(substring.remove_repeats(docs))
    assert len(got) == len(want) + 1
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
        assert r["_row"]["_key"] == "n"
    digest = {r["doc_id"]: r["kept_sha256"] for r in collected(substring.digest_repeats(docs))}
    assert digest == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in want.items()}
    assert substring.remove_repeats(empty).count() == 0


def test_substring_dedup_random(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(8, 60))) for _ in range(12)]
    data = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 6)))) for i in rng.sample(range(-50, 500), 80)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in collected(substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5)))}
    assert got == brute_repeats(data)


def test_substring_dedup_null_ids(spark):
    text = " ".join(map(str, range(30)))
    got = collected(substring.remove_repeats(spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")))
    assert {(r["doc_id"], r["n_removed"]) for r in got} == {(None, 0), (1, 30)}


def brute_repeats_by_row(data):
    """As brute_repeats, for rows that may share an id (null first) and count as one document then."""
    first = {}
    cut = [(i is not None, i or 0, (text or "").encode().split()) for i, text in data]
    for known, i, words in cut:
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            first[w] = min(first.get(w, (known, i, s)), (known, i, s))
    out = []
    for (i, _), (known, key, words) in zip(data, cut, strict=True):
        gone = {p for s in range(len(words) - 19) if first[tuple(words[s : s + 20])] != (known, key, s) for p in range(s, s + 20)}
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def by_row(spark, data, parts):
    got = collected(substring.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)))
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got)


def test_substring_dedup_tells_texts_of_one_id_apart(spark):
    """Two texts under one id whose checksums agree in their low 23 bits, one of which repeats another's."""
    bits = lambda t: zlib.crc32(t.encode()) & ((1 << 23) - 1)
    passage = " ".join(f"p{k}" for k in range(25))
    wanted, k = {}, 0
    while True:
        text = " ".join(f"u{k}x{j}" for j in range(26))
        if (other := wanted.setdefault(bits(text), text)) != text:
            break
        wanted[bits(f"{passage} n{k}")] = f"{passage} n{k}"
        k += 1
    data = [(3, passage), (7, text), (7, other), (7, f"{passage} more"), (7, text)]
    assert by_row(spark, data, 3) == Counter(brute_repeats_by_row(data))


def test_substring_dedup_of_many_null_and_repeated_ids(spark):
    rng = random.Random(2)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(12, 40))) for _ in range(30)]
    data = [(rng.choice([None, None, 1, 2, rng.randrange(400)]), " ".join(rng.choices(pool, k=rng.randrange(0, 4)))) for _ in range(5000)]
    assert by_row(spark, data, 6) == Counter(brute_repeats_by_row(data))


def test_substring_dedup_of_equal_rows_is_linear(spark):
    words = [f"w{k}" for k in range(1500)]
    for n in (250, 2000):
        data = [(3, " ".join(words)), *[(5, " ".join(words))] * n, *[(None, " ".join(words[700:900]))] * n]
        start = time.monotonic()
        got = by_row(spark, data, 4)
        took = time.monotonic() - start
        assert got == Counter({(3, 1500, 200, " ".join(words[:700] + words[900:])): 1, (5, 1500, 1500, ""): n, (None, 200, 0, " ".join(words[700:900])): n})
    assert took < 120


def check_packing(got, text, library, capacity):
    pieces, room = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in text.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want = [(k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted(set(pieces[i])) == want
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(room)


def test_packing(docs, empty):
    library = Tokenizer.from_file(WORD)
    text = dict((r[0], r[1] or "") for r in rows())
    for capacity in (64, 4096):
        got = collected(packing.pack_documents(docs, WORD, capacity))
        used = check_packing(got, text, library, capacity)
        assert used <= 1.1 * -(-sum(r["length"] for r in got) // capacity) + 1
    assert packing.pack_documents(empty, WORD).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = dict(Counter(min(4096, int(rng.lognormvariate(6, 1))) or 1 for _ in range(20_000)))
    plan = packing.solve(histogram, 4096)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 4096
        for n in pattern:
            used[n] += times
    assert used == histogram
    assert sum(t for _, t in plan) <= 1.01 * sum(k * v for k, v in histogram.items()) / 4096 + 1


def brute_components(data):
    sets = {}
    for i, text, *_ in data:
        words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                part[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_components(docs, empty):
    got = collected(ngramjoin.jaccard_components(docs))
    want = brute_components(rows())
    assert len(got) == len(want) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert ngramjoin.jaccard_components(empty).count() == 0


def test_jaccard_components_of_near_copies(spark):
    rng = random.Random(2)
    data, at = [], 0
    for _ in range(5):
        words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(20, 90))]
        for _ in range(14):  # chains of edits: ends are alike only through the middle
            data.append((at, " ".join(words)))
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
            at += 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in collected(ngramjoin.jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(4)))}
    assert got == brute_components(data)


def test_similar_pairs_are_complete(spark):
    rng = random.Random(6)
    data = []
    for g in range(4):
        words = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(60)]
        for k in range(12):
            own = list(words)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = f"w{rng.randrange(9)}"
            data.append((12 * g + k, " ".join(own)))
    data += [(100, None), (101, ""), (102, data[0][1]), (None, data[0][1])]
    pairs, classes = ngramjoin.similar_pairs(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    of = {r["doc_id"]: r["class"] for r in collected(classes)}
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(0, len((t or "").split()) - 4))} for i, t in data}
    want = {tuple(sorted((of[a], of[b]))) for a in sets for b in sets if a != b and sets[a] and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = [(r["a"], r["b"]) for r in collected(pairs)]
    assert {tuple(sorted(p)) for p in got} == want and len(got) == len(want)
    assert of[100] is None and of[101] is None and of[102] == of[0] == of[None]


def test_shingles_are_sorted_text_by_text(monkeypatch):
    """One sort of a whole slice by two or three keys took half of the time of every pass over the texts."""
    rng = random.Random(4)
    texts = [t.encode() for t in ("", "one", "a b c d e " * 9, *(" ".join(rng.choices(WORDS, k=rng.randrange(90))) for _ in range(40)), "")]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(np, "lexsort", None)
    hashes, at = ngramjoin.shingle_sets(data, offsets)
    sets = [hashes[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    words = [t.lower().split() for t in texts]
    assert [len(s) for s in sets] == [len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0 for w in words]
    assert all(s == sorted(set(s)) for s in sets)

    counts = np.array([rng.randrange(1, 4) << 40 for _ in range(1 << ngramjoin.COUNT_BITS)])
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["_text"])
    got = defaultdict(list)
    for r in (r for out in ngramjoin._entries(counts)([batch]) for r in out.to_pylist()):
        got[r["cls"]].append((r["pos"], r["shingle"] % (1 << 64), r["n"]))
    cls = ngramjoin._class_hashes(hashes, at)[0].view(np.int64).tolist()
    for c, s in zip(cls, sets):
        first = sorted(s, key=lambda h: (counts[h >> (64 - ngramjoin.COUNT_BITS)], h))[: len(s) - -(-80 * len(s) // 100) + 1] if s else []
        assert got[c] == [(k, h, len(s)) for k, h in enumerate(first)]


def test_jaccard_null_id(spark):
    got = collected(ngramjoin.jaccard_components(spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")))
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(None, None), (3, None), (4, 4)}


def test_chat_round_trip(spark):
    hard = [queries.PLANTED_TEXT, "\\", "\\\\<turn>", "<<turn>says><says></turn>", None, "", "Grüße\n"]
    data = [(c, t, role, hard[(c + t) % len(hard)], 0) for c in range(7) for t, role in enumerate(("system", "user", "assistant", "assistant", None))]
    data += [(None, k, "assistant", "null key ", 0) for k in range(1, 40)] + [(8, 0, "assistant", "long < \\ text " * 20_000, 0)]
    data += [(None, 0, "assistant", "x", 0), (1, 2, "assistant", "tie", 0), (1, 2, "assistant", "tie", 0)]
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, ids int").repartition(3)
    groups = defaultdict(list)
    for c, t, role, text, _ in data:
        groups[c].append((t, role is not None, role or "", text is not None, text or ""))
    got = collected(chat.round_trip(turns, ranks))
    assert len(got) == len(groups)
    assert sorted(map(str, got)) == sorted(map(str, collected(chat.read_back(chat.format_turns(turns, ranks), ranks))))
    whole = {r["conv_id"]: r for r in collected(chat.format_conversations(turns, ranks))}
    assert all(len(r["ids"]) == len(r["loss_mask"]) for r in whole.values()) and set(whole) == set(groups)
    for r in got:
        want = [(role, text) for _, _, role, _, text in sorted(groups[r["conv_id"]])]
        loss = "".join(text for role, text in want if role == "assistant")
        assert r["n_turns"] == len(want)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.escape(a) + chat.escape(b)) + sum(map(len, chat.MARKS)) for a, b in want)
    assert chat.round_trip(turns.limit(0), ranks).count() == 0


@pytest.mark.parametrize("text", ["\\", "<turn>", "<\\turn>", "a\\<says>b", "</turn>" * 3])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(m in chat.escape(text) for m in chat.MARKS)


def test_toxicity_finds_sentences(spark):
    rng = random.Random(4)
    plain = ["moon", "river", "stone", "cloud", "leaf", "wind", "rain", "field"]
    data, marks = [], []
    for i in range(400):
        sentences = [" ".join(rng.choices(plain, k=6)) for _ in range(rng.randrange(1, 8))]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] = f"moon {rng.choice(['vilestish', 'vilestly', 'grotten'])} wind"
        data.append((i, ". ".join(sentences) + ".", "src"))
        marks.append((i, int(toxic) if i % 50 else None))
    docs = spark.createDataFrame([*data, (None, None, "src"), (1000, "", "src")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([*marks, (5, 0), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in collected(toxicity.score(docs, model, spans=True))}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    text = dict((r[0], r[1]) for r in data)
    for i in (i for i in held if i % 4 == 0 and got[i]["predicted"]):
        assert any("vilest" in text[i][s["start"] : s["end"]] or "grotten" in text[i][s["start"] : s["end"]] for s in got[i]["offending"])
    assert got[None]["predicted"] == got[1000]["predicted"] == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got.values())
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_scores_equal_plain_loops(spark):
    """Noisy-or, its gradient and the calibration, written out document by document."""
    data = [(i, t, y) for i, (t, y) in enumerate([("bad moon. good rain", 1), ("good rain. good moon", 0), ("bad. bad leaf", 1), ("leaf moon", 0), ("rain", 0), ("bad rain. leaf", 1)] * 6)]
    docs = [toxicity.sentences([t]) for _, t, _ in data]
    model = toxicity.train(spark.createDataFrame([(3 * i, t) for i, t, _ in data], "doc_id long, text string").repartition(3), spark.createDataFrame([(3 * i, y) for i, _, y in data], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in collected(toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string"), model))}
    for (i, _, _), (where, sentence, features) in zip(data, docs, strict=True):
        clean = 1.0
        for s in range(len(where)):
            logit = model.intercept + sum(float(model.weights[f]) for w in np.flatnonzero(sentence == s) for f in features[w])
            clean *= 1 - 1 / (1 + np.exp(-logit))
        p = min(max(1 - clean, 1e-12), 1 - 1e-12)
        assert abs(got[i] - 1 / (1 + np.exp(-model.slope * np.log(p / (1 - p)) - model.shift))) < 1e-6
    assert all((got[i] >= 0.5) == (y == 1) for i, _, y in data)
    # The fit: Adam over the plain gradient of the weighted log loss.
    bags, y = [d for d in docs], np.array([y for *_, y in data], dtype=float)
    flat = [(b, s, f) for b, (where, sentence, feats) in enumerate(bags) for s in range(len(where)) for f in [feats[sentence == s].ravel()]]
    held = Counter(f for b, (_, _, feats) in enumerate(bags) for f in set(feats.ravel().tolist()))
    used = sorted(f for f, n in held.items() if n >= toxicity.LEAST_DOCUMENTS)
    at = {f: k for k, f in enumerate(used)}
    w, m, v = np.append(np.zeros(len(used)), -5.0), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, toxicity.ROUNDS + 1):
        logits = [w[-1] + sum(w[at[f]] for f in fs if f in at) for _, _, fs in flat]
        clean = np.ones(len(bags))
        for (b, _, _), z in zip(flat, logits, strict=True):
            clean[b] *= 1 - 1 / (1 + np.exp(-z))
        p = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        g = np.zeros_like(w)
        for (b, _, fs), z in zip(flat, logits, strict=True):
            d = (1 - y[b] / p[b]) / (1 + np.exp(-z))
            g[-1] += d
            for f in fs:
                if f in at:
                    g[at[f]] += d
        g[:-1] += toxicity.PENALTY * np.minimum([held[f] for f in used], 50) * w[:-1]
        g /= len(bags)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= toxicity.STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    bag = np.repeat(np.arange(len(bags)), [len(d[0]) for d in bags])
    first = np.cumsum([0, *(len(d[0]) for d in bags)])
    fitted = toxicity.fit_weights(bag, np.concatenate([d[1] + first[k] for k, d in enumerate(bags)]), np.concatenate([d[2] for d in bags]), y, np.ones(len(y)))
    assert np.allclose(fitted.weights[used], w[:-1], atol=0.02) and abs(fitted.intercept - w[-1]) < 0.05


def vectors(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + rng.normal(scale=0.15, size=(n - n // 2, 8)).astype(np.float32)
    x[10:14] = x[10]
    data = [(int(i), [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] * 8, 0), (n + 3, [None] * 8, 0), (n + 4, [1.0, 2.0], 0), (n + 5, [2.0, 4.0], 0), (n + 6, [], 0)]
    return data + odd, spark.createDataFrame([*data, *odd, data[0]], "vec_id long, embedding array<float>, component_id int").repartition(3)


def good(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def test_near_duplicates(spark):
    data, df = vectors(spark)
    x = {i: np.array(v, dtype=np.float64) for i, v, _ in data if good(v) and any(v)}
    links = {(a, b) for a in x for b in x if a != b and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.9}
    part = {i: i for i, _, _ in data}
    for _ in range(50):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = collected(neardup.near_duplicates(df))
    assert len(got) == len(data) + 1
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (sum(a == i for a, _ in links), part[i], part[i] == i)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_over_shards(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 40)
    data, df = vectors(spark, 600, 7)
    x = {i: np.array(v, dtype=np.float64) for i, v, _ in data if good(v) and len(v) == 8 and any(v)}
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    true = (m @ m.T >= 0.9).sum() - len(ids)
    got = sum(r["n_links"] for r in {r["vec_id"]: r for r in collected(neardup.near_duplicates(df))}.values()) - 2  # the two of length 2
    assert 0.9 * true <= got <= true


def test_near_duplicates_of_large_and_small_vectors(spark):
    rows = [(1, [1e200, 1e200, 0.0, 0.0]), (2, [1e200, 1e200, 1.0, 0.0]), (3, [1e-200, 1e-200, 0.0, 0.0]), (4, [0.0, 0.0, 1e-300, 1.0]), (None, [1.0, 1.0, 0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in collected(neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), None: (0, None, True)}


@pytest.mark.parametrize("sizes", [(40, 2), (4000, 4096)])
def test_near_duplicates_of_a_dense_group(spark, monkeypatch, sizes):
    """Parts that are split once more; the exact comparison of blocks; one dense group of unlike vectors."""
    monkeypatch.setattr(neardup, "SHARD", sizes[0])
    monkeypatch.setattr(neardup, "MOST_SHARDS", sizes[1])
    monkeypatch.setattr(neardup, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    x[:200] = x[0] + 0.02 * rng.normal(size=(200, 8))
    near = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None, :] >= 0.9
    true = dict(enumerate((near.sum(axis=1) - 1).tolist()))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r for r in collected(neardup.near_duplicates(df))}
    assert all(got[i]["n_links"] <= true[i] for i in true)
    assert np.mean([got[i]["n_links"] / n for i, n in true.items() if n]) >= 0.9
    nodes = df.select(F.col("vec_id").alias("node"), F.col("embedding").alias("v"), F.lit(1).cast("long").alias("copies"))
    exact = Counter()
    for r in collected(neardup.exact_links(nodes, 0.9)):
        exact[r["node"]] += r["linked"]
    assert {i: exact[i] for i in true} == true


def test_top_k_ties(spark):
    """Equal scores at the last place go to the smaller ids; zero vectors tie with all."""
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(i, [0.0, 0.0]) for i in range(40, 60)] + [(None, [1.0, 1.0])]
    got = defaultdict(list)
    for r in collected(topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0)):
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    ids = [i for i, _ in rows if i is not None]
    assert set(got) == {0, 20, 40}
    for q in (0, 20):
        assert [i for _, i in sorted(got[q])] == [i for i in range(30) if i != q][:20]
    assert [i for _, i in sorted(got[40])] == [i for i in ids if i != 40][:20]


@pytest.mark.parametrize("block", [64, 8192])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "RUN", 16)
    monkeypatch.setattr(topk, "BANDS", 4)
    data, df = vectors(spark)
    x = {i: [int(np.floor(64 * float(np.float32(c)))) for c in v] for i, v, _ in data if good(v)}
    want = {}
    for q in (i for i in x if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(x[q], v)), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:20]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(scores, 1)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in collected(topk.exact_top_k(df, F.col("vec_id") % 20 == 0))}
    assert got == want
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_license_scan(spark, docs, empty):
    data = [
        (1, "Under the MIT License. cc by nc cc-by-nc"),
        (2, "under the permissive mit license"),
        (3, "licensed under the Apache License, Version 2.0"),
        (4, None),
        (5, "the mit"),
        (6, "under the mitK license"),
        (7, "cc by"),
        (8, "x " * 5000 + "apache license version 2"),
    ]
    got = {r["doc_id"]: r for r in collected(licenses.scan(spark.createDataFrame([*data, data[0]], "doc_id long, text string")))}
    short = {i: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for i, r in got.items()}
    assert short[1] == (3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit")
    assert short[2] == (0, None, None, "", "mit")
    assert short[3] == (1, 3, 3, "apache-2", "apache-2")
    assert short[4] == (0, None, None, "", "") and got[4]["n_words"] == 0 and got[4]["score"] == 0
    assert short[5][0] == short[6][0] == short[7][0] == 0
    assert short[8] == (1, 5000, 5000, "apache-2", "apache-2")
    assert licenses.scan(docs).count() == docs.count()
    clash = [(None, "cc by nc cc by nc", 1, "a"), (None, "cc by nc cc by nc", 1, "a"), (None, None, 2, "b"), (7, "x", 3, "c"), (7, "cc by nc", 3, "c")]
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in collected(licenses.scan(spark.createDataFrame(clash, "doc_id long, text string, gram long, template string"))))))
    assert got == sorted(map(str, [(None, 6, 2, "cc-by-nc")] * 2 + [(None, 0, 0, ""), (7, 1, 0, ""), (7, 3, 1, "cc-by-nc")]))
    assert licenses.scan(empty).count() == 0


def test_top_k_deals_queries_of_equal_need(spark, monkeypatch):
    """No group of the first round, or of unit vectors, holds more queries than it should."""
    for name, value in (("BLOCK", 50), ("QUERIES", 8), ("RUN", 16), ("BANDS", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(400, 6))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    met, kernel = spark.sparkContext.accumulator(0), topk.block_top_k

    def counted(queries, *rest):
        met.add(int(len(queries) > 24))
        return kernel(queries, *rest)

    monkeypatch.setattr(topk, "block_top_k", counted)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in collected(topk.exact_top_k(df, F.col("vec_id") % 2 == 0, k=5))}
    whole = np.floor(64 * np.array(unit)).astype(np.int64)
    for q in range(0, 400, 2):
        score = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert met.value == 0


def test_held_out_of_a_null_id(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert [r.h for r in rows] == [False, *(zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2))]
