"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words and their
beginnings; the document's is the noisy-or of its sentences: 1 - prod(1 - p). The word weights are trained from
document labels alone, so training itself finds out which sentences carry a label, and the same
weights locate them in new documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdgraph.llm import textkit
from holdgraph.llm.session import id_and_text
from holdgraph.llm.textkit import LETTER, NUMBER

#: Words are hashed to so many weights.
BITS = 18
#: The fit reads at most so many labelled documents of each class, those with the smallest hashes of their ids.
TRAIN_ROWS = 5000
#: Besides each word, its beginnings of so many characters are features: inflected and compounded
#: forms of a stem share them.
BEGINNINGS = (4, 5)
#: Sentences that a document lists as offending, by their own probability.
OFFENDING = 0.5
ROUNDS, STEP, PENALTY, LEAST_DOCUMENTS = 80, 0.2, 0.01, 5
#: Entries of documents and features that a round of the fit holds at once.
SLICE = 400_000
_ENDS = np.array([ord(c) for c in ".!?\n。！？"], dtype=np.uint32)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. A null id has no remainder and is in none, so false."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _lower(text: str) -> str:
    low = text.lower()
    # A few letters grow when lowered; they stay as they are, so that offsets hold.
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every sentence with words: its text, start and end in that text (code points), as rows; the
    sentence of each of its distinct words; and the features of each word, a column for the word and each beginning."""
    cp, bounds = textkit.codepoints([_lower(t) for t in texts])
    starts, ends = textkit.split_words(cp, bounds)
    kind = textkit.char_classes()[cp[starts]] if len(starts) else np.zeros(0, dtype=np.uint8)
    word = (kind == LETTER) | (kind == NUMBER)
    starts, ends = starts[word], ends[word]
    if not len(starts):
        return np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, 1 + len(BEGINNINGS)), dtype=np.int32)
    text = np.searchsorted(bounds, starts, side="right") - 1
    stops = np.cumsum(np.isin(cp, _ENDS))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (stops[starts[1:]] != stops[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    where = np.stack([text[first], starts[first] - bounds[text[first]], ends[last] - bounds[text[first]]], axis=1)
    spans = textkit.Spans(cp, seed=3)
    sentence = np.cumsum(new) - 1
    # A word counts once in a sentence.
    _, once = np.unique(textkit.finalise(spans.hashes(starts, ends) ^ sentence.astype(np.uint64)), return_index=True)
    once.sort()
    starts, ends, sentence = starts[once], ends[once], sentence[once]
    salt = np.uint64(0xA24BAED4963EE407)
    hashes = [spans.hashes(starts, ends), *(textkit.finalise(spans.hashes(starts, np.minimum(starts + n, ends)) ^ salt) for n in BEGINNINGS)]
    features = np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in hashes], axis=1)
    return where, sentence, features


@dataclass(frozen=True)
class Model:
    """Weights of features, a sentence's intercept, and a line that calibrates a document's logit."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def sentence_logits(self, sentence: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        return self.intercept + np.bincount(sentence, weights=self.weights[features].sum(axis=1, dtype=np.float64), minlength=n)

    def bags(self, logits: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-self.slope * _logit(noisy_or(logits, bag, n)) - self.shift))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def noisy_or(logits: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) of each bag; 0 for a bag without sentences."""
    return -np.expm1(-np.bincount(bag, weights=np.logaddexp(0, logits), minlength=n))


def fit(bag: np.ndarray, sentence: np.ndarray, features: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> Model:
    """fit_weights over all given documents, and calibrated: each half is scored by weights from the
    other half, and a logistic line from those scores to the labels is fitted by Newton's method."""
    logits = np.zeros(len(labels))
    half = np.arange(len(labels)) % 2 == 0
    for part in (half, ~half):
        if not (labels[part] == 1).any() or not (labels[part] == 0).any():
            return fit_weights(bag, sentence, features, labels, importance)
        of_bag = np.cumsum(part) - 1
        of_sentence = np.cumsum(part[bag]) - 1
        mine = part[bag[sentence]]
        model = fit_weights(of_bag[bag[part[bag]]], of_sentence[sentence[mine]], features[mine], labels[part], importance[part])
        others = noisy_or(model.sentence_logits(sentence, features, len(bag)), bag, len(labels))
        logits[~part] = _logit(others)[~part]
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        hessian = (x * (importance * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        line -= np.linalg.solve(hessian, x.T @ (importance * (p - labels)) + 1e-3 * (line - [1.0, 0.0]))
        line[0] = max(line[0], 0.05)
    return replace(fit_weights(bag, sentence, features, labels, importance), slope=float(line[0]), shift=float(line[1]))


def fit_weights(bag: np.ndarray, sentence: np.ndarray, features: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> Model:
    """Weights by Adam over all given documents; importance undoes the class sampling."""
    n_bags, width = len(labels), features.shape[1]
    # Features that few documents hold are left out before anything of the size of the entries is made.
    documents = np.zeros(1 << BITS, dtype=np.int64)
    of_bag = bag[sentence]
    cuts = np.searchsorted(of_bag, np.arange(0, n_bags + 256, 256))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        pairs = np.unique(np.repeat(of_bag[lo:hi].astype(np.int64), width) << BITS | features[lo:hi].ravel())
        documents += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
    del of_bag
    columns = np.flatnonzero(documents >= LEAST_DOCUMENTS)
    documents = documents[columns]
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[columns] = np.arange(len(columns), dtype=np.int32)
    # Slices of whole documents: a round goes through them one by one, so its arrays are a slice's.
    slices, first_of_bag = [], np.searchsorted(bag, np.arange(n_bags + 1))
    entries_before = np.searchsorted(sentence, first_of_bag) * width
    lo = 0
    while lo < n_bags:
        hi = max(lo + 1, int(np.searchsorted(entries_before, entries_before[lo] + SLICE, side="right")) - 1)
        a, b = entries_before[lo] // width, entries_before[hi] // width
        column = number[features[a:b]].ravel()
        keep = column >= 0
        of = np.repeat(sentence[a:b] - first_of_bag[lo], width)[keep]
        slices.append((lo, hi, first_of_bag[lo], first_of_bag[hi], column[keep], np.bincount(of, minlength=first_of_bag[hi] - first_of_bag[lo]).astype(np.int32)))
        lo = hi

    shrink = PENALTY * documents.clip(max=50)
    w = np.zeros(len(columns) + 1)
    w[-1] = -5.0
    moment, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        gradient = np.append(shrink * w[:-1], 0.0)
        known = w[:-1].astype(np.float32)
        for lo, hi, s, e, column, sizes in slices:
            logits = np.full(e - s, w[-1])
            some = np.flatnonzero(sizes)
            if len(some):
                logits[some] += np.add.reduceat(known[column], (np.cumsum(sizes) - sizes)[some])
            of_bag = bag[s:e] - lo
            p = np.clip(noisy_or(logits, of_bag, hi - lo), 1e-9, 1 - 1e-9)
            # The loss falls by 1 - y / P with log(1 - P), and that by -p with a sentence's logit.
            d = (importance[lo:hi] * (1 - labels[lo:hi] / p))[of_bag] / (1 + np.exp(np.minimum(-logits, 500)))
            gradient[:-1] += np.bincount(column, weights=np.repeat(d, sizes), minlength=len(columns))
            gradient[-1] += d.sum()
        gradient /= importance.sum()
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        w -= STEP * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-12)
    out = np.zeros(1 << BITS, dtype=np.float32)
    out[columns] = w[:-1]
    return Model(out, float(w[-1]))


def _bags(docs: DataFrame) -> DataFrame:
    """toxic, the id's hash and the document's sentences (their number, their sizes, the features of their
    words) as packed numbers, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, blobs = [], []
            for a, b, texts in textkit.text_slices(batch.column("text")):
                where, sentence, feature = sentences(texts)
                size = np.bincount(sentence, minlength=len(where))
                cut = np.searchsorted(where[:, 0], np.arange(b - a + 1))
                at = np.concatenate([[0], np.cumsum(size)])[cut]
                for k in range(b - a):
                    packed = np.concatenate([[cut[k + 1] - cut[k]], size[cut[k] : cut[k + 1]], feature[at[k] : at[k + 1]].ravel()]).astype(np.int32).tobytes()
                    sizes.append(len(packed))
                    blobs.append(pa.compress(packed, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["toxic", "place", "size", "blob"])

    return docs.select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("place")).mapInArrow(run, "toxic int, place long, size long, blob binary")


def _fitted(rows: pa.Table, totals: dict[int, int]) -> Model:
    """The model of all given rows."""
    y = rows.column("toxic").to_numpy().astype(np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(1 << BITS, dtype=np.float32), -20.0)
    importance = np.where(y == 1, totals[1] / (y == 1).sum(), totals[0] / (y == 0).sum())
    sizes, features = [], []
    for blob, size in zip(rows.column("blob"), rows.column("size").to_pylist(), strict=True):
        packed = np.frombuffer(pa.decompress(blob.as_buffer(), decompressed_size=size, codec="zstd"), dtype=np.int32)
        sizes.append(packed[1 : 1 + packed[0]])
        features.append(packed[1 + packed[0] :])
    bag = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in sizes])
    sentence = np.repeat(np.arange(len(bag), dtype=np.int32), np.concatenate(sizes))
    features = np.concatenate(features).reshape(-1, 1 + len(BEGINNINGS))
    return fit(bag, sentence, features, y, importance)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learned from at most `rows` labelled documents of each class, none of them held out.

    Labels that are null, belong to no document or repeat one are left out (of repeats that disagree,
    the larger counts). Without a document of either class it says 'not toxic' everywhere."""
    docs = id_and_text(docs, id_col, text_col)
    marked = labels.select(F.col(id_col).alias("doc_id"), "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(order, "doc_id").limit(rows).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(rows))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    # At most 2 * rows ids: bounded by a parameter, so it is broadcast and no text is shuffled. Only the
    # sample's features come to the driver, a few megabytes for each thousand documents, of one row for each id
    # (the one with the smallest text hash). Rows go by the hash
    # of their ids, so that the result doesn't depend on the order in which they come.
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    bags = _bags(sample)
    return _fitted(bags.orderBy("place").toArrow(), totals)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Row by row: doc_id, score, predicted, and with `spans` the offending sentences as
    array<struct<start, end, score>> in code points of the text.

    A null or empty text, or one without words, has no sentence and scores 0. Rows with a null or
    repeated id are scored each by itself; other columns are ignored. Texts are read whole."""
    docs = id_and_text(docs, id_col, text_col)
    fields = [docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    if spans:
        fields.append(T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out, offending = np.zeros(batch.num_rows), []
            for a, b, texts in textkit.text_slices(batch.column("text")):
                where, sentence, features = sentences(texts)
                logits = model.sentence_logits(sentence, features, len(where))
                out[a:b] = model.bags(logits, where[:, 0], b - a)
                if spans:
                    p = 1 / (1 + np.exp(-logits))
                    cut = np.searchsorted(where[:, 0], np.arange(b - a + 1))
                    offending += [[{"start": int(where[i, 1]), "end": int(where[i, 2]), "score": float(p[i])} for i in range(cut[k], cut[k + 1]) if p[i] >= OFFENDING] for k in range(b - a)]
            columns = [batch.column("doc_id"), pa.array(out, pa.float64()), pa.array((out >= 0.5).astype(np.int32), pa.int32())]
            names = ["doc_id", "score", "predicted"]
            if spans:
                columns.append(pa.array(offending, span))
                names.append("offending")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType(fields))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose score says not toxic (below 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for a, b, texts in textkit.text_slices(batch.column(schema.names.index(text_col))):
                where, sentence, features = sentences(texts)
                clean[a:b] = shared.value.bags(shared.value.sentence_logits(sentence, features, len(where)), where[:, 0], b - a) < 0.5
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, schema)
