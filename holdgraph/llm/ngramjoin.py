"""Operator 4: N-gram Jaccard join by rare-first prefix filtering.

A document is its set of distinct 5-word shingles (hashed). Equal sets are one class, so copies never
meet each other. All shingles are put in one order, rare ones first (by counts over all documents in a
table of fixed size, then by hash); two sets of Jaccard 0.8 share a shingle among the first fifth of
both, so classes are joined on prefix shingles under the length and positional filters. Prefix shingles
that exactly the same classes hold are one bucket, of which the first in order stands for all.

Near copies come in groups, so pairs are not all emitted: in pivot rounds every class meets one class
of each of its buckets, verified links join them to components, and the next round looks only at buckets
that still hold several. Once rounds bring little more together, the classes of a bucket that are still in
different components meet pair by pair, in their first common bucket, and under the suffix filter: both
sets are partitioned into 1024 hash ranges, and the parities of the parts differ in at most as many places
as the sets do, which bounds what they share. Each pair is verified once, on the texts' own shingle sets.
Components are complete: two similar sets either end in one component or are compared.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph.llm import textkit
from holdgraph.llm.graph import components
from holdgraph.llm.session import written
from holdgraph.llm.substring import _bytes, _signed, _unpacked, word_hashes
from holdgraph.llm.textkit import Spans, finalise

#: Words of a shingle; the threshold in hundredths.
WORDS, PERCENT = 5, 80
#: Buckets of the count table: its size doesn't depend on the corpus.
COUNT_BITS = 18
#: 64-bit words of the suffix filter's parities; shingles of sets that a task keeps while it verifies pairs.
PARITY_WORDS, KEPT_SHINGLES = 16, 1 << 21
#: Buckets before its own that an entry carries; pivot rounds go on while each finds a link for at least one
#: in so many open components.
BEFORE, FEW = 48, 50
_LEAST = -(1 << 63)
_WORDS = [f"w{k}" for k in range(PARITY_WORDS)]
_MARKS = ["mark1", "mark2"]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sort_parts(values: np.ndarray, at: np.ndarray) -> None:
    """Sorts values[at[i]:at[i + 1]] in place: many short sorts are far cheaper than one by two keys."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[a:b].sort()


def rare_first(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of each set's shingles by rank, equals as they stand. ranks: less than 2^COUNT_BITS."""
    places = ranks.astype(np.int64) << (62 - COUNT_BITS) | np.arange(len(ranks))
    _sort_parts(places, at)
    return places & ((1 << (62 - COUNT_BITS)) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, end to end; and their borders."""
    words, bounds = word_hashes(_LOWER[data], offsets)
    n = np.diff(bounds)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    start = textkit.ragged_index(bounds[:-1], count)
    hashes = Spans(words, seed=5).hashes(start, np.minimum(start + WORDS, bounds[text + 1]))
    _sort_parts(hashes, np.concatenate([[0], np.cumsum(count)]))
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(n)))])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = _bytes(batch.column("_text"))
        for a, b in textkit.slices(np.diff(offsets).tolist()):
            yield batch, a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1])


def _class_hashes(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(finalise(hashes ^ np.uint64(salt)))])
        out.append(finalise(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0], out[1]


def _parities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each set: whether an odd number of its shingles falls into each of 64 * PARITY_WORDS ranges, as words."""
    n, ranges = len(at) - 1, 64 * PARITY_WORDS
    text = np.repeat(np.arange(n), np.diff(at))
    place = (hashes >> np.uint64(20)).astype(np.int64) % ranges
    odd = (np.bincount(text * ranges + place, minlength=n * ranges) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, PARITY_WORDS)


def _checksum(text: memoryview) -> int:
    """64 bits, as all rows without an id share one key and only this tells them apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _checksums(column: pa.Array) -> list[int]:
    data, offsets = _bytes(column)
    view = memoryview(data)
    return [_checksum(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, a, b, hashes, at in _sets(batches):
        h1, h2 = _class_hashes(hashes, at)
        part = batch.slice(a, b - a)
        words = [pa.array(w, pa.int64()) for w in _parities(hashes, at).T]
        marks = [c for c in _MARKS if c in part.schema.names]
        yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(_checksums(part.column("_text")), pa.int64()), *map(part.column, marks), pa.array(np.diff(at), pa.int64()), _signed(h1), _signed(h2), *words], names=["key", "crc", *marks, "n", "h1", "h2", *_WORDS])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket and task at most."""
    table = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    for _, _, _, hashes, _ in _sets(batches):
        table += np.bincount((hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(table))
    used = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(table[used], pa.int64())], names=["bucket", "n"])


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Two sets above the threshold share one of their first so many shingles."""
    return n - -(-PERCENT * n // 100) + 1


def _entries(counts: np.ndarray):
    """Prefix shingles of each class of a slice: shingle, cls, n, pos (from 0)."""
    # Only the order of the counts matters, and ranks are small whatever the corpus.
    ranks = np.unique(counts, return_inverse=True)[1].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, hashes, at in _sets(batches):
            n = np.diff(at)
            cls, _ = _class_hashes(hashes, at)
            once = np.zeros(len(n), dtype=bool)
            once[np.unique(cls, return_index=True)[1]] = True
            once &= n > 0
            # A set's hashes ascend, so of equally frequent ones the least comes first.
            order = rare_first(ranks[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], at)
            take = np.where(once, prefix_length(n), 0)
            index = textkit.ragged_index(at[:-1], take)
            owner = np.repeat(np.arange(len(n)), take)
            yield pa.RecordBatch.from_arrays([_signed(hashes[order][index]), _signed(cls[owner]), pa.array(n[owner], pa.int32()), pa.array(index - at[owner], pa.int32())], names=["shingle", "cls", "n", "pos"])

    return run


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of a batch that repeat key and text, the first."""
    for batch in batches:
        data, offsets = _bytes(batch.column("_text"))
        view = memoryview(data)
        once = {}
        for key, a, b in zip(batch.column("_key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            once.setdefault((key, _checksum(view[a:b])), (a, b))
        key, crc = zip(*once, strict=True) if once else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(crc, pa.int64()), pa.array([b - a for a, b in once.values()], pa.int64()), pa.array([pa.compress(view[a:b], codec="zstd", asbytes=True) for a, b in once.values()], pa.binary())], names=["key", "crc", "size", "blob"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * i >= PERCENT * (|a| + |b| - i), in whole numbers."""
    return (100 + PERCENT) * len(np.intersect1d(a, b, assume_unique=True)) >= PERCENT * (len(a) + len(b))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: OrderedDict[tuple, np.ndarray] = OrderedDict()
    held = 0

    def of(key: tuple, blob: bytes, size: int) -> np.ndarray:
        nonlocal held
        if key not in sets:
            text = np.frombuffer(_unpacked(blob, size), dtype=np.uint8)
            sets[key], _ = shingle_sets(text, np.array([0, len(text)]))
            held += len(sets[key])
            while held > KEPT_SHINGLES and len(sets) > 1:
                held -= len(sets.popitem(last=False)[1])
        sets.move_to_end(key)
        return sets[key]

    names = [f"{s}_{c}" for s in "ab" for c in ("node", "key", "crc", "size", "blob")]
    for batch in batches:
        hit_a, hit_b = [], []
        for na, ka, ca, sa, ba, nb, kb, cb, sb, bb in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if similar(of((ka, ca), ba, sa), of((kb, cb), bb, sb)):
                hit_a.append(na)
                hit_b.append(nb)
        yield pa.RecordBatch.from_arrays([pa.array(hit_a, pa.int64()), pa.array(hit_b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b: nodes) among pairs (left, right: classes)."""
    side = lambda s, on: texts.select(F.col("cls").alias(on), *(F.col(c).alias(f"{s}_{c}") for c in ("node", "key", "crc", "size", "blob")))
    both = pairs.join(side("a", "left"), "left").join(side("b", "right"), "right")
    return both.drop("left", "right").mapInArrow(_verify, "a long, b long")


def _fits(n_a, pos_a, n_b, pos_b):
    """Length filter, and positional filter: what follows the shared shingle bounds what is shared."""
    need = PERCENT * (n_a + n_b)
    longest = F.least(n_a - pos_a, n_b - pos_b)
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & ((100 + PERCENT) * longest >= need)


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))


def _keyed(rows: DataFrame) -> DataFrame:
    marks = [c for c in _MARKS if c in rows.columns]
    return rows.mapInArrow(_keys, ", ".join(f"{c} long" for c in ("key", "crc", *marks, "n", "h1", "h2", *_WORDS)))


def _classes(keys: DataFrame, node: Column) -> DataFrame:
    """cls, h2, n, node, and key, crc and marks of the class's first row."""
    first = [c for c in ("key", "crc", *_MARKS) if c in keys.columns]
    # Rows of a class have the same set, so any of their parities will do.
    classes = keys.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct(*first)).alias("first"), *(F.max(w).alias(w) for w in _WORDS))
    classes = classes.select(F.col("h1").alias("cls"), "h2", "n", *(F.col(f"first.{c}").alias(c) for c in first), *_WORDS)
    return written(classes.withColumn("node", node), "classes")


def _buckets(rows: DataFrame) -> DataFrame:
    """shingle, cls, n, pos: prefix shingles that several classes hold; of those that exactly the same
    classes hold, the first in order stands for all. rows: _text."""
    # Rare first: counts over all documents, in a table of fixed size.
    counted = rows.mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    table[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    entries = rows.mapInArrow(_entries(table), "shingle long, cls long, n int, pos int")
    shared = written(entries.groupBy("shingle").count().where("count > 1").select("shingle"), "shared")
    entries = written(entries.join(shared, "shingle").distinct(), "entries")
    held = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who"), F.min("pos").alias("pos")).where("size > 1")
    # All classes keep one order, so of buckets with the same classes the first has the least place in each.
    first = held.groupBy("size", "who").agg(F.min(F.struct("pos", "shingle")).alias("first"))
    return written(entries.join(first.select("first.shingle"), "shingle"), "members")


def _texts(rows: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Texts of the classes that meet any other, once: repeated rows of one key would multiply the pairs."""
    involved = members.select("cls").distinct().join(classes, "cls").select("cls", "node", "key", "crc")
    return written(rows.mapInArrow(_blobs, "key long, crc long, size long, blob binary").join(involved, ["key", "crc"]).distinct(), "texts")


def _met(members: DataFrame, classes: DataFrame, apart: Column) -> DataFrame:
    """left, right: classes that meet in a bucket, are `apart` (a condition on part and o_part) and pass
    every filter. A bucket's entry carries the class's buckets just before it: a pair meets where neither
    list has the other's, so surely in its first common bucket, and hardly ever in a second."""
    before = F.collect_list("shingle").over(Window.partitionBy("cls").orderBy("pos").rowsBetween(-BEFORE, -1))
    # Should two sets ever share a class hash, they have no parities and pass the suffix filter.
    parities = classes.groupBy("cls").agg(*(F.when(F.count(F.lit(1)) == 1, F.max(w)).alias(w) for w in _WORDS))
    mine = written(members.withColumn("before", before).join(parities, "cls"), "meeting")
    other = mine.select("shingle", *(F.col(c).alias(f"o_{c}") for c in mine.columns if c != "shingle"))
    both = F.col("n") + F.col("o_n")
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(w).bitwiseXOR(F.col(f"o_{w}"))) for w in _WORDS))
    suffix = F.coalesce((100 + PERCENT) * (both - differ) >= 2 * PERCENT * both, F.lit(True))
    first_met = ~F.arrays_overlap("before", "o_before")
    kept = (F.col("cls") < F.col("o_cls")) & apart & _fits(F.col("n"), F.col("pos"), F.col("o_n"), F.col("o_pos")) & suffix & first_met
    return mine.join(other, "shingle").where(kept).select(F.col("cls").alias("left"), F.col("o_cls").alias("right")).distinct()


def _linked(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """classes with component: the smallest node that links of similarity reach. rows: _key, _text."""
    members = _buckets(rows.select("_text"))
    texts = _texts(rows, members, classes)
    nodes = written(texts.select("cls", "node").distinct(), "nodes")
    placed = written(members.join(nodes, "cls").withColumnRenamed("node", "part"), "placed")

    # Pivot rounds: in every bucket that holds several components, the class in which the bucket stands
    # earliest (it has the fewest rarer shingles, so it is the most like the others) meets all the rest and
    # leaves the bucket. Rounds go on while they still bring components together in numbers.
    links, tried, found = None, None, None
    while True:
        mixed = placed.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min(F.struct("pos", "cls", "n", "part")).alias("pivot")).where("lo < hi")
        mixed = mixed.select("shingle", *(F.col(f"pivot.{c}").alias(f"p_{c}") for c in ("pos", "cls", "n", "part")))
        placed = written(placed.join(mixed, "shingle"), "mixed")
        open_ = placed.agg(F.count(F.lit(1)), F.countDistinct("part")).first()
        if not open_[0] or found is not None and found.count() * FEW < open_[1]:
            break
        near = placed.where((F.col("part") != F.col("p_part")) & _fits(F.col("n"), F.col("pos"), F.col("p_n"), F.col("p_pos")))
        near = near.select(F.least("cls", "p_cls").alias("left"), F.greatest("cls", "p_cls").alias("right")).distinct()
        near = written(near if tried is None else near.join(tried, ["left", "right"], "left_anti"), "near")
        tried = near if tried is None else tried.unionByName(near)
        found = written(_verified(near, texts), "links")
        links = found if links is None else links.unionByName(found)
        part = nodes.join(components(links), "node", "left").select("cls", F.coalesce("component", "node").alias("part"))
        placed = placed.where("cls <> p_cls").select("shingle", "cls", "n", "pos").join(written(part, "part"), "cls")
    if links is None:
        return classes.withColumn("component", F.col("node"))

    # What is still apart in a bucket meets pair by pair.
    rest = _met(placed.select("shingle", "cls", "n", "pos", "part"), classes, F.col("part") != F.col("o_part"))
    links = links.unionByName(written(_verified(rest.join(tried, ["left", "right"], "left_anti"), texts), "links"))
    return classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: every pair of different sets above the threshold (a, b: class numbers, each pair
    once), and doc_id, class for each row (null without words). Copies are one class, so they are not
    expanded; links inside a group of unlike near copies are all listed."""
    id_type = docs.schema[id_col].dataType
    rows = docs.select(_key(id_col).alias("_key"), F.col(text_col).alias("_text"))
    keys = written(_keyed(rows), "keys")
    classes = _classes(keys, F.monotonically_increasing_id())
    members = _buckets(rows.select("_text"))
    pairs = _verified(_met(members, classes, F.lit(True)), _texts(rows, members, classes))
    of_row = keys.join(classes.select(F.col("cls").alias("h1"), "h2", "n", "node"), ["h1", "h2", "n"], "left")
    return written(pairs, "pairs"), of_row.select(F.when(F.col("key") != _LEAST, F.col("key")).cast(id_type).alias("doc_id"), F.col("node").alias("class"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row: doc_id, n_shingles, component_id (the smallest id that links of similarity reach).

    Words are what stands between blanks after A-Z are lowered. Fewer than five words are one shingle;
    texts that are null or without words have no shingle, link with nothing and are components of their
    own. A null id counts as smaller than all others and shows as null. Rows that share an id are one
    node: repeated rows get equal results, and each row keeps its own n_shingles. Other columns are
    ignored; an empty table gives an empty one; texts are read whole."""
    id_type = docs.schema[id_col].dataType
    rows = docs.select(_key(id_col).alias("_key"), F.col(text_col).alias("_text"))
    keys = written(_keyed(rows), "keys")
    of_class = _linked(rows, _classes(keys, F.col("key"))).select(F.col("cls").alias("h1"), "h2", "n", "component")
    of_class = written(of_class, "component")
    out = keys.drop(*_WORDS).join(of_class, ["h1", "h2", "n"], "left")
    shown = lambda c: F.when(c != _LEAST, c).cast(id_type)
    return out.select(shown(F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(F.coalesce("component", "key")).alias("component_id"))


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, less those that a row which stays stands for.

    Here each class of equal sets is a node, whatever the ids of its rows, so rows go only if their texts
    are linked: of the rows of a component one stays, the one with the smallest id (null first), of rows
    that share it the one with the smallest checksum. Rows without words link with nothing and all stay. Columns
    may have any name; an empty table gives an empty one."""
    words = F.coalesce(F.col(text_col).rlike(r"[^\t\n\x0B\f\r ]"), F.lit(False))
    # A hash passes over nulls, so each column says whether it is one.
    told = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    named = [_key(id_col).alias("_key"), *(F.xxhash64(F.lit(k), *told).alias(m) for k, m in enumerate(_MARKS))]
    rows = docs.where(words).select(*named, F.col(text_col).alias("_text"))
    # Any number will do for a node that no other class has; it is written with the class.
    linked = _linked(rows.select("_key", "_text"), _classes(_keyed(rows), F.monotonically_increasing_id()))
    stays = linked.groupBy("component").agg(F.min(F.struct("key", "crc", *_MARKS)).alias("first"))
    stays = written(stays.select(F.col("first.key").alias("_key"), *(F.col(f"first.{m}").alias(m) for m in _MARKS)), "stays")
    # Rows that repeat another in every column are made one before they are dealt out by their marks.
    kept = docs.where(words).distinct().select(*named, F.struct(*docs.columns).alias("_row")).join(stays, ["_key", *_MARKS], "left_semi")
    return kept.select("_row.*").unionByName(docs.where(~words))
