"""Operator 2: substring dedup by seed and extend.

Seeds: of every 16 consecutive word 5-grams the one with the smallest hash is an anchor (the last of
equals), so two equal 20-word windows always hold the same anchor at the same place. The windows that
one anchor governs are a block: its words reach as far to both sides of the anchor as any window that
rests on it. Documents are joined on anchors. Extend: blocks with the same anchor and the same words
all the way to both ends repeat whole, and neighbouring blocks chain into maximal repeats. Where
blocks share an anchor but part ways before their ends, their windows are compared one by one. What
is left are exactly the windows that also start earlier, and so the maximal repeats of at least 20
words; every word under one of them goes.

Hashes of words and windows are made in numpy over Arrow batches; a batch sends each of its distinct
blocks once, so a passage that a third of all rows hold costs one row for each batch in the join.
A text is known by its id and 64 bits of its content: rows that have both are the same text, whose blocks
and windows a task sends once, however often the row is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdgraph.llm import textkit
from holdgraph.llm.session import written
from holdgraph.llm.textkit import Spans, finalise, span_hashes

#: Words of a window, of an anchor, and how many anchors' places a window has.
LENGTH, GRAM = 20, 5
PLACES = LENGTH - GRAM + 1
#: Blocks (or windows) among which a task finds repeats by itself before it sends them on.
HELD = 200_000
#: A block is packed as start | windows. A task remembers so many texts to skip their copies.
COUNT_BITS, REMEMBERED = 5, 100_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LEAST = -(1 << 63)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 end to end, and their borders; null is empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def _marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits of each text's content: with the id they say which rows are the same text."""
    view = memoryview(data)
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.uint64).view(np.int64)


class _Copies:
    """Whether a text was met before. What is forgotten only costs repeated work."""

    def __init__(self) -> None:
        self.met: set[tuple[int, int]] = set()

    def new(self, key: int, mark: int) -> bool:
        if (key, mark) in self.met:
            return False
        if len(self.met) >= REMEMBERED:
            self.met.clear()
        self.met.add((key, mark))
        return True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts end to end, and the borders of each text's words."""
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets - offsets[0]] = True
    start = ~blank
    start[1:] &= blank[:-1] | edge[1:-1]
    end = ~blank
    end[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets - offsets[0])


def blocks(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every block: its text, its first window's start there, how many windows, the anchor's hash and
    the hash of all its words."""
    windows = len(words) - LENGTH + 1
    if windows <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    spans = Spans(words, seed=1)
    at = np.arange(len(words) - GRAM + 1)
    grams = spans.hashes(at, at + GRAM)
    least = grams[PLACES - 1 :].copy()
    place = np.full(windows, PLACES - 1, dtype=np.int64)
    for j in range(PLACES - 2, -1, -1):
        other = grams[j : j + windows]
        less = other < least
        least[less] = other[less]
        place[less] = j
    text = np.searchsorted(bounds, np.arange(windows), side="right") - 1
    start = np.flatnonzero(np.arange(windows) + LENGTH <= bounds[text + 1])
    text = text[start]
    anchor = start + place[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, text = start[first], start[last], text[first]
    return text, lo - bounds[text], hi - lo + 1, grams[anchor[first]], spans.hashes(lo, hi + LENGTH)


def _block_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Arrays of doc, packed place, anchor, words, content; as many as HELD at once, or one slice's."""
    held, count, copies = [], 0, _Copies()
    for batch in batches:
        texts, ids = batch.column("_text"), batch.column("_key").to_numpy(zero_copy_only=False)
        data, offsets = _bytes(texts)
        marks = _marks(data, offsets)
        first = [i for i, (k, m) in enumerate(zip(ids.tolist(), marks.tolist(), strict=True)) if copies.new(k, m)]
        if len(first) < len(ids):
            data, offsets = _bytes(texts.take(pa.array(first, pa.int64())))
            ids, marks = ids[first], marks[first]
        for a, b in textkit.slices(np.diff(offsets).tolist()):
            words, bounds = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1])
            text, start, n, anchor, whole = blocks(words, bounds)
            held.append([ids[a + text], start << COUNT_BITS | n, anchor, whole, marks[a + text]])
            count += len(text)
            if count >= HELD:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, count = [], 0
    if count:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _first_of_equals(keys: list[np.ndarray], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each row is the first of those with its keys. Equals at one place are all first."""
    order = np.lexsort((place, doc, *keys))
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first = np.empty(len(order), dtype=bool)
    first[order] = (doc[order] == doc[order][head]) & (place[order] == place[order][head])
    return first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every anchor of a batch once: how often, and the least and greatest hash of its blocks' words."""
    for _, _, anchor, whole, _ in _block_arrays(batches):
        order = np.lexsort((whole, anchor))
        anchor, whole = anchor[order], whole[order].view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        yield pa.RecordBatch.from_arrays([_signed(anchor[first]), pa.array(np.diff(np.append(first, len(anchor))), pa.int64()), pa.array(np.minimum.reduceat(whole, first), pa.int64()), pa.array(np.maximum.reduceat(whole, first), pa.int64())], names=["anchor", "n", "lo", "hi"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc, packed, anchor, whole, mark in _block_arrays(batches):
        again = ~_first_of_equals([whole, anchor], doc, packed >> COUNT_BITS)
        # Known repeats need no partner any more: they travel with the others under keys of their own.
        anchor = np.where(again, finalise(anchor + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + packed.astype(np.uint64)), anchor)
        yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(whole), *(pa.array(x, pa.int64()) for x in (doc, mark, packed)), pa.array(again, pa.bool_())], names=["anchor", "whole", "doc", "mark", "packed", "again"])


def _packed_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts go through exchanges compressed."""
    for batch in batches:
        data, offsets = _bytes(batch.column("_text"))
        view = memoryview(data)
        size = np.diff(offsets)
        texts = [pa.compress(view[a:b], codec="zstd", asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_key"), pa.array(_marks(data, offsets), pa.int64()), pa.array(size, pa.int64()), pa.array(texts, pa.binary())], names=["_row", "_key", "_mark", "_size", "_blob"])


def _unpacked(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the blocks that still have to be compared window by window."""
    held, count, copies = [], 0, _Copies()

    def flush() -> pa.RecordBatch:
        doc, mark, start, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        again = ~_first_of_equals([a, b], doc, start)
        a = np.where(again, finalise(a + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)), a)
        return pa.RecordBatch.from_arrays([_signed(a), _signed(b), *(pa.array(x, pa.int64()) for x in (doc, mark, start)), pa.array(again, pa.bool_())], names=["a", "b", "doc", "mark", "start", "again"])

    for batch in batches:
        for key, mark, size, blob, open_ in zip(*(batch.column(c).to_pylist() for c in ("_key", "_mark", "_size", "_blob", "_open")), strict=True):
            if not open_ or not copies.new(key, mark):
                continue
            text = np.frombuffer(_unpacked(blob, size), dtype=np.uint8)
            words, _ = word_hashes(text, np.array([0, len(text)]))
            block = np.array(open_, dtype=np.int64)
            n = block & ((1 << COUNT_BITS) - 1)
            start = np.unique(textkit.ragged_index(block >> COUNT_BITS, n))
            hashes = [Spans(words, seed).hashes(start, start + LENGTH) for seed in (1, 2)]
            held.append([np.full(len(start), key, dtype=np.int64), np.full(len(start), mark, dtype=np.int64), start, *hashes])
            count += len(start)
            if count >= HELD:
                yield flush()
                held, count = [], 0
    if count:
        yield flush()


def _kept(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return list(compress(words, np.cumsum(change)[:-1] == 0)) if len(starts) else words


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row (the row's other columns as a struct), doc_id, n_words, n_removed, kept_text: one row for
    each row of docs.

    Words are what stands between blanks (space, tab to carriage return), unchanged. A word goes if it
    lies in a window of 20 words of its document that also starts earlier: in a document with a smaller
    id, or before in the same one. Windows are judged on the input. Fewer than 20 words, empty and null
    texts lose nothing. Null ids count as one id, smaller than all others. Rows that share an id count
    as one document for 'earlier', and each keeps a row: repeated rows get equal results. Other columns
    ride along in _row, whatever their names; an empty table gives an empty one."""
    out = _removed(docs, id_col, text_col, texts=True)
    return out.select("_row", "doc_id", "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_text"))


def digest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As remove_repeats, with the SHA-256 of the kept text in its place: doc_id, n_words, n_removed,
    kept_sha256."""
    return _removed(docs, id_col, text_col, texts=False).select("doc_id", "n_words", "n_removed", F.decode("kept", "UTF-8").alias("kept_sha256"))


def _removed(docs: DataFrame, id_col: str, text_col: str, texts: bool) -> DataFrame:
    rows = docs.select(F.struct(*(c for c in docs.columns if c != text_col)).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("_key"), F.col(text_col).alias("_text"))
    keyed = rows.select("_key", "_text")

    # Seeds: anchors that occur more than once, and whether all their blocks are the same.
    seeds = keyed.mapInArrow(_seeds, "anchor long, n long, lo long, hi long").groupBy("anchor").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    seeds = written(seeds.where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("parts")), "seeds")
    found = keyed.mapInArrow(_blocks, "anchor long, whole long, doc long, mark long, packed long, again boolean").join(seeds, "anchor", "left").where("again OR parts IS NOT NULL")

    # Extend: blocks that are the same to both ends; all but the first of them repeat whole. Dealt by
    # both hashes, so that a common line in many surroundings is not one task's.
    place = F.shiftright("packed", COUNT_BITS)
    rank = F.rank().over(Window.partitionBy("anchor", "whole").orderBy("doc", place))
    judged = found.repartition("anchor", "whole").withColumn("repeat", F.col("again") | (rank > 1)).where("repeat OR parts")
    text = [F.col("doc").alias("_key"), F.col("mark").alias("_mark")]
    spans = judged.groupBy(*text).agg(F.collect_set(F.when(F.col("repeat"), F.col("packed"))).alias("_spans"), F.collect_set(F.when(~F.col("repeat"), F.col("packed"))).alias("_open"))

    # Each text meets its blocks.
    row_type = rows.schema["_row"]
    packed_schema = T.StructType([row_type, *(T.StructField(n, t) for n, t in (("_key", T.LongType()), ("_mark", T.LongType()), ("_size", T.LongType()), ("_blob", T.BinaryType())))])
    met = rows.mapInArrow(_packed_text, packed_schema).join(spans, ["_key", "_mark"], "left")

    # Windows one by one, where blocks share an anchor and part ways. Both uses of `met` take all its
    # columns and rows, so they read the same exchanges; the join below keeps its partitioning: no text
    # moves a second time.
    singles = met.mapInArrow(_windows, "a long, b long, doc long, mark long, start long, again boolean")
    rank = F.rank().over(Window.partitionBy("a", "b").orderBy("doc", "start"))
    again = singles.withColumn("repeat", F.col("again") | (rank > 1)).where("repeat")
    more = again.groupBy(*text).agg(F.collect_set("start").alias("_windows"))
    end_schema = T.StructType([row_type, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for size, blob, spans_, windows in zip(*(batch.column(c).to_pylist() for c in ("_size", "_blob", "_spans", "_windows")), strict=True):
                words = _unpacked(blob, size).split()
                block, single = np.array(spans_ or [], dtype=np.int64), np.array(windows or [], dtype=np.int64)
                start = block >> COUNT_BITS
                end = start + (block & ((1 << COUNT_BITS) - 1)) + LENGTH - 1
                left = _kept(words, np.concatenate([start, single]), np.concatenate([end, single + LENGTH]))
                whole = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(whole if texts else hashlib.sha256(whole).hexdigest().encode())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=end_schema.names)

    finished = met.join(more, ["_key", "_mark"], "left").mapInArrow(last, end_schema)
    return finished.select("_row", F.col("_row").getField(id_col).alias("doc_id"), "n_words", "n_removed", "kept")
