"""Operator 3: best-fit packing of whole documents into sequences of bounded length.

The packing is solved on the histogram of piece lengths, which has at most ``capacity`` entries
whatever the corpus: patterns of few lengths that fill a sequence are enumerated, repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and what is left is packed
pattern by pattern, largest length first with the best fit for each gap. The plan is a bounded list
of runs "the documents of length L with ranks from a to b go to sequences from s on, at offset o";
Spark ranks the pieces within their lengths (each length dealt over many keys) and joins the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdgraph.llm.bpe import coder
from holdgraph.llm.session import id_and_text, written

#: Keys over which the pieces of one length are dealt for ranking.
SALTS = 64
#: Partners tried for each length, the most documents in a fitted pattern, and its most unused tokens.
PARTNERS, MOST_IN_PATTERN, WASTE = 6, 4, 2
ROUNDS = 300
_RANK_BITS = 48


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Row for row of token pieces: doc_id, piece, start, length, ids_crc32 (and ids if asked for).

    A document is its ids, then end_id; a null text counts as empty, so it is end_id alone. Only
    documents over capacity are cut, into full pieces and a rest."""
    docs = id_and_text(docs, id_col, text_col)
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(tokenizer_json)
        for batch in batches:
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for k, ids in enumerate(words.encode_column(batch.column("text"))):
                whole = np.append(ids, end_id).astype("<u4")
                for p, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    owner.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType(fields))


def enumerate_patterns(lengths: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns of at most MOST_IN_PATTERN lengths (ascending input) that fill a sequence but for WASTE:
    for every length as the largest, several second lengths from the largest that fits downwards,
    each completed by the best fit for what is left."""
    found = set()
    for a in lengths:
        top = bisect_right(lengths, min(a, capacity - a))
        if not top:
            if capacity - a <= WASTE:
                found.add((a,))
            continue
        seconds = {*range(max(0, top - PARTNERS // 2), top), *np.linspace(0, top - 1, PARTNERS - PARTNERS // 2).astype(int).tolist()}
        for j in seconds:
            pattern = [a, lengths[j]]
            gap = capacity - sum(pattern)
            while len(pattern) < MOST_IN_PATTERN and (k := bisect_right(lengths, min(gap, pattern[-1]))):
                pattern.append(lengths[k - 1])
                gap -= lengths[k - 1]
            if gap <= WASTE:
                found.add(tuple(pattern))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """How often to use each pattern: minimises the squared misfit to the histogram over x >= 0, by
    multiplicative updates, which keep every count non-negative."""
    rows = np.array([i for p in patterns for i in p])
    columns = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    target = histogram.astype(np.float64)
    wanted = np.bincount(columns, weights=target[rows], minlength=len(patterns))
    x = wanted / np.maximum(1, np.bincount(rows, minlength=len(target))[rows].max() if len(rows) else 1)
    for _ in range(ROUNDS):
        got = np.bincount(rows, weights=x[columns], minlength=len(target))
        x *= wanted / np.maximum(1e-12, np.bincount(columns, weights=got[rows], minlength=len(patterns)))
    return x


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly; pure arithmetic over at most
    ``capacity`` lengths, so its cost doesn't grow with the corpus."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = []

    def use(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan.append((pattern, int(times)))
            for length in pattern:
                left[length] -= times

    def room(pattern: tuple[int, ...]) -> int:
        return min(int(left[length]) // pattern.count(length) for length in pattern)

    patterns = enumerate_patterns(np.flatnonzero(left).tolist(), capacity)
    if patterns:
        x = fit_counts(patterns, left)
        waste = np.array([capacity - sum(p) for p in patterns])
        for k in np.lexsort((-x, waste)).tolist():
            use(patterns[k], min(int(x[k]), room(patterns[k])))
    present = np.flatnonzero(left).tolist()
    while present:
        pattern, gap = [], capacity
        while gap and (k := bisect_right(present, gap)):
            length = present[k - 1]
            fits = min(gap // length, int(left[length]) - pattern.count(length))
            while not fits and k > 1:  # used up within this pattern: the next smaller one
                k -= 1
                length = present[k - 1]
                fits = min(gap // length, int(left[length]) - pattern.count(length))
            if not fits:
                break
            pattern += [length] * fits
            gap -= fits * length
        use(tuple(pattern), room(tuple(pattern)))
        present = [n for n in present if left[n]]
    return plan


def plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of every slot of the plan."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            out.append((length, first, first + times, sequence, offset))
            used[length] = first + times
            offset += length
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """parts (doc_id, piece, length, ids_crc32 and any others) with sequence_id and offset."""
    spark = parts.sparkSession
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    counts = salted.groupBy("length", "_salt").count()
    before = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    # The plan has a bounded number of rows (it depends on capacity, not on the corpus), so it is broadcast:
    # slots by length and first rank, in which a piece finds its own by bisection.
    slots = np.array(sorted(plan_rows(solve(histogram, capacity))), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(slots)
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(before, ["length", "_salt"]).select(*parts.columns, (F.col("_rank") + F.col("_before") - 1).alias("_rank"))
    given = parts.columns
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        keys = slots[:, 0] << _RANK_BITS | slots[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            slot = slots[np.searchsorted(keys, batch.column("length").to_numpy() << _RANK_BITS | rank, side="right") - 1] if len(slots) else slots
            columns = [batch.column(c) for c in given]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slot[:, 3] + rank - slot[:, 1], pa.int64()), pa.array(slot[:, 4], pa.int64())], names=schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document in as few sequences as the fit finds, none over capacity: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset (and ids if asked for, to write the sequences).

    Null or empty texts are a piece of length 1. Rows with a null or repeated id are packed like any
    others, each by itself. Other columns are ignored. An empty table gives an empty one."""
    parts = written(pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    return pack(parts, capacity)
