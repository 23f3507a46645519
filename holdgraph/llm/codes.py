"""Operator 13: vector codes by exact integer k-means over parts, in Hilbert-sorted blocks.

Every vector is cut into parts. The parts of one position are sorted along a Hilbert curve and cut into flat
blocks; a block stores its rows' components, their least and greatest (the box) and their sums. In a round
every block compares its box with the codebook: an entry whose least distance to the box is above another's
greatest can be nearest to none of its rows. What is left is the block's shortlist. If that is one entry,
the block's stored sum counts for it and no row is looked at; else the rows meet the shortlist in integers.

Blocks are written once and read in each round. A round returns one sum per partition, position and entry, so
what goes through the driver is the codebooks (a bounded number of whole numbers) and nothing of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdgraph.llm.session import written
from holdgraph.llm.vectors import labelled_per_id

#: Rows of a block, and the size that components must stay under for distances to fit 64 bits.
BLOCK, LARGEST = 256, 1 << 27
_BLOCK_SCHEMA = "part int, n int, ids binary, rows binary, low array<int>, high array<int>, sums array<long>"


class Codes(NamedTuple):
    """rows: vec_id, label, codes (an index for each part), error. codebooks: part, entry, component."""

    rows: DataFrame
    codebooks: np.ndarray


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points of whole coordinates under 2^bits; bits times their number at
    most 62. Each level of the curve turns the coordinates under it, from the highest bit down, as in
    Skilling's "Programming the Hilbert curve" (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            on = (x[i] >> level) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros(len(points), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> level) & 1
    return place


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries of a codebook can be nearest to a row in each box (one box a row)."""
    least = np.maximum(np.maximum(low[:, None] - book, book - high[:, None]), 0)
    most = np.maximum(np.abs(book - low[:, None]), np.abs(high[:, None] - book))
    least, most = (least**2).sum(axis=2), (most**2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(rows: np.ndarray, book: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of the listed entries to each row, ties to the lowest, and its squared distance."""
    distance = ((rows[:, None] - book[entries]) ** 2).sum(axis=2)
    best = distance.argmin(axis=1)
    return entries[best], distance[np.arange(len(rows)), best]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.int64)


def _part_rows(parts: int, dims: int, least: int, bits: int, shift: int):
    """Cuts vectors into parts with their place on the curve; `shift` makes coordinates fit `bits` bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.pad(_matrix(batch.column("v")), ((0, 0), (0, -dims % parts)))
            width = whole.shape[1] // parts
            for p in range(parts):
                part = whole[:, p * width : (p + 1) * width]
                place = hilbert((part[:, : min(width, 62)] - min(least, 0)) >> shift, bits)
                flat = np.ascontiguousarray(part.astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, dtype=np.int32)), pa.array(place), batch.column("vec_id"), pa.array([r.tobytes() for r in flat], pa.binary())], names=["part", "place", "vec_id", "row"])

    return cut


def _blocks(width: int):
    """Sorted rows to flat blocks; a block has rows of one part."""

    def made(part: int, ids: np.ndarray, rows: np.ndarray) -> list:
        flat = rows.astype(np.int64)
        return [part, len(ids), ids.astype("<i8").tobytes(), rows.tobytes(), flat.min(axis=0).tolist(), flat.max(axis=0).tolist(), flat.sum(axis=0).tolist()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, rows = -1, np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype="<i4")
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["part", "n", "ids", "rows", "low", "high", "sums"]

        def batch_of(blocks: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), types, strict=True)], names=names)

        for batch in batches:
            out = []
            of = batch.column("part").to_numpy()
            new_ids = batch.column("vec_id").to_numpy()
            new_rows = np.frombuffer(b"".join(batch.column("row").to_pylist()), dtype="<i4").reshape(len(of), width)
            for p in np.unique(of):
                if p != part and len(ids):
                    out.append(made(part, ids, rows))
                    ids, rows = ids[:0], rows[:0]
                part = int(p)
                ids, rows = np.concatenate([ids, new_ids[of == p]]), np.concatenate([rows, new_rows[of == p]])
                whole = len(ids) // BLOCK * BLOCK
                out += [made(part, ids[a : a + BLOCK], rows[a : a + BLOCK]) for a in range(0, whole, BLOCK)]
                ids, rows = ids[whole:], rows[whole:]
            if out:
                yield batch_of(out)
        if len(ids):
            yield batch_of([made(part, ids, rows)])

    return cut


def _each_block(batches: Iterator[pa.RecordBatch], books: np.ndarray):
    """(part, block's arrays, its shortlist) of every block."""
    width = books.shape[2]
    for batch in batches:
        if not batch.num_rows:
            continue
        part, low, high, sums = batch.column("part").to_numpy(), *(_matrix(batch.column(c)) for c in ("low", "high", "sums"))
        ids, rows = batch.column("ids"), batch.column("rows")
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            for i, listed in zip(at, shortlists(low[at], high[at], books[p]), strict=True):
                yield p, np.flatnonzero(listed), sums[i], lambda i=i: np.frombuffer(ids[int(i)].as_py(), dtype="<i8"), lambda i=i: np.frombuffer(rows[int(i)].as_py(), dtype="<i4").reshape(-1, width).astype(np.int64), int(batch.column("n")[int(i)].as_py())


def _round(books: np.ndarray):
    """Sums and counts of what is nearest to each entry, one row for a partition, part and entry."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for p, entries, total, _, rows, n in _each_block(batches, books):
            if len(entries) == 1:
                sums[p, entries[0]] += total
                counts[p, entries[0]] += n
            else:
                whole = rows()
                code, _ = nearest(whole, books[p], entries)
                np.add.at(sums[p], code, whole)
                counts[p] += np.bincount(code, minlength=books.shape[1])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return summed


def _assigned(books: np.ndarray):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, entries, _, ids, rows, n in _each_block(batches, books):
            code, distance = nearest(rows(), books[p], entries)
            yield pa.RecordBatch.from_arrays([pa.array(ids(), pa.int64()), pa.array(np.full(n, p, dtype=np.int32)), pa.array(code.astype(np.int32)), pa.array(distance)], names=["vec_id", "part", "code", "distance"])

    return assigned


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes of all vectors and the codebooks they refer to.

    Components are floor(scale * x). Vectors are cut into equal parts; a length that `parts` doesn't divide
    is filled up with zeros. A position's codebook starts as that part of the `entries` smallest ids. In each
    round every part goes to its nearest entry (squared distance, ties to the lower index), then entries become
    the floor of their parts' means; unused ones stay. codes and error are of one more assignment.

    Rows with a null id or a null vector, or one with null or non-finite components, take no part; of rows
    that share an id the smallest vector counts, then the smallest label, null first. The smallest id's vector
    sets the length, vectors of other lengths take no part. Fewer than `entries` rows make smaller codebooks.
    An empty table gives an empty one. Other columns are ignored. Scaled components of 2^27 and more raise a
    ValueError: distances would not fit 64 bits."""
    spark = vectors.sparkSession
    whole = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    tall = F.exists("v", lambda x: F.abs(F.lit(scale) * x.cast("double")) >= LARGEST)
    rows = labelled_per_id(vectors, id_col, vector_col, label_col).select("vec_id", "label", whole.alias("v"), tall.alias("tall"))
    rows = written(rows, "vectors")
    first = rows.orderBy("vec_id").limit(entries).collect()
    dims = len(first[0]["v"]) if first else 0
    if not dims:
        codes = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda _: F.lit(0))
        return Codes(rows.where(F.size("v") == 0).select("vec_id", "label", codes.alias("codes"), F.lit(0).cast("long").alias("error")), np.zeros((parts, len(first), 0), dtype=np.int64))
    rows = rows.where(F.size("v") == dims)
    first = rows.orderBy("vec_id").limit(entries).collect()
    least, most, tall = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.bool_or("tall")).first()
    if tall:
        raise ValueError(f"scaled components must stay under {LARGEST}")
    books = np.pad(np.array([r["v"] for r in first], dtype=np.int64), ((0, 0), (0, -dims % parts)))
    width = books.shape[1] // parts
    books = books.reshape(len(first), parts, width).transpose(1, 0, 2)

    # Padding puts zeros beside the components, so the curve's box holds them too.
    bits = max(1, min(16, 62 // min(width, 62)))
    shift = max(0, int(max(most, 0) - min(least, 0)).bit_length() - bits)
    cut = rows.select("vec_id", "v").mapInArrow(_part_rows(parts, dims, least, bits, shift), "part int, place long, vec_id long, row binary")
    # Equal parts are many where vectors repeat: ids split them.
    order = ["part", "place", "vec_id"]
    blocks = written(cut.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(width), _BLOCK_SCHEMA), "blocks")

    for _ in range(rounds):
        found = blocks.mapInArrow(_round(books), "part int, entry int, n long, sums array<long>")
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()
        books = books.copy()
        for r in total:
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]

    placed = blocks.mapInArrow(_assigned(books), "vec_id long, part int, code int, distance long")
    codes = placed.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("part", "code"))).getField("code").alias("codes"), F.sum("distance").alias("error"))
    return Codes(codes.join(rows.select("vec_id", "label"), "vec_id").select("vec_id", "label", "codes", "error"), books)


def digest_codes(vectors: DataFrame, **how) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error (the errors of all rows of one label,
    null included), codebooks_sha256 (of all entries' components by part, entry and position, with commas)."""
    made = compress(vectors, **how)
    rows = written(made.rows, "codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(map(str, made.codebooks.reshape(-1).tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.join(sums, rows["label"].eqNullSafe(sums["of"])).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds_sql(rounds: int = 6) -> str:
    nearest_sql = """
, near{i} AS (
  SELECT vec_id, part, min_by(entry, (distance, entry)) AS entry, min(distance) AS distance FROM (
    SELECT s.vec_id, s.part, b.entry, CAST(list_sum(list_transform(list_zip(s.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM sub s JOIN book{i} b USING (part)) GROUP BY vec_id, part
)"""
    mean_sql = """
, sum{i} AS (
  SELECT part, entry, list(CAST(floor_ AS BIGINT) ORDER BY place) AS v FROM (
    SELECT part, entry, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_
    FROM (SELECT n.part, n.entry, unnest(s.v) AS x, unnest(range(len(s.v))) AS place FROM near{i} n JOIN sub s USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL
), book{j} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.v, b.v) AS v FROM book{i} b LEFT JOIN sum{i} s USING (part, entry))"""
    return "".join((nearest_sql + mean_sql).format(i=i, j=i + 1) for i in range(rounds)) + nearest_sql.format(i=rounds)


#: The same in SQL, every part against all entries in every round.
CODES_SQL = f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sub AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS v FROM e, (SELECT unnest(range(8)) AS part)
), book0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM sub WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 16)
){_rounds_sql()}
, code AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM near6 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book6) AS codebooks_sha256
FROM code JOIN e USING (vec_id)"""
