"""Operator 11: a mix of sources to target weights by a low-discrepancy schedule.

Every source's documents stand in shuffled order as one stream of words, which is cut into blocks of
equal length; the blocks are shuffled anew for every epoch. The schedule has 2^m slots. Slot n has the
van der Corput point of n (its m bits in reverse, over 2^m); the point falls into one source's interval of
the cumulative weights. A source's slots are ranked by n, and the slot of rank r reads its r-th block, in
the next epoch once all were read. So every prefix of the mix holds the sources in proportion, and a
source's last block is cut where its target is reached.

Points are made from the intervals: those of one source are consecutive numbers over 2^m, and each gives
its slot by reversing its bits. Ranks and running sums inside a source go through buckets of its
documents, slots or blocks, so a source that holds a third of all rows is no single task's.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdgraph.llm.session import written

#: Words of a block, rows of a source that are ordered in one task, and rows that one row becomes at once.
BLOCK_WORDS, BUCKET, STEP = 2048, 512, 4096
WORD = r"[^\x20\x09-\x0D]+"
_HASH_BITS = 60


class Mix(NamedTuple):
    """documents: a row for each of docs' rows (doc_id, source_no, copy, size). sources: source_no, source,
    source_size, target. spans: what the mix reads, in order of slot, then first_word."""

    documents: DataFrame
    sources: DataFrame
    spans: DataFrame


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of two numbers that aren't negative."""
    return F.call_function("div", a, b)


def _ceil_div(a: Column, b) -> Column:
    return _div(a + b - 1, b if isinstance(b, Column) else F.lit(b))


def _uniform(*parts: str | Column) -> Column:
    """A number of 60 bits that looks random, from the parts' text; null counts as no text."""
    text = F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _numbered(df: DataFrame, n: str, name: str) -> DataFrame:
    """A row for every number from 0 below n. Rows with a large n are dealt out by steps first."""
    few = df.where(F.col(n).between(1, STEP)).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    step = df.where(F.col(n) > STEP).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col(n) - 1, F.lit(STEP)))))
    step = step.repartition(F.xxhash64(*(c for c in df.columns), "_step"))
    last = F.least(F.col(n), (F.col("_step") + 1) * STEP) - 1
    return few.unionByName(step.withColumn(name, F.explode(F.sequence(F.col("_step") * STEP, last))).drop("_step"))


def _running(df: DataFrame, group: list[str], rows: str, share: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of value over the rows before each row of its group, by `order`. share (0 to 1) grows with
    `order`; a group of `rows` rows is dealt by it into buckets of about BUCKET, which are summed apart."""
    buckets = F.greatest(_ceil_div(F.col(rows), BUCKET), F.lit(1))
    dealt = df.withColumn("_bucket", F.least(F.floor(share * buckets), buckets - 1)).withColumn("_value", value)
    sums = dealt.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*group, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*group, "_bucket"])
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_value", "_before", "_inside")


def _in_order(df: DataFrame, value: Column, name: str) -> DataFrame:
    """The running sum before each source in code-point order (null last). Ranges of sources (`part`) were
    written; there are as many as shuffle partitions, so their sums are a bounded table."""
    order = [F.col("source").isNull(), F.col("source")]
    sums = df.groupBy("part").agg(F.sum(value).alias("_sum"), F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("_low"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(F.broadcast(sums.select("part", before.alias("_before"))), "part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def _targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """target of every source: weight * level, at most `most` times its size, the sum share * all sizes. Each
    round takes the sources above their bound out and raises the level of the others, until none is above."""
    size, weight = F.col("source_size"), F.col("weight")
    sizes, weights = sources.agg(F.sum(size), F.sum(weight)).first()
    total, weights = share * (sizes or 0), weights or 0
    bounded, left, count = 0, weights, 0
    while True:
        above = size * most * F.lit(float(left)) <= weight * F.lit(total - bounded)
        found = sources.where(above).agg(F.count("*"), F.sum(size * most), F.sum(weight)).first()
        if found[0] == count:
            break
        count, bounded, left = found[0], found[1], weights - found[2]
    level = weight * F.lit(total - bounded) / F.lit(float(left)) if left else size * most
    return sources.withColumn("target", F.when(above, (size * most).cast("double")).otherwise(level.cast("double")))


def _reversed(n: Column, bits: int) -> Column:
    """The low bits of n in reverse order, by swapping ever larger neighbours."""
    for width, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        n = F.shiftrightunsigned(n, width).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(mask)), width))
    return F.shiftrightunsigned(n, 64 - bits) if bits else F.lit(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """A mix of docs in which source number i (by code point, null last) has weight weights[i % len(weights)].

    A document's size is its number of words (what stands between space and tab to carriage return). The mix
    takes share times all sizes; a source's target is at most `most` times its size, the excess goes to the
    others by weight. spans has slot, source_no, epoch, doc_id, size, copy, first_word (in the document),
    n_words: the words of a source add up to its target, rounded, and no word is read more than `most` times.

    Null and empty texts have size 0 and are never read. Null ids and null sources count as values. Rows
    with the same id, source and size are told apart by `copy`, from 0. Other columns are ignored; an empty
    table gives empty ones. Reruns and other partitionings give the same mix."""
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sizes = written(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")), "sizes")

    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows"))
    sources = written(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "sources")
    sources = _in_order(sources, F.lit(1), "source_no")
    weight = F.get(F.array(*(F.lit(w) for w in weights)), F.pmod(F.col("source_no"), F.lit(len(weights))).cast("int"))
    sources = _targets(written(sources.withColumn("weight", weight.cast("long")), "weights"), share, most)

    # Blocks of an epoch, and slots that the target needs: all but an epoch's last block are whole.
    words, size = F.floor(F.col("target") + 0.5), F.col("source_size")
    sources = sources.withColumn("words", words).withColumn("blocks", _ceil_div(size, block))
    epochs = F.when(size > 0, _div(F.col("words"), size)).otherwise(F.lit(0))
    sources = sources.withColumn("needed", epochs * F.col("blocks") + F.when(size > 0, _ceil_div(F.col("words") - epochs * size, block)).otherwise(F.lit(0)))
    sources = written(_in_order(sources, F.col("needed"), "before"), "targets")
    needed = sources.agg(F.sum("needed")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(needed))) if needed else 0

    # Documents of a source in shuffled order, and the blocks that each reaches into.
    number = sources.select("source", "source_no", "rows")
    units = _numbered(sizes, "copies", "copy").withColumn("u", _uniform("doc_id", "source", "size", "copy"))
    known = units.join(number, units["source"].eqNullSafe(number["source"])).select("doc_id", "source_no", "size", "copy", "u", "rows")
    known = written(known, "units")
    placed = _running(known.where("size > 0"), ["source_no"], "rows", F.col("u") / 2.0**_HASH_BITS, ["u", "doc_id", "size", "copy"], F.col("size"), "start")
    first, last = _div(F.col("start"), F.lit(block)), _div(F.col("start") + F.col("size") - 1, F.lit(block))
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("source_no", "block", "doc_id", "size", "copy", (begin - F.col("block") * block).alias("at"), (begin - F.col("start")).alias("first_word"), (end - begin).alias("length"))

    # Blocks in an order of their own in every epoch, the short one last.
    drawn = _numbered(sources.where("needed > 0").withColumn("epochs", _ceil_div(F.col("needed"), F.col("blocks"))).select("source_no", "source_size", "words", "blocks", "needed", "epochs"), "epochs", "epoch")
    drawn = _numbered(drawn, "blocks", "block")
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    drawn = drawn.withColumn("whole", whole).withColumn("u", F.when(F.col("whole") == block, _uniform("source_no", "block", "epoch")).otherwise(F.lit((1 << _HASH_BITS) - 1)))
    drawn = _running(drawn, ["source_no", "epoch"], "blocks", F.col("u") / 2.0**_HASH_BITS, ["u", F.col("whole") != block, "block"], F.lit(1), "k")
    rank = (F.col("epoch") * F.col("blocks") + F.col("k")).alias("rank")
    left = F.col("words") - F.col("epoch") * F.col("source_size") - F.col("k") * block
    drawn = drawn.where(left > 0).select("source_no", "epoch", "block", rank, F.least(F.col("whole"), left).alias("words"))

    # Points of a source's interval, as whole numbers over 2^bits, and the slots that have them.
    grid = F.lit(2**bits).cast("decimal(19,0)")
    at = lambda c: _ceil_div(c.cast("decimal(19,0)") * grid, F.lit(max(needed, 1)).cast("decimal(19,0)"))
    points = sources.where("needed > 0").select("source_no", "needed", at(F.col("before")).alias("low"), at(F.col("before") + F.col("needed")).alias("high"))
    points = points.withColumn("points", F.col("high") - F.col("low"))
    slots = _numbered(points, "points", "point").withColumn("slot", _reversed(F.col("low") + F.col("point"), bits))
    slots = _running(slots, ["source_no"], "points", F.col("slot") / float(2**bits), ["slot"], F.lit(1), "rank")
    schedule = slots.where("rank < needed").select("source_no", "rank", "slot").join(drawn, ["source_no", "rank"])

    spans = pieces.join(schedule, ["source_no", "block"])
    taken = F.least(F.col("length"), F.col("words") - F.col("at"))
    spans = spans.where(taken > 0).select("slot", "source_no", "epoch", "doc_id", "size", "copy", "first_word", taken.alias("n_words"))
    return Mix(known.select("doc_id", "source_no", "size", "copy"), sources.select("source_no", "source", "source_size", "target"), written(spans, "spans"))


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot: one row for each row of docs, with the words that
    the mix takes from it, repeats counted, and the first slot that reads it (null: none). As `mix` otherwise."""
    made = mix(docs, **how)
    key = ["source_no", "doc_id", "size", "copy"]
    read = made.spans.groupBy(*key).agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = made.documents.select(*key, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    each = rows.unionByName(read).groupBy(*key).agg(F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot"))
    return each.join(made.sources, "source_no").select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The same in SQL: every source's stream, blocks, points and slots by windows.
MIX_SQL = rf"""
WITH RECURSIVE size AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), unit AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM size
), source AS (
  SELECT *, CASE source_no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no FROM size GROUP BY source)
), fill(round, bounded, left_) AS (
  SELECT 0, CAST(0 AS DOUBLE), (SELECT CAST(sum(weight) AS DOUBLE) FROM source)
  UNION
  SELECT round + 1,
    (SELECT coalesce(sum(2.0 * source_size), 0) FROM source WHERE 2 * source_size * left_ <= weight * ((SELECT 1.5 * sum(source_size) FROM source) - bounded)),
    (SELECT CAST(coalesce(sum(weight), 0) AS DOUBLE) FROM source WHERE 2 * source_size * left_ > weight * ((SELECT 1.5 * sum(source_size) FROM source) - bounded))
  FROM fill WHERE round < 200
), level AS (SELECT * FROM fill WHERE round = 200), target AS (
  SELECT s.*, CASE WHEN 2 * source_size * left_ <= weight * (total - bounded) THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * (total - bounded) / left_ AS DOUBLE) END AS target
  FROM source s, level, (SELECT CAST(1.5 * sum(source_size) AS DOUBLE) AS total FROM source)
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size * blocks + (words % source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} ELSE 0 END AS needed
  FROM (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks FROM target)
), whole AS (SELECT CAST(greatest(sum(needed), 1) AS BIGINT) AS needed, CAST(ceil(log2(greatest(sum(needed), 1))) AS INTEGER) AS bits FROM plan), point AS (
  SELECT source_no, CAST(unnest(range((before * grid + n - 1) // n, ((before + needed) * grid + n - 1) // n)) AS BIGINT) AS p, needed, bits
  FROM (SELECT p.source_no, p.needed, w.bits, w.needed AS n, CAST(1 AS BIGINT) << w.bits AS grid, CAST(sum(p.needed) OVER (ORDER BY source_no) AS BIGINT) - p.needed AS before FROM plan p, whole w)
), slot AS (
  SELECT source_no, needed, CAST(list_sum(list_transform(range(bits), lambda i: ((p >> i) & 1) << (bits - 1 - i))) AS BIGINT) AS slot, bits FROM point
), ranked AS (SELECT source_no, coalesce(slot, 0) AS slot, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rank, needed FROM slot), block AS (
  SELECT *, least({BLOCK_WORDS}, source_size - block * {BLOCK_WORDS}) AS full_ FROM (
    SELECT *, unnest(range(blocks)) AS block FROM (SELECT *, unnest(range((needed + blocks - 1) // blocks)) AS epoch FROM plan WHERE needed > 0))
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY source_no, epoch ORDER BY full_ < {BLOCK_WORDS}, substr(md5(concat_ws('|', source_no, block, epoch)), 1, 15), block) - 1 AS k FROM block
), read_ AS (
  SELECT d.source_no, d.block, slot, least(full_, words - epoch * source_size - k * {BLOCK_WORDS}) AS words
  FROM drawn d JOIN ranked r ON r.source_no = d.source_no AND r.rank = epoch * blocks + k AND r.rank < r.needed WHERE words - epoch * source_size - k * {BLOCK_WORDS} > 0
), placed AS (
  SELECT u.*, s.source_no, s.source_size, s.target, CAST(sum(size) OVER (PARTITION BY s.source_no ORDER BY substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(u.source, ''), size, copy)), 1, 15), doc_id, size, copy) AS BIGINT) - size AS start
  FROM unit u JOIN plan s ON s.source IS NOT DISTINCT FROM u.source
), piece AS (
  SELECT source_no, doc_id, size, copy, block, greatest(start, block * {BLOCK_WORDS}) - block * {BLOCK_WORDS} AS off, least(start + size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS}) AS length
  FROM (SELECT *, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM placed WHERE size > 0)
), taken AS (
  SELECT source_no, doc_id, size, copy, sum(least(length, words - off)) AS taken, min(slot) AS first_slot FROM piece JOIN read_ USING (source_no, block) WHERE words > off GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken, CAST(t.first_slot AS BIGINT) AS first_slot
FROM placed p LEFT JOIN taken t ON t.source_no = p.source_no AND t.doc_id IS NOT DISTINCT FROM p.doc_id AND t.size = p.size AND t.copy = p.copy"""
