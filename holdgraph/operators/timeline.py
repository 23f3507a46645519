"""Change events: classification, transitions, anchored clusters and assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdgraph.functions import codelists as C
from holdgraph.lineage import written


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def tier_of(change: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in C.CHANGE_TYPES.items() for x in (k, v[0])))[change], F.lit(3))


def entity_change(field: Column, kind: Column, old: Column, new: Column) -> Column:
    """Change type of a field of an entity record; null is administrative noise."""
    form = lambda code: F.coalesce(_lookup(C.LEGAL_FORM_CLASSES, F.upper(F.trim(code))), F.lit("UNKNOWN"))
    known = (form(old) != form(new)) & (form(old) != "UNKNOWN") & (form(new) != "UNKNOWN")
    return (
        F.when(kind == "INITIAL", None)
        .when(field == "lei:Entity/lei:LegalName", "LEGAL_NAME_CHANGE")
        .when((field == "lei:Entity/lei:LegalForm/lei:EntityLegalFormCode") & known, "LEGAL_FORM_CHANGE")
        .when(field == "lei:Entity/lei:EntityStatus", "STATUS_CHANGED")
        .when(field == "lei:Entity/lei:LegalJurisdiction", "JURISDICTION_CHANGE")
        .when(field.startswith("lei:Entity/lei:SuccessorEntity"), "SUCCESSION")
        .when((field == "lei:Registration/lei:RegistrationStatus") & F.upper(F.trim(new)).isin(*C.RETIRED_STATUSES), "REGISTRATION_RETIRED")
        .when(field.contains("Address") & ~field.endswith("/lei:Region"), "ADDRESS_CHANGE")
    )


def relationship_change(field: Column, kind: Column, new: Column) -> Column:
    whole = field == "rr:Relationship/rr:RelationshipType"
    ended = (field == "rr:Relationship/rr:RelationshipStatus") & (F.upper(F.trim(new)) == "INACTIVE")
    return F.when(whole & kind.isin("INITIAL", "INSERT"), "OWNER_ADDED").when((whole & (kind == "DELETE")) | ended, "OWNER_REMOVED")


def filing_change(category: Column, code: Column) -> Column:
    """Control filings by code (an unknown code counts as a changed nature), others by category."""
    control = category == "persons-with-significant-control"
    return F.when(control, F.coalesce(_lookup(C.FILING_CODES, F.upper(code)), F.lit("CONTROL_NATURE_CHANGED"))).otherwise(_lookup(C.FILING_CATEGORIES, category))


def transitions(states: DataFrame, key: list[str], value: str, order: list, only_differing: bool) -> DataFrame:
    """Each state with the one before it as old; the first of a key is no change. only_differing drops
    re-registrations of the same value."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = states.where(F.col(value).isNotNull()).withColumn("old", F.lag(value).over(w)).where("old IS NOT NULL")
    return out.where(F.col("old") != F.col(value)) if only_differing else out


def anchored(events: DataFrame, key: list[str], date: str, window_days: int = 400, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, day, anchor and columns to keep: each dated event of a key with the first event of its cluster; an event joins
    the cluster whose first event is within the window, else opens one. Events are sorted within their keys and
    gone through as a stream, so no task holds a key whole."""
    epoch = F.lit("1970-01-01").cast("date")
    rows = events.where(F.col(date).isNotNull()).select(*key, *keep, F.datediff(F.col(date), epoch).alias("day"), F.to_json(F.struct(*key)).alias("_key"))
    schema = T.StructType([*(rows.schema[k] for k in (*key, *keep)), T.StructField("day", T.IntegerType()), T.StructField("anchor", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor = None, 0
        for batch in batches:
            out = []
            for k, day in zip(batch.column("_key").to_pylist(), batch.column("day").to_pylist(), strict=True):
                if k != last or day - anchor > window_days:
                    last, anchor = k, day
                out.append(anchor)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, *keep)), batch.column("day"), pa.array(out, pa.int32())], names=schema.names)

    return rows.repartition(*key).sortWithinPartitions(*key, "day").mapInArrow(run, schema)


def anchored_clusters(events: DataFrame, key: list[str], date: str, window_days: int = 400) -> DataFrame:
    """key, anchor, n: how many events each cluster of `anchored` has."""
    n = anchored(events, key, date, window_days).groupBy(*key, "anchor").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.withColumn("anchor", F.date_add(F.lit("1970-01-01").cast("date"), F.col("anchor")))


def owner_intervals(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """An added and a removed event for each interval; open ends give none."""
    return rows.select(*key, F.expr(f"stack(2, 'OWNER_ADDED', `{start}`, 'OWNER_REMOVED', `{end}`) AS (change_type, event_date)")).where("event_date IS NOT NULL")


def notable(events: DataFrame) -> DataFrame:
    return events.where("tier <= 2 OR boosted")


# Dates that tell when something took effect go before those of records, sure ones before others.
BASES, CONFIDENCES = ("effective", "recorded", "snapshot_window"), ("high", "medium", "low")
#: What an entry takes from the first of its events that has it.
FIRST_OF = ("interest_start", "interest_end", "counterparty")


def entries(events: DataFrame, window_days: int = 400) -> tuple[DataFrame, DataFrame]:
    """Timeline entries of notable events, and which events they are made of.

    events: subject, event_id, change_type, record_type, event_date (null: undated), date_basis, date_confidence,
    source_id, tier, boosted, interest_start, interest_end, counterparty. Dated entity events of one change
    within the window of their first are one entry; undated events and relationship events are entries of
    their own. The primary event has the best basis, then confidence, then the earliest date (undated last),
    then the smallest id; the others corroborate it. Entries: subject, entry_id (the primary's), change_type,
    record_type, event_date, date_basis, date_confidence, tier, boosted (any), sources, n_corroborating, the
    first interest dates and counterparty by that order, and place (by date, undated last, then tier, then id).
    Members: subject, event_id, entry_id. Events without a change type or note are left out."""
    events = notable(events.where("change_type IS NOT NULL"))
    together = (F.col("record_type") == "entity") & F.col("event_date").isNotNull()
    group = ["subject", "change_type", "record_type"]
    rest = [c for c in events.columns if c not in group]
    one = anchored(events.where(together), group, "event_date", window_days, tuple(rest)).withColumn("own", F.lit(None).cast(events.schema["event_id"].dataType)).drop("day")
    alone = events.where(~F.coalesce(together, F.lit(False))).select(*group, *rest, F.lit(None).cast("int").alias("anchor"), F.col("event_id").alias("own"))
    every = written(one.unionByName(alone), "events")
    place = lambda names_, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names_)), F.col(c)), F.lit(0)), F.lit(99))
    order = F.struct(place(BASES, "date_basis"), place(CONFIDENCES, "date_confidence"), F.coalesce(F.col("event_date").cast("string"), F.lit("9999")), F.col("event_id"))
    best = F.min_by(F.struct("event_id", "event_date", "date_basis", "date_confidence", "tier"), order).alias("p")
    first = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", order)).alias(c) for c in FIRST_OF]
    made = every.groupBy(*group, "anchor", "own").agg(best, F.bool_or("boosted").alias("boosted"), F.array_sort(F.collect_set("source_id")).alias("sources"), (F.count(F.lit(1)) - 1).cast("int").alias("n_corroborating"), *first)
    made = written(made, "entries")
    same = [every[c].eqNullSafe(made[c]) for c in (*group, "anchor", "own")]
    members = every.join(made, same[0] & same[1] & same[2] & same[3] & same[4]).select(every["subject"], every["event_id"], F.col("p.event_id").alias("entry_id"))
    flat = made.select("subject", F.col("p.event_id").alias("entry_id"), "change_type", "record_type", *(F.col(f"p.{c}").alias(c) for c in ("event_date", "date_basis", "date_confidence", "tier")), "boosted", "sources", "n_corroborating", *FIRST_OF)
    by_date = Window.partitionBy("subject").orderBy(F.col("event_date").asc_nulls_last(), "tier", "entry_id")
    return flat.withColumn("place", F.row_number().over(by_date)), members
