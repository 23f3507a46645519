"""Streaming queries, drained over the events table."""

from __future__ import annotations

from holdgraph.plans.registry import query
from holdgraph.streaming import changes


@query("SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS n_ceased FROM events GROUP BY event_type")
def stream_event_mix(spark, sf_dir):
    """Running tallies (SM1, SM2)."""
    return changes.drained(changes.mix(changes.event_stream(spark, sf_dir, "events.parquet")), "complete")


@query("SELECT event_id, user_id AS record_id, CASE WHEN value > 90 THEN 'closed' ELSE 'new' END AS status FROM events WHERE event_type <> 'error' AND props IS NOT NULL")
def stream_records(spark, sf_dir):
    """Events as records, ceased ones closed (SM3)."""
    return changes.drained(changes.records(changes.event_stream(spark, sf_dir, "events.parquet")))
