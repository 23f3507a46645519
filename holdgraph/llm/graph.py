"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from holdgraph import components as stars
from holdgraph.llm.session import written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node, component (the smallest node that links reach) for every node that has
    a link. Links that are null or of a node with itself are left out."""
    return stars.components(links, written)
