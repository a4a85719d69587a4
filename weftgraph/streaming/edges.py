"""A stream of edges beside a static graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validate import column_of
from ..graph import PropertyGraph


def enriched(stream: DataFrame, graph: PropertyGraph, *fields: str) -> DataFrame:
    """Each streamed edge (src, dst) with fields of its two nodes, as ``src_f`` and ``dst_f``. Stream-static joins keep no state."""
    out = stream
    for end in ("src", "dst"):
        props = graph.nodes.select(F.col("id").alias(end), *(F.col(column_of(f)).alias(f"{end}_{f}") for f in fields))
        out = out.join(props, end)
    return out


def degrees(stream: DataFrame, ts: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Outgoing edges of each node by window of event time; late ones are counted up to the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), "src").agg(F.count(F.lit(1)).alias("edges")).select("window.start", "src", "edges")
