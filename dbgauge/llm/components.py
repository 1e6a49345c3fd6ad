"""Connected components of links between 64-bit nodes, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dbgauge.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node: (node, root), root < node.

    ``links`` has the columns a, b (bigint). In each round both ends of a link (a, b), a > b, move to the
    smallest of the lowest neighbour of a, the lowest neighbour of b, and b. A link is replaced by two
    that meet in one node, so no connection is lost, and long chains halve. The rounds end when the links are
    stars. Every table of a round is written, so that a star's hub, which may hold most links, is split by
    the adaptive join. Null ends and loops are ignored; an empty table gives an empty result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    seen = _state(links)
    while True:
        low = materialize(links.groupBy("a").agg(F.min("b").alias("low")), "lowest")
        of_a = low.select(F.col("a"), F.col("low").alias("low_a"))
        of_b = low.select(F.col("a").alias("b"), F.col("low").alias("low_b"))
        meet = F.least("low_a", F.coalesce("low_b", "b"))
        moved = links.join(of_a, "a").join(of_b, "b", "left").select(F.explode(F.array(F.struct("a", meet.alias("b")), F.struct(F.col("b").alias("a"), meet.alias("b")))).alias("link"))
        links = materialize(moved.select("link.a", "link.b").where("a <> b").distinct(), "links")
        now = _state(links)
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _state(links: DataFrame) -> tuple:
    return tuple(links.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
