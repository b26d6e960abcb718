"""Connected components of a link table, by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Both stars keep components
and shrink paths; only distinct links are kept, and each round is a written table. No node's
neighbours are ever gathered in one row: a hub's links are joined with its minimum, a join that
adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.scratch import discard, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Each node's chosen neighbours are linked to its smallest neighbour."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    joined = links.join(least, "a")
    if large:
        pairs = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        pairs = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("p")).select("p.*")
    return pairs.filter("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is its smallest node.

    Cases: loops, repeated links and links with a null end are ignored (a node that has only such
    links is left out). No links give no rows.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    now = written(now, "links")
    state = _state(now)
    while True:
        last, now = now, written(_star(_star(now, large=True), large=False), "links")
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
