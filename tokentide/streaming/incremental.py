"""Incremental usage: a silver table of requests, extended by sources that are new or have changed.

A source's version is its (time of change, length). A refresh reads only the sources whose version
the table lacks and appends their rows under its own number; the list of sources, written with it,
says in which refresh each source's rows are. Nothing that was written is written again. Sources
that are gone leave the list, but only if discovery was complete. Tiers and prices are joined when
the table is queried, so a new price list leaves it valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = ["path", "modified", "length"]


def with_sides(sources: DataFrame, sides: DataFrame) -> DataFrame:
    """``sources`` (source, path, modified, length) whose version takes in the files beside them: ``sides`` (source, modified,
    length) are what else a source's result depends on, such as a store's log or a session's summary."""
    every = sources.select("source", "modified", "length").unionByName(sides.select("source", "modified", "length"))
    whole = every.groupBy("source").agg(F.max("modified").alias("modified"), F.sum("length").alias("length"))
    return sources.drop("modified", "length").join(whole, "source")


def pending(found: DataFrame, known: DataFrame | None) -> DataFrame:
    """Sources (path, modified, length, ...) that are not in ``known`` in the same version."""
    return found if known is None else found.join(known.select(VERSION).distinct(), VERSION, "left_anti")


def listed(found: DataFrame, known: DataFrame | None, number: int, complete: bool) -> DataFrame:
    """The next list of sources (path, modified, length, refresh); sources not found stay if discovery was not ``complete``."""
    fresh = pending(found, known).select(*VERSION, F.lit(number).alias("refresh"))
    if known is None:
        return fresh
    known = known.select(*VERSION, "refresh")
    same = known.join(found.select(VERSION).distinct(), VERSION, "left_semi").unionByName(fresh)
    return same if complete else same.unionByName(known.join(found.select("path").distinct(), "path", "left_anti"))


def latest(spark: SparkSession, state: str) -> tuple[int, DataFrame | None]:
    """(number of refreshes so far, the last list of sources)."""
    try:
        sources = spark.read.parquet(f"{state}/sources")
    except AnalysisException:
        return 0, None
    last = sources.agg(F.max("number")).first()[0]
    return last, sources.filter(F.col("number") == last).drop("number")


def current(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of ``requests`` whose source is listed with the refresh that wrote them."""
    return requests.join(sources.select("path", "refresh"), ["path", "refresh"], "left_semi").drop("refresh")


def refresh(spark: SparkSession, files: DataFrame, reader: Callable[[DataFrame], DataFrame], state: str, complete: bool = True) -> DataFrame:
    """Bring the table in the folder ``state`` up to date with today's ``files``; returns the requests.

    A refresh that fails before its list is written leaves the table as it was.
    """
    last, known = latest(spark, state)
    number = last + 1
    fresh = reader(files.join(pending(files.select(VERSION), known), VERSION, "left_semi"))
    fresh.write.mode("overwrite").parquet(f"{state}/requests/refresh={number}")
    listed(files.select(VERSION), known, number, complete).write.mode("overwrite").parquet(f"{state}/sources/number={number}")
    return current(spark.read.parquet(f"{state}/requests"), latest(spark, state)[1])


def usage_stream(requests: DataFrame, keys: list[str], sums: list[str]):
    """Running sums of a stream of requests, for ``outputMode("complete")`` or ``"update"``."""
    return requests.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
