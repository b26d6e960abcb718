"""The sources of the usage view as a table that is brought up to date, one version of a source at a time.

A refresh lists the sources with their versions (time of change and length, side files included),
reads those that the table does not have in that version, and writes their requests and their
report under its own number. Last it writes the list that says which refresh holds each source: a
refresh that ends before that leaves the table as it was, and a list is never changed. Failures
that last are kept until the source changes; others are tried again. Sources that are gone leave
the list, those of a provider whose folders are not there as well.

Rows that no list names any more are dead. When the live rows lie in more than MOST_REFRESHES
refreshes they are written anew as one, and refreshes that neither this list nor the one before
names are removed, so readers of the list before can end.

Prices and tiers are joined when the table is queried, so new ones leave it valid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.schemas import REQUEST_USAGE
from tokentide.sources import cursor, logs, scans, sqlite, usage_logs
from tokentide.streaming.incremental import VERSION, with_sides

MOST_REFRESHES = 8
_LIST = "provider string, path string, modified timestamp, length bigint, session_date date, again boolean, refresh int"


def _stamps(spark: SparkSession, paths: list[str]) -> list[tuple]:
    """(path, modified, length) of the files that are there."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for p in paths:
        fs = path(p).getFileSystem(conf)
        if fs.exists(path(p)):
            status = fs.getFileStatus(path(p))
            found.append((p, status.getModificationTime(), status.getLen()))
    return found


def _store_versions(spark: SparkSession, provider: str, paths: list[str], tracking: list[str]) -> DataFrame:
    """Versions of stores, each with its log; Cursor's with the tracking stores too."""
    stores = scans.stores_of(spark, provider, paths)
    shared = [(m, n) for _, m, n in _stamps(spark, [t + s for t in tracking for s in ("", "-wal")])] if provider == "cursor" else []
    stamped = [(s, *_version([*_stamps(spark, [s, f"{s}-wal"])], shared)) for s in stores]
    rows = spark.createDataFrame(stamped, "path string, ms bigint, length bigint")
    return rows.select(F.lit(provider).alias("provider"), "path", F.lit(None).cast("date").alias("session_date"), F.timestamp_millis("ms").alias("modified"), "length")


def _version(own: list[tuple], shared: list[tuple]) -> tuple[int, int]:
    every = [(m, n) for _, m, n in own] + shared
    return max((m for m, _ in every), default=0), sum(n for _, n in every)


def versions(spark: SparkSession, roots: dict[str, list[str]], tracking: list[str]) -> DataFrame:
    """scans.VERSIONS of all sources below ``roots``; a source's version takes in the files beside it."""
    parts = []
    for provider, paths in roots.items():
        if provider in scans.STORES:
            parts.append(_store_versions(spark, provider, paths, tracking))
        elif provider == "grok":
            own = scans.file_versions(spark, provider, paths).withColumn("source", F.regexp_replace("path", r"/[^/]*$", ""))
            kept = logs.existing(spark, paths)
            if kept:
                sides = scans._listing(spark, kept, "summary.json", "").withColumn("source", F.regexp_replace("path", r"/[^/]*$", "")).join(own.select("source"), "source", "left_semi")
                own = with_sides(own, sides)
            parts.append(own.select(*[c.split()[0] for c in scans.VERSIONS.split(", ")]))
        else:
            parts.append(scans.file_versions(spark, provider, paths))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], scans.VERSIONS)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the parts below a folder that were written to their ends."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    found = fs.globStatus(path(f"{folder}/number=*/_SUCCESS")) if fs.exists(path(folder)) else None
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def current(spark: SparkSession, state: str) -> tuple[int, DataFrame]:
    """(number, list) of the last refresh; 0 and an empty list before the first."""
    numbers = _numbers(spark, f"{state}/lists")
    if not numbers:
        return 0, spark.createDataFrame([], _LIST)
    return numbers[-1], spark.read.schema(_LIST).parquet(f"{state}/lists/number={numbers[-1]}")


def _rows(spark: SparkSession, provider: str, paths: list[str], chosen: list[str], tracking: list[str]) -> DataFrame | None:
    """REQUEST_USAGE of the chosen sources of a provider."""
    if provider not in scans.STORES:
        return usage_logs.READERS[provider](*usage_logs.provider_lines(spark, provider, paths, chosen))
    bad = {r["path"] for r in sqlite.store_failures(spark, provider, chosen).select("path").collect()}
    good = [s for s in chosen if s not in bad]
    if not good:
        return None
    if provider == "cursor":
        return cursor.read_usage(spark, [], tracking, good)
    return {"opencode": sqlite.opencode, "hermes": sqlite.hermes}[provider](spark, good)


def _report(spark: SparkSession, provider: str, paths: list[str], chosen: list[str]) -> DataFrame:
    return scans.store_report(spark, provider, chosen) if provider in scans.STORES else scans.file_report(spark, provider, paths, chosen)


def _of(spark: SparkSession, state: str, kind: str, schema: str, listed: DataFrame) -> DataFrame:
    """What the refreshes that ``listed`` names hold of its sources."""
    try:
        rows = spark.read.schema(f"{schema}, refresh int").parquet(f"{state}/{kind}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    source = F.substring_index("path", "#", 1) if kind == "requests" else F.col("path")
    named = listed.select(F.col("path").alias("__path"), F.col("refresh").alias("__refresh"))
    return rows.join(named, (source == F.col("__path")) & (F.col("refresh") == F.col("__refresh")), "left_semi").drop("refresh")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def refresh(spark: SparkSession, roots: dict[str, list[str]], state: str, tracking: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(requests, report) of the sources below ``roots``, read from the table in ``state`` after it was brought up to date.

    Providers that are not in ``roots`` keep what the table has of them.
    """
    last, known = current(spark, state)
    number = last + 1
    found = versions(spark, roots, list(tracking))
    fresh = found.join(known.filter("NOT again").select("provider", *VERSION), ["provider", *VERSION], "left_anti")
    wanted: dict[str, list[str]] = {}
    for r in fresh.select("provider", "path").toLocalIterator():  # the driver lists all files anyway
        wanted.setdefault(r["provider"], []).append(r["path"])
    gone = known.filter(F.col("provider").isin(list(roots))).select("provider", *VERSION).join(found.select("provider", *VERSION), ["provider", *VERSION], "left_anti")
    if not wanted and not gone.take(1):
        return _of(spark, state, "requests", REQUEST_USAGE, known), _of(spark, state, "reports", scans.REPORT, known)

    parts = [rows for p, chosen in wanted.items() if (rows := _rows(spark, p, roots[p], chosen, list(tracking))) is not None]
    _write(scans._union(spark, parts, REQUEST_USAGE), f"{state}/requests/refresh={number}")
    _write(scans._union(spark, [_report(spark, p, roots[p], chosen) for p, chosen in wanted.items()], scans.REPORT), f"{state}/reports/refresh={number}")
    reported = spark.read.schema(scans.REPORT).parquet(f"{state}/reports/refresh={number}")
    new = fresh.join(reported.select("path", (~F.col("lasting")).alias("again")), "path", "left")
    new = new.select("provider", *VERSION, "session_date", F.coalesce("again", F.lit(False)).alias("again"), F.lit(number).alias("refresh"))
    others = known.filter(~F.col("provider").isin(list(roots)))
    same = known.filter("NOT again").join(found.select("provider", *VERSION), ["provider", *VERSION], "left_semi")
    listed = scans._union(spark, [new, others.select(new.columns), same.select(new.columns)], _LIST)
    _write(listed, f"{state}/lists/number={number}")
    if len(_sweep(spark, state)) > MOST_REFRESHES:
        compact(spark, state)
    listed = current(spark, state)[1]
    return _of(spark, state, "requests", REQUEST_USAGE, listed), _of(spark, state, "reports", scans.REPORT, listed)


def compact(spark: SparkSession, state: str) -> None:
    """Write all live rows as one refresh and swap the list."""
    last, listed = current(spark, state)
    number = last + 1
    for kind, schema in (("requests", REQUEST_USAGE), ("reports", scans.REPORT)):
        _write(_of(spark, state, kind, schema, listed), f"{state}/{kind}/refresh={number}")
    _write(listed.withColumn("refresh", F.lit(number)), f"{state}/lists/number={number}")
    _sweep(spark, state)


def _sweep(spark: SparkSession, state: str) -> set[int]:
    """Remove what neither the last list nor the one before names; returns the refreshes that the last names."""
    numbers = _numbers(spark, f"{state}/lists")[-2:]
    live = [{r["refresh"] for r in spark.read.schema(_LIST).parquet(f"{state}/lists/number={n}").select("refresh").distinct().collect()} for n in numbers]
    for kind in ("requests", "reports"):
        _remove(spark, f"{state}/{kind}", "refresh", set().union(*live))
    _remove(spark, f"{state}/lists", "number", set(numbers))
    return live[-1]


def _remove(spark: SparkSession, folder: str, key: str, live: set[int]) -> None:
    """Remove the parts below ``folder`` that are not live."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    for status in fs.listStatus(path(folder)):
        name = status.getPath().getName()
        if name.startswith(f"{key}=") and int(name.split("=")[1]) not in live:
            fs.delete(status.getPath(), True)
