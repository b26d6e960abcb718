"""What a scan came across: its candidate sources, what could be read of each, and why some failed.

A source is the smallest thing that is read by itself: a log, or a store. One that cannot be read,
or of which nothing makes sense, is a row of the report and never the end of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.operators import diagnostics, export
from tokentide.schemas import STORES
from tokentide.sources import accounting, cursor, logs, operations, sqlite

VERSIONS = "provider string, path string, session_date date, modified timestamp, length bigint"
#: ``parsed``: the source's rows count. ``lasting``: reading it again is of no use until it changes.
REPORT = "provider string, path string, session_date date, records bigint, malformed bigint, recognized bigint, relevant bigint, normalized bigint, parsed boolean, error string, lasting boolean"
#: How the error of a source begins whose rows count, though some records were lost.
PARTLY = "partially parsed:"
#: Bytes that a reader may skip at the start of a file, for its byte order mark.
_MARK = 3


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _listing(spark: SparkSession, roots: list[str], pattern: str, matching: str, barring: str = "") -> DataFrame:
    files = logs._below_reader(spark, pattern, lenient=True).format("binaryFile").load(roots)
    return logs._matching(files.select(*logs._file_columns()), matching, barring)


def file_versions(spark: SparkSession, provider: str, paths: list[str]) -> DataFrame:
    """VERSIONS of a provider's logs. Contents are not read."""
    roots = logs.existing(spark, paths)
    if not roots:
        return spark.createDataFrame([], VERSIONS)
    pattern, matching, barring, depth = logs.FILES[provider]
    found = _listing(spark, roots, pattern, matching, barring)
    if provider == "deepseek":
        found = found.unionByName(_listing(spark, roots, "session.jsonl.zstd", matching.replace("$", r"\.zstd$")))
    found = logs.within_depth(found, roots, depth)
    if provider == "codex" and len(roots) > 1:
        found = logs.first_of_names(found, roots)
    return found.select(F.lit(provider).alias("provider"), *logs.FILE)


def _of(spark: SparkSession, rows: DataFrame, only: list[str] | None) -> DataFrame:
    return rows if only is None else rows.join(spark.createDataFrame([(p,) for p in only], "path string"), "path", "left_semi")


def file_reads(spark: SparkSession, provider: str, paths: list[str], only: list[str] | None = None) -> DataFrame:
    """(path, read, length): how many bytes of each log its lines hold. Lines are not parsed.

    A log that is whole gives as many as it is long, one more if its last line has no end.
    """
    found = _of(spark, file_versions(spark, provider, paths).filter(~F.col("path").endswith(".zstd")), only)
    roots = logs.existing(spark, paths) if only is None else [logs.readable(p) for p in only if not p.endswith(".zstd")]
    if not roots:
        return spark.createDataFrame([], "path string, read bigint, length bigint")
    lines = logs._below_reader(spark, logs.FILES[provider][0], lenient=True).option("lineSep", "\n").text(roots)
    read = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(F.octet_length("value") + 1).alias("read"))
    return found.join(read, "path", "left").select("path", F.coalesce("read", F.lit(0)).cast("long").alias("read"), "length")


def _judged(counted: DataFrame) -> DataFrame:
    """REPORT of rows with COUNTERS, ``read`` and ``length`` (null where they are not known)."""
    lost = F.col("relevant") - F.col("normalized") + F.col("records") - F.col("recognized")
    broken = F.col("read") + _MARK < F.col("length")
    error = (
        F.when(broken, F.concat(F.lit("read "), F.col("read").cast("string"), F.lit(" of "), F.col("length").cast("string"), F.lit(" bytes")))
        .when((F.col("verdict") == "failed") & (F.col("recognized") == 0), F.concat(F.lit("none of "), F.col("records").cast("string"), F.lit(" records is of a known type")))
        .when(F.col("verdict") == "failed", F.concat(F.lit("none of "), F.col("relevant").cast("string"), F.lit(" relevant records could be read")))
        .when(lost > 0, F.concat(F.lit(f"{PARTLY} skipped "), lost.cast("string"), F.lit(" malformed or unsupported records")))
    )
    given = {"parsed": ~F.coalesce(broken, F.lit(False)) & (F.col("verdict") != "failed"), "error": error, "lasting": ~F.coalesce(broken, F.lit(False))}
    names = [c.split()[0] for c in REPORT.split(", ")]
    return diagnostics.verdict(counted).withColumns(given).select(*names)


def file_report(spark: SparkSession, provider: str, paths: list[str], only: list[str] | None = None) -> DataFrame:
    """REPORT of a provider's logs; a blank log is parsed."""
    tables = operations.provider_tables(spark, provider, paths, only)
    counted = accounting.provider_counters(provider, tables).drop("session_date", "provider")
    versions = _of(spark, file_versions(spark, provider, paths), only).select("provider", "path", "session_date")
    every = versions.join(counted, "path", "left").fillna(0, ["records", "malformed", "recognized", "relevant", "normalized"])
    return _judged(every.join(file_reads(spark, provider, paths, only), "path", "left"))


def stores_of(spark: SparkSession, provider: str, paths: list[str]) -> list[str]:
    """The store files of a provider whose catalog entry is ``paths``."""
    roots = logs.existing(spark, paths)
    return cursor.find_stores(roots) if provider == "cursor" else roots


def store_report(spark: SparkSession, provider: str, stores: list[str], since_ms: int | None = None) -> DataFrame:
    """REPORT of a provider's stores: whether each can be read to the end."""
    every = spark.createDataFrame([(provider, s) for s in stores], "provider string, path string")
    failed = sqlite.store_failures(spark, provider, stores, since_ms).select("path", "error", "lasting") if stores else spark.createDataFrame([], "path string, error string, lasting boolean")
    rows = every.join(F.broadcast(failed), "path", "left") if len(stores) < 10_000 else every.join(failed, "path", "left")
    none = {c: F.lit(None).cast("long").alias(c) for c in ("records", "malformed", "recognized", "relevant", "normalized")}
    return rows.select("provider", "path", F.lit(None).cast("date").alias("session_date"), *none.values(), F.col("error").isNull().alias("parsed"), "error", F.coalesce("lasting", F.lit(True)).alias("lasting"))


def report(spark: SparkSession, roots: dict[str, list[str]], since_ms: int | None = None) -> DataFrame:
    """REPORT of all candidates below ``roots`` (provider -> folders or stores)."""
    parts = []
    for provider, paths in roots.items():
        if provider in STORES:
            parts.append(store_report(spark, provider, stores_of(spark, provider, paths), since_ms))
        elif provider in operations.READERS and logs.existing(spark, paths):
            parts.append(file_report(spark, provider, paths))
    return _union(spark, parts, REPORT)


def failures(reported: DataFrame) -> DataFrame:
    """(provider, path, error) of sources that failed or lost records, in scan order."""
    return export.failures_in_order(reported.filter("error IS NOT NULL").select("provider", "path", "error"))


def summary(reported: DataFrame) -> DataFrame:
    """(provider, candidates, parsed, failures) of each provider and, with a null provider, of all."""
    counted = reported.rollup("provider").agg(F.count("*").alias("candidates"), F.count_if("parsed").alias("parsed"), F.count("error").alias("failures"), F.grouping("provider").alias("all"))
    return counted.orderBy("all", export.scan_rank(F.col("provider"))).select("provider", "candidates", "parsed", "failures")
