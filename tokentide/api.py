"""The two views, from logs to results: what models cost, and what they did to files.

A source that cannot be read does not end a view: it is left out and named by ``failures``. With a
folder ``state`` the usage view runs from a table of sources that is brought up to date first, so
only what is new or has changed is read (see streaming.state).
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.functions import times
from tokentide.operators import analysis as ops
from tokentide.operators import usage as rollup
from tokentide.schemas import NAMES, OPERATIONS, REQUEST_USAGE, SESSIONS
from tokentide.sources import cursor, logs, operations, scans, sqlite, usage_logs
from tokentide.streaming import state as states

Roots = dict[str, list[str]]
_MODELS = "provider string, path string, model string"


def _chosen(roots: Roots, enabled: list[str] | None) -> Roots:
    """The roots of the providers that are enabled, in scan order; roots and stores that are not there are left out by the readers."""
    return {p: roots[p] for p in NAMES if roots.get(p) and (enabled is None or p in enabled)}


def _since(spark: SparkSession, time_range: str, today: datetime.date) -> int | None:
    """First instant of the range in the session's time zone, as stores are asked for it."""
    first = spark.range(1).select(times.local_midnight_ms(times.cutoff(time_range, F.lit(today)))).first()[0]
    return first


def _union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _good_stores(spark: SparkSession, chosen: Roots, since_ms: int | None) -> Roots:
    """The stores of each provider that can be read to their ends, as a task of its own finds for each; they are a list here anyway."""
    good = {}
    for provider in scans.STORES:
        if stores := scans.stores_of(spark, provider, chosen.get(provider, [])):
            bad = {r["path"] for r in sqlite.store_failures(spark, provider, stores, since_ms).select("path").collect()}
            good[provider] = [s for s in stores if s not in bad]
    return good


def requests(spark: SparkSession, roots: Roots, time_range: str = "all", today: datetime.date | None = None, enabled: list[str] | None = None) -> DataFrame:
    """REQUEST_USAGE of all providers in ``roots`` (see sources.catalog) whose date is in the range."""
    today = today or datetime.date.today()
    chosen, since = _chosen(roots, enabled), _since(spark, time_range, today)
    parts = [usage_logs.read_usage(spark, {p: r}) for p, r in chosen.items() if p in usage_logs.READERS]
    stores = _good_stores(spark, chosen, since)
    if stores.get("opencode"):
        parts.append(sqlite.opencode(spark, stores["opencode"], since))
    if stores.get("cursor"):
        parts.append(cursor.read_usage(spark, [], logs.existing(spark, roots.get("cursor_tracking", [])), stores["cursor"]))
    if stores.get("hermes"):
        parts.append(sqlite.hermes(spark, stores["hermes"]))
    return _union(spark, parts, REQUEST_USAGE).filter(times.within(F.col("session_date"), time_range, F.lit(today)))


def _within(rows: DataFrame, time_range: str, today: datetime.date) -> DataFrame:
    """Sources whose date is in the range; stores, which have none, are."""
    return rows.filter(F.col("session_date").isNull() | times.within(F.col("session_date"), time_range, F.lit(today)))


def _scanned(reported: DataFrame) -> dict[str, DataFrame]:
    return {"failures": scans.failures(reported), "scan": scans.summary(reported)}


def usage(
    spark: SparkSession, roots: Roots, prices: DataFrame, time_range: str = "all", today: datetime.date | None = None, enabled: list[str] | None = None, state: str | None = None
) -> dict[str, DataFrame]:
    """'by_provider' (priced rows), 'by_model' (those merged, by cost), 'totals' per provider and over all, and 'days' of activity;
    'failures' (provider, path, error) of sources that failed or lost records, in scan order, and 'scan' with counts of candidates."""
    today = today or datetime.date.today()
    chosen = _chosen(roots, enabled)
    if state:
        tracking = logs.existing(spark, roots.get("cursor_tracking", []))
        stored, reported = states.refresh(spark, chosen, state, tracking)
        rows = stored.filter(F.col("provider").isin(list(chosen))).filter(times.within(F.col("session_date"), time_range, F.lit(today)))
        reported = reported.filter(F.col("provider").isin(list(chosen)))
    else:
        rows = requests(spark, roots, time_range, today, enabled)
        reported = scans.report(spark, chosen, _since(spark, time_range, today))
    priced = rollup.usage(rows, prices)
    views = {"by_provider": priced, "by_model": rollup.summary(rollup.merge_providers(priced)), "totals": rollup.provider_totals(priced), "days": rollup.active_days(rollup.real(rows))}
    return views | _scanned(_within(reported, time_range, today))


def read_analysis(spark: SparkSession, roots: Roots, time_range: str = "all", today: datetime.date | None = None, enabled: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(OPERATIONS, SESSIONS, models) of all providers whose session's date is in the range; models are (provider, path, model)."""
    today = today or datetime.date.today()
    chosen = _chosen(roots, enabled)
    files = {p: r for p, r in chosen.items() if p in operations.READERS}
    found = []
    if files:
        used = usage_logs.read_usage(spark, files).filter("NOT is_advisor AND model IS NOT NULL")
        found.append((*operations.read_operations(spark, files), used.select("provider", "path", "model").distinct()))
    since = _since(spark, time_range, today)
    stores = _good_stores(spark, {p: r for p, r in chosen.items() if p != "hermes"}, since)
    if stores.get("opencode"):
        found.append(operations.opencode(spark, stores["opencode"], since))
    if stores.get("cursor"):
        found.append(operations.cursor(spark, [], logs.existing(spark, roots.get("cursor_tracking", [])), stores["cursor"]))
    ops_rows, sessions, models = (_union(spark, list(part), schema) for part, schema in zip(zip(*found) if found else ((), (), ()), (OPERATIONS, SESSIONS, _MODELS)))
    sessions = sessions.filter(times.within(F.col("session_date"), time_range, F.lit(today)))
    return ops_rows.join(sessions.select("path"), "path", "left_semi"), sessions, models


def analysis(spark: SparkSession, roots: Roots, time_range: str = "all", today: datetime.date | None = None, enabled: list[str] | None = None) -> dict[str, DataFrame]:
    """'by_model' and 'by_provider_model' counters, 'totals' per provider and over all, and 'days' on which a session was; 'failures'
    and 'scan' as in usage(). A source that failed bears no model's rows, and no day."""
    today = today or datetime.date.today()
    chosen = {p: r for p, r in _chosen(roots, enabled).items() if p != "hermes"}
    reported = _within(scans.report(spark, chosen, _since(spark, time_range, today)), time_range, today)
    done, sessions, models = read_analysis(spark, roots, time_range, today, enabled)
    counted = sessions.select("provider", "path").join(ops.session_totals(done, ["path"]), "path", "left").fillna(0)
    fanned = ops.fan_out(counted, models, ["provider", "path"])
    return {
        "by_model": ops.by_model(fanned).orderBy("model"),
        "by_provider_model": ops.by_model(fanned, ["provider", "model"]).orderBy("provider", "model"),
        "totals": ops.by_provider(fanned),
        "days": ops.active_dates(sessions.join(reported.filter("NOT parsed").select("path"), "path", "left_anti")),
    } | _scanned(reported)


def parse_file(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """(provider, REQUEST_USAGE, OPERATIONS, SESSIONS) of one log whose provider its records tell; a zstd one is DeepSeek's.

    Where no record tells a provider, it is Codex. A file that is one JSON document over several lines is read whole.
    """
    packed = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4) == F.lit(b"\x28\xb5\x2f\xfd")).first()[0]
    files = logs.read_zstd_files(spark, [path], "*") if packed else logs.read_files(spark, [path])
    rows, whole = logs.lines(files), logs.documents(files)
    single = not packed and rows.filter("malformed AND line_no = 0").take(1) and whole.filter("NOT malformed").take(1)
    rows = whole if single else rows
    provider = "deepseek" if packed else logs.detect_provider(rows).first()["provider"]
    if provider == "grok":
        folder = path.rsplit("/", 1)[0]
        beside = [n for n in ("summary.json", "updates.jsonl") if logs.existing(spark, [f"{folder}/{n}"])]
        summary = logs.documents(logs.read_files(spark, [f"{folder}/summary.json"] if "summary.json" in beside else []))
        updates = logs.lines(logs.read_files(spark, [f"{folder}/updates.jsonl"] if "updates.jsonl" in beside else []))
        return provider, usage_logs.grok(rows, summary), *operations.grok(rows, summary, updates)
    return provider, usage_logs.READERS[provider](rows), *operations.READERS[provider](rows)
