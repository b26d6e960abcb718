"""SQLite stores as a Spark data source, and the requests of the providers that keep them.

``spark.read.format("sqlite")`` with the options ``paths`` (comma-separated files) and ``query``
reads every file as a partition of its own; the query runs inside the task, so filters and column
lists that it holds are evaluated by the store. The schema is given by the caller.

A store that cannot be read does not end the job of the others: readers of providers leave it out,
and ``store_failures`` runs the same queries to their ends and says what was wrong with which store.
"""

from __future__ import annotations

import json as plain_json
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from contextlib import closing, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tokentide.functions import json, models, times
from tokentide.operators.pairing import residuals
from tokentide.operators.windows import nonempty
from tokentide.sources.usage_logs import _get, _int, _rows

BATCH = 1000
#: How often a store that changes meanwhile is copied anew.
ATTEMPTS = 3
#: What belongs to a store besides its file. Fixed values.
_SIDES = ("", "-wal", "-shm")


def _fingerprint(path: str) -> list[tuple[int, int]]:
    return [(os.stat(path + s).st_mtime_ns, os.stat(path + s).st_size) if os.path.exists(path + s) else (0, 0) for s in _SIDES]


@contextmanager
def opened(path: str, probe: str = "") -> Iterator[sqlite3.Connection]:
    """A read-only connection; where the store cannot be read in place, to a private copy, its log included, that was stable while it was made."""
    try:
        store = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        store.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (probe,)).fetchone()
    except sqlite3.Error:
        with tempfile.TemporaryDirectory(prefix="tokentide-") as folder:
            copy = os.path.join(folder, os.path.basename(path))
            for attempt in range(ATTEMPTS):
                before = _fingerprint(path)
                for side in _SIDES[:2]:
                    if os.path.exists(path + side):
                        shutil.copyfile(path + side, copy + side)
                if _fingerprint(path) == before:
                    break
            else:
                raise OSError(f"{path} changed in each of {attempt + 1} copies") from None
            with closing(sqlite3.connect(copy)) as store:
                yield store
        return
    with closing(store):
        yield store


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _has(store: sqlite3.Connection, table: str) -> bool:
    return bool(store.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone())


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = plain_json.loads(options["stores"])
        self.queries = plain_json.loads(options["queries"])
        self.errors = options.get("errors", "raise")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def _rows(self, path: str) -> Iterator[tuple]:
        fits = False
        with opened(path, self.queries[0]["table"]) as store:
            for q in self.queries:
                if q["table"] and not _has(store, q["table"]) or q["without"] and _has(store, q["without"]):
                    continue
                fits = True
                rows = store.execute(q["query"])
                while some := rows.fetchmany(BATCH):
                    for row in some:
                        yield (path, *row)
        if not fits and self.errors == "report":
            raise sqlite3.OperationalError(f"no such table: {self.queries[0]['table']}")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.errors == "raise":
            yield from self._rows(partition.path)
            return
        try:
            for row in self._rows(partition.path):
                if self.errors == "skip":
                    yield row
        except (sqlite3.Error, OSError) as error:
            if self.errors == "report":
                yield partition.path, f"{error}"


class SqliteSource(DataSource):
    """Options: ``stores`` and ``queries`` as JSON, and ``errors``: 'raise', 'skip' (an unreadable store ends where it fails) or
    'report' (rows are (path, error) of stores that fail). Stores that lack a query's table, or have the one named by its
    ``without``, give no rows of that query."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _query(query: str, table: str = "", without: str = "") -> dict:
    return {"query": query, "table": table, "without": without}


def _load(spark: SparkSession, paths: list[str], queries: list[dict], schema: str, errors: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    options = {"stores": plain_json.dumps(list(paths)), "queries": plain_json.dumps(queries), "errors": errors}
    return spark.read.format("sqlite").schema(f"path string, {schema}").options(**options).load()


def read_sqlite(spark: SparkSession, paths: list[str], query: str, schema: str, table: str = "", without: str = "", errors: str = "raise") -> DataFrame:
    """Rows of ``query`` over every store, with its ``path`` first."""
    return _load(spark, paths, [_query(query, table, without)], schema, errors)


def scan_sqlite(spark: SparkSession, paths: list[str], query: str, schema: str, table: str = "", without: str = "") -> DataFrame:
    """read_sqlite() that leaves out what cannot be read (see store_failures)."""
    return read_sqlite(spark, paths, query, schema, table, without, "skip")


#: What errors say that last as long as the store's bytes. Fixed values.
LASTING = ["no such table", "no such column", "has no column named", "invalid column", "malformed json", "file is not a database", "database disk image is malformed"]


def is_lasting(error: Column) -> Column:
    """Whether a store's failure stays until the store changes; others, of locks or permissions, may pass."""
    return F.exists(F.array(*map(F.lit, LASTING)), lambda x: F.contains(F.lower(error), x))


def store_failures(spark: SparkSession, provider: str, paths: list[str], since_ms: int | None = None) -> DataFrame:
    """(provider, path, error, lasting) of the provider's stores that cannot be read to the end of all its queries."""
    found = _load(spark, paths, PROBES[provider](since_ms), "error string", "report")
    return found.select(F.lit(provider).alias("provider"), "path", "error", is_lasting(F.col("error")).alias("lasting"))


#: Columns of a message: its own times where they are numbers, and its session's.
MESSAGE_TIMES = ", ".join(
    f"CASE WHEN json_valid(m.data) THEN CASE WHEN json_type(m.data, '$.time.{t}') IN ('integer', 'real') THEN cast(json_extract(m.data, '$.time.{t}') AS INTEGER) END END AS {t}" for t in ("completed", "created")
)
#: Messages of assistants, of those that are JSON.
_ASSISTANT = "CASE WHEN json_valid(m.data) THEN json_extract(m.data, '$.role') = 'assistant' ELSE 0 END"


def _messages(columns: str, since_ms: int | None) -> str:
    """Assistant messages with ``columns``; ``ts`` is when a message was completed, else begun, else when its session changed last."""
    inner = f"SELECT m.id, m.session_id, s.directory, m.data, {MESSAGE_TIMES}, s.time_updated FROM message m JOIN session s ON s.id = m.session_id WHERE {_ASSISTANT}"
    timed = f"SELECT *, coalesce(completed, created, time_updated) AS ts FROM ({inner})"
    return f"SELECT {columns} FROM ({timed}) WHERE 1{_since('ts', since_ms)}"


def _since(time: str, since_ms: int | None) -> str:
    return "" if since_ms is None else f" AND {time} >= {int(since_ms)}"


def opencode_messages(spark: SparkSession, paths: list[str], since_ms: int | None = None) -> DataFrame:
    """(path, id, session_id, folder, ts, v, model, session_date) of assistant messages, those from ``since_ms`` on if it is given."""
    rows = scan_sqlite(spark, paths, _messages("id, session_id, directory, data, ts", since_ms), "id string, session_id string, folder string, data string, ts bigint", "message")
    v = F.col("v")
    name = F.coalesce(json.first_string(v, ["modelID", "model_id"]), json.first_string(_get(v, "$.model"), ["modelID", "id"]))
    provider = F.coalesce(json.first_string(v, ["providerID", "provider_id"]), json.first_string(_get(v, "$.model"), ["providerID", "provider_id"]))
    named = models.qualified(F.trim(provider), nonempty(F.trim(name)))
    rows = rows.withColumn("v", F.try_parse_json("data")).withColumns({"model": named, "session_date": times.ms_to_date(F.col("ts"))})
    return rows.filter("model IS NOT NULL AND session_date IS NOT NULL").drop("data")


def opencode(spark: SparkSession, paths: list[str], since_ms: int | None = None) -> DataFrame:
    """Assistant messages with their own cost; the date is the message's. Their buckets are disjoint already."""
    rows = opencode_messages(spark, paths, since_ms).withColumn("t", _get(F.col("v"), "$.tokens"))
    v, t = F.col("v"), F.col("t")
    plain = json.usable_counts(t, ["input", "output", "reasoning"])
    cache = json.usable_counts(_get(t, "$.cache"), ["read", "write"])
    apart = json.usable_counts(t, ["input", "output", "reasoning"]) | ~json.has(t, "$.input") & ~json.has(t, "$.output") & ~json.has(t, "$.reasoning")
    usable = json.is_object(t) & F.when(json.has(t, "$.cache"), cache & apart).otherwise(plain)
    modern = _rows(
        rows.filter(usable), "opencode", session_id=F.col("session_id"), ts_ms=F.col("ts"), model=F.col("model"), input=_int(t, "$.input"), output=_int(t, "$.output"), reasoning=_int(t, "$.reasoning"),
        cache_read=_int(t, "$.cache.read"), cc_5m=_int(t, "$.cache.write"), request_context=_int(t, "$.input") + _int(t, "$.cache.read") + _int(t, "$.cache.write"), stored_cost=F.coalesce(F.try_variant_get(v, "$.cost", "double"), F.lit(0.0)),
    )
    return modern.unionByName(_opencode_legacy(spark, paths, since_ms))


_LEGACY = ["input", "output", "reasoning", "cache_read", "cache_write"]


def _legacy(columns: str, since_ms: int | None) -> str:
    return f"SELECT {columns} FROM session WHERE model IS NOT NULL AND model <> ''{_since('time_updated', since_ms)}"


def opencode_sessions(spark: SparkSession, paths: list[str], since_ms: int | None = None) -> DataFrame:
    """Sessions of stores without a table of messages; their model is a name, or JSON with an id."""
    ddl = ", ".join(f"{c} bigint" for c in _LEGACY)
    rows = scan_sqlite(spark, paths, _legacy(f"id, model, directory, time_updated, {', '.join(f'tokens_{c}' for c in _LEGACY)}, cost", since_ms), f"id string, name string, folder string, ts bigint, {ddl}, cost double", "session", without="message")
    return rows.withColumns({"model": legacy_model(F.col("name")), "session_date": times.ms_to_date(F.col("ts"))}).filter("model IS NOT NULL AND session_date IS NOT NULL")


def legacy_model(name: Column) -> Column:
    """A plain name, a JSON string, or an object's id under its provider; null for other JSON."""
    v = F.try_parse_json(F.trim(name))
    whole = models.qualified(F.trim(json.first_string(v, ["providerID", "provider_id"])), nonempty(F.trim(json.strict_string(v, "$.id"))))
    return F.when(v.isNull(), nonempty(F.trim(name))).when(json.is_object(v), whole).otherwise(nonempty(F.trim(json.strict_string(v, "$"))))


def _opencode_legacy(spark: SparkSession, paths: list[str], since_ms: int | None) -> DataFrame:
    rows = opencode_sessions(spark, paths, since_ms)
    return _rows(
        rows, "opencode", session_id=F.col("id"), ts_ms=F.col("ts"), model=F.col("model"), input=F.col("input"), output=F.col("output"), reasoning=F.col("reasoning"),
        cache_read=F.col("cache_read"), cc_5m=F.col("cache_write"), stored_cost=F.col("cost"),
    )


def opencode_candidates(spark: SparkSession, paths: list[str], since_ms: int | None = None) -> DataFrame:
    """(path, n): how many records an analysis of each store will look at."""
    found = scan_sqlite(spark, paths, _messages("count(*)", since_ms), "n bigint", "message")
    return found.unionByName(scan_sqlite(spark, paths, _legacy("count(*)", since_ms), "n bigint", "session", without="message"))


_HERMES = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens"]


def _hermes_queries(columns: list[str]) -> list[dict]:
    counts = ", ".join(columns)
    cost = "CASE WHEN coalesce(actual_cost_usd, 0) > 0 THEN actual_cost_usd ELSE estimated_cost_usd END"
    return [
        _query(f"SELECT session_id, trim(model), {counts}, {cost}, coalesce(last_seen, first_seen) FROM session_model_usage", "session_model_usage"),
        _query(f"SELECT id, trim(model), {counts}, {cost}, coalesce(ended_at, started_at) FROM sessions", "sessions"),
    ]


def hermes(spark: SparkSession, paths: list[str], columns: list[str] = _HERMES) -> DataFrame:
    """Rows per model, and what each session's own totals hold beyond them.

    Sums for the subtraction take every placeable row; a row with a null count is left to the residual.
    """
    ddl = ", ".join(f"{c} bigint" for c in columns)
    of_models, of_sessions = _hermes_queries(columns)
    parts = scan_sqlite(spark, paths, of_models["query"], f"session_id string, model string, {ddl}, cost double, seen double", of_models["table"])
    parts = parts.dropna(subset=columns).filter("model <> '' AND seen IS NOT NULL")
    whole = scan_sqlite(spark, paths, of_sessions["query"], f"session_id string, model string, {ddl}, cost double, seen double", of_sessions["table"])
    key = [F.to_json(F.array("path", "session_id")).alias("key")]
    sums, noise = [*columns, "cost"], 1e-9
    left = residuals(whole.select(*key, *sums), parts.select(*key, *sums), "key", sums, {"reasoning_tokens": "output_tokens"}, noise)
    rest = whole.select("path", "session_id", "model", "seen", *key).join(left, "key").drop("key").filter(" OR ".join(f"{c} > 0" for c in sums)).filter("model <> '' AND seen IS NOT NULL")
    rows = parts.unionByName(rest.select(parts.columns)).withColumn("ts", (F.col("seen") * 1000).cast("long")).withColumn("session_date", times.ms_to_date(F.col("ts")))
    return _rows(
        rows, "hermes", session_id=F.col("session_id"), ts_ms=F.col("ts"), model=F.col("model"), input=F.col("input_tokens"), output=F.greatest(F.col("output_tokens") - F.col("reasoning_tokens"), F.lit(0)),
        reasoning=F.col("reasoning_tokens"), cache_read=F.col("cache_read_tokens"), cc_5m=F.col("cache_write_tokens"), stored_cost=F.col("cost"),
    )


#: Queries over a node's blobs, a store's own settings and the results of its tools. The first byte tells a blob's kind. Fixed values.
CURSOR_NODES = "SELECT id, data FROM blobs WHERE substr(data, 1, 1) = X'0A'"
CURSOR_META = "SELECT key, value FROM meta WHERE typeof(value) = 'text'"

#: What is asked of each provider's stores.
PROBES = {
    "opencode": lambda since_ms: [_query(_messages("id, data, ts", since_ms), "message"), _query(_legacy("*", since_ms), "session", "message")],
    "cursor": lambda since_ms: [_query(CURSOR_NODES, "blobs"), _query(CURSOR_META, "meta")],
    "hermes": lambda since_ms: _hermes_queries(_HERMES),
}
