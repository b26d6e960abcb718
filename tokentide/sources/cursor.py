"""Cursor's chat stores: SQLite files of content-addressed blobs.

A blob is JSON, or a node of protocol buffer fields, of which four are read: a message (JSON), a
context gauge inside a message of its own, and a time. Nodes are decoded in Arrow batches; all
else is columns.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.functions import json, times
from tokentide.operators.windows import nonempty
from tokentide.sources.sqlite import CURSOR_META, CURSOR_NODES, scan_sqlite
from tokentide.sources.usage_logs import _rows

#: Field numbers of a node: message, gauge, time; and of the gauge's count. Fixed values.
MESSAGE, GAUGE, TIME, COUNT = 4, 5, 26, 1


def find_stores(roots: list[str]) -> list[str]:
    """chats/<project>/<conversation>/store.db below each root of chats."""
    return [s for root in roots for s in sorted(glob.glob(f"{root.rstrip('/')}/*/*/store.db"))]


def _varint(data: bytes, at: int) -> tuple[int, int] | None:
    """(value, next place), or None where the bytes end."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            return None
        value |= (data[at + k] & 0x7F) << (7 * k)
        if data[at + k] < 0x80:
            return value & (1 << 64) - 1, at + k + 1
    return None


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields, as far as they can be read."""
    at = 0
    while at < len(data):
        if not (tag := _varint(data, at)):
            return
        (number, wire), at = divmod(tag[0], 8), tag[1]
        if wire in (0, 2):
            if not (read := _varint(data, at)):
                return
            value, at = read
            if wire == 2:
                if at + value > len(data):
                    return
                value, at = data[at : at + value], at + value
            yield number, value
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
        else:
            return


def decode_node(data: bytes) -> tuple[bytes | None, bytes | None, int | None]:
    """(message, gauge, time): the last of each."""
    last = dict(fields(data))
    message, gauge, time = (last.get(k) for k in (MESSAGE, GAUGE, TIME))
    return message if isinstance(message, bytes) else None, gauge if isinstance(gauge, bytes) else None, _signed(time) if isinstance(time, int) else None


def gauge_count(gauge: bytes | None) -> int | None:
    found = next((v for k, v in fields(gauge or b"") if k == COUNT and isinstance(v, int)), None)
    return None if found is None else _signed(found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def nodes(spark: SparkSession, stores: list[str]) -> DataFrame:
    """(path, id, v, has_gauge, context, ts) of nodes with a message; the store itself leaves other blobs out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = [decode_node(x or b"") for x in batch.column("data").to_pylist()]
            columns = [pa.array([None if m is None else m.decode("utf-8", "replace") for m, _, _ in decoded], pa.string())]
            columns += [pa.array([g for _, g, _ in decoded], pa.binary()), pa.array([gauge_count(g) for _, g, _ in decoded], pa.int64()), pa.array([t for _, _, t in decoded], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("id"), *columns], names=["path", "id", "message", "gauge", "context", "ts"])

    blobs = scan_sqlite(spark, stores, CURSOR_NODES, "id string, data binary", "blobs")
    rows = blobs.mapInArrow(run, "path string, id string, message string, gauge binary, context bigint, ts bigint")
    shown = F.coalesce(F.octet_length("gauge") > 0, F.lit(False)).alias("has_gauge")
    return rows.filter("message IS NOT NULL").select("path", "id", F.try_parse_json("message").alias("v"), shown, "context", "ts")


def conversation(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def conversation_models(spark: SparkSession, tracking: list[str]) -> DataFrame:
    """(conversation, model): the most frequent model of each conversation in the tracking stores; of equals the first by name."""
    query = "SELECT conversationId, model, count(*) FROM ai_code_hashes WHERE conversationId <> '' AND model <> '' GROUP BY conversationId, model"
    rows = scan_sqlite(spark, tracking, query, "conversation string, model string, n bigint", "ai_code_hashes")
    summed = rows.groupBy("conversation", "model").agg(F.sum("n").alias("n"))
    return summed.groupBy("conversation").agg(F.min_by("model", F.struct((-F.col("n")).alias("n"), "model")).alias("model"))


def store_models(spark: SparkSession, stores: list[str], tracking: list[str]) -> DataFrame:
    """(path, model) of every store: what tracking knows, else the store's own last model, else 'unknown'."""
    meta = scan_sqlite(spark, stores, CURSOR_META, "key string, value string", "meta")
    hex_value = F.when(F.trim("value").rlike(r"^([0-9a-fA-F]{2})+$"), F.try_validate_utf8(F.unhex(F.trim("value")).cast("string")))
    named = nonempty(json.strict_string(F.try_parse_json(F.coalesce(hex_value, F.col("value"))), "$.lastUsedModel"))
    own = meta.withColumn("named", named).filter("named IS NOT NULL").groupBy("path").agg(F.min_by("named", "key").alias("own"))
    every = spark.createDataFrame([(s,) for s in stores], "path string").withColumn("conversation", conversation(F.col("path")))
    known = every.join(conversation_models(spark, tracking), "conversation", "left") if tracking else every.withColumn("model", F.lit(None).cast("string"))
    return known.join(own, "path", "left").select("path", F.coalesce("model", "own", F.lit("unknown")).alias("model"))


def read_usage(spark: SparkSession, roots: list[str], tracking: list[str] = (), stores: list[str] | None = None) -> DataFrame:
    """REQUEST_USAGE: an estimate. Each assistant turn's gauge of its context counts as cache reads; turns without one are left out."""
    stores = find_stores(roots) if stores is None else stores
    v = F.col("v")
    turns = nodes(spark, stores).filter((json.strict_string(v, "$.role") == "assistant") & F.col("has_gauge")).filter("ts IS NOT NULL AND context IS NOT NULL")
    dated = turns.join(store_models(spark, stores, list(tracking)), "path").withColumn("session_date", times.ms_to_date(F.col("ts"))).filter("session_date IS NOT NULL")
    return _rows(dated, "cursor", session_id=conversation(F.col("path")), ts_ms=F.col("ts"), model=F.col("model"), cache_read=F.col("context"))


def gauges_by_date(requests: DataFrame) -> DataFrame:
    """(session_date, model): the sum of the gauges and the latest time."""
    return requests.groupBy("session_date", "model").agg(F.sum("cache_read").cast("bigint").alias("cache_read"), F.max("ts_ms").alias("ts_ms"))


def read_results(spark: SparkSession, stores: list[str]) -> DataFrame:
    """(path, call_id, body): what file reads returned, without line numbers; '' where it is no text. The last text by blob counts."""
    blobs = scan_sqlite(spark, stores, "SELECT id, cast(data AS TEXT) FROM blobs WHERE substr(cast(data AS TEXT), 1, 1) = '{'", "id string, data string", "blobs")
    v, c = F.col("v"), F.col("c")
    rows = blobs.withColumn("v", F.try_parse_json("data")).filter(json.strict_string(v, "$.role") == "tool")
    items = rows.select("path", "id", F.posexplode(json.items(v, "$.content")).alias("pos", "c")).filter((json.strict_string(c, "$.type") == "tool-result") & json.strict_string(c, "$.toolName").isin("Read", "ReadFile"))
    items = items.select("path", nonempty(json.strict_string(c, "$.toolCallId")).alias("call_id"), "id", "pos", json.strict_string(c, "$.result").alias("said")).filter("call_id IS NOT NULL")
    last = F.max_by("said", F.when(F.col("said").isNotNull(), F.struct("id", "pos")))
    return items.groupBy("path", "call_id").agg(last.alias("said")).select("path", "call_id", F.col("said").alias("body"))
