"""Session logs as lines: one row per line of each file, parsed as a variant, numbered in file order,
because order within a file decides what its records mean."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentide.functions import json
from tokentide.operators.pairing import drop_seen_names
from tokentide.operators.windows import numbered

#: provider -> (file name pattern, what a path must match, what it must not, depth below the root or None). Fixed values.
FILES = {
    "claude": ("*.jsonl", r"\.jsonl$", r"\.meta\.jsonl$", None),
    "codex": ("*.json*", r"\.jsonl?$", r"\.meta\.jsonl?$", None),
    "copilot": ("events.jsonl", r"/session-state/[^/]+/events\.jsonl$", "", 2),
    "gemini": ("*.jsonl", r"/chats/([^/]+/)?[^/]+\.jsonl$", "", None),
    "grok": ("signals.json", r"/sessions/[^/]+/[^/]+/signals\.json$", "", 3),
    "deepseek": ("session.jsonl", r"/sessions/[^/]+/[^/]+/session\.jsonl$", "", 3),
}
FILE = ["path", "session_date", "modified", "length"]


def _file_columns() -> list[Column]:
    meta = F.col("_metadata")
    changed = meta["file_modification_time"]
    return [meta["file_path"].alias("path"), F.to_date(changed).alias("session_date"), changed.alias("modified"), meta["file_size"].alias("length")]


def _below_reader(spark: SparkSession, pattern: str, lenient: bool) -> DataFrameReader:
    """A reader of files below folders; a ``lenient`` one goes on where a file is gone or cannot be read (scans.file_reads tells which)."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True) if lenient else reader


def read_files(spark: SparkSession, paths: str | list[str], pattern: str = "*", matching: str = "", barring: str = "", lenient: bool = False) -> DataFrame:
    """(path, session_date, modified, length, value): whole text files below ``paths``; the date is that of the file's last change."""
    if not paths:
        return spark.createDataFrame([], "path string, session_date date, modified timestamp, length bigint, value string")
    files = _below_reader(spark, pattern, lenient).text(paths, wholetext=True)
    return _matching(files.select(*_file_columns(), "value"), matching, barring)


def _matching(rows: DataFrame, matching: str, barring: str) -> DataFrame:
    rows = rows.filter(F.col("path").rlike(matching)) if matching else rows
    return rows.filter(~F.col("path").rlike(barring)) if barring else rows


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """The ``roots`` that are there."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [r for r in roots if path(r).getFileSystem(conf).exists(path(r))]


def named(path: str) -> str:
    """The file that a value of the column ``path``, a URI, names."""
    return unquote(path)


def readable(path: str) -> str:
    """The same as readers take it, which expand patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", named(path))


def _below(path: Column, roots: list[str]) -> Column:
    """(rank of the root that the path is below, path below it)."""
    out = F.lit(None).cast("struct<rank:int,path:string>")
    for k, root in reversed(list(enumerate(roots))):
        inside = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/")) + "/"
        out = F.when(F.contains(path, F.lit(inside)), F.struct(F.lit(k).alias("rank"), F.substring_index(path, inside, -1).alias("path"))).otherwise(out)
    return out


def within_depth(rows: DataFrame, roots: list[str], depth: int | None) -> DataFrame:
    """Rows whose ``path`` is at most ``depth`` levels below its root."""
    return rows.filter(F.size(F.split(_below(F.col("path"), roots)["path"], "/")) <= depth) if depth else rows


def first_of_names(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files without those whose name an earlier root has."""
    named = files.withColumns({"root_rank": _below(F.col("path"), roots)["rank"], "file_name": F.substring_index("path", "/", -1)})
    return drop_seen_names(named).drop("root_rank", "file_name")


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*", matching: str = "", barring: str = "", lenient: bool = False) -> DataFrame:
    """lines() of files of any length: splits of a file are read by different tasks.

    Lines of a split come in order, so a line's place is its place in the split after the sizes of
    the splits before it: no task holds a whole file.
    """
    if not paths:
        return lines(read_files(spark, paths))
    files = _below_reader(spark, pattern, lenient).option("lineSep", "\n").text(paths)
    place = [F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")]
    rows = _matching(files.select(*_file_columns()[:2], *place, F.col("value").alias("raw")), matching, barring)
    return _parsed(numbered(rows, ["path"], "split", ["row"], "line_no"))


#: Stands for the lines that a torn file has lost: it is no JSON.
TORN = b"{"


def _decoded(content: bytes) -> bytes:
    """All frames of a zstd file; of a torn one the whole lines before the tear, and TORN."""
    import zstandard

    out, rest, torn = [], memoryview(content), False
    try:
        while rest and not torn:
            frame = zstandard.ZstdDecompressor().decompressobj()
            at = 0
            while at < len(rest) and not frame.eof:
                out.append(frame.decompress(rest[at : at + (1 << 16)]))
                at += 1 << 16
            torn = not frame.eof
            rest = rest[min(at, len(rest)) - len(frame.unused_data) :]
    except zstandard.ZstdError:
        torn = True
    whole = b"".join(out)
    return whole[: whole.rfind(b"\n") + 1] + TORN if torn else whole


def read_zstd_files(spark: SparkSession, paths: str | list[str], pattern: str = "session.jsonl.zstd", lenient: bool = False) -> DataFrame:
    """read_files for zstd-compressed logs, torn tails included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_decoded(c).decode("utf-8", "replace") for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*FILE, "value"])

    if not paths:
        return read_files(spark, paths)
    files = _below_reader(spark, pattern, lenient).format("binaryFile").load(paths)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.to_date("modificationTime").alias("session_date"), F.col("modificationTime").alias("modified"), "length", "content")
    return rows.mapInArrow(run, "path string, session_date date, modified timestamp, length bigint, value string")


def lines(files: DataFrame) -> DataFrame:
    """(path, session_date, line_no, v, malformed) of every line that is not blank; ``v`` is null where it is no JSON."""
    return _parsed(files.select("path", "session_date", F.posexplode(F.split("value", "\n", -1)).alias("line_no", "raw")))


def _parsed(rows: DataFrame) -> DataFrame:
    parsed = rows.filter(F.trim("raw") != "").withColumn("v", F.try_parse_json("raw"))
    return parsed.select("path", "session_date", F.col("line_no").cast("long").alias("line_no"), "v", F.col("v").isNull().alias("malformed"))


def documents(files: DataFrame) -> DataFrame:
    """The same for files that are one JSON document each."""
    return files.select("path", "session_date", F.lit(0).cast("long").alias("line_no"), F.try_parse_json("value").alias("v")).withColumn("malformed", F.col("v").isNull())


def detect_provider(rows: DataFrame) -> DataFrame:
    """(path, provider) by the first record that bears a marker; a source without one is Codex.

    Markers of Grok, DeepSeek, Gemini and Copilot count in a source's first record only.
    """
    v, first = F.col("v"), F.col("line_no") == F.min("line_no").over(Window.partitionBy("path"))
    kind = json.strict_string(v, "$.type")

    def has(*fields: str) -> Column:
        return reduce(Column.__and__, [json.has(v, f"$.{f}") for f in fields])

    number = F.coalesce(json.number_as_int(v, "$.version").isNotNull(), F.lit(False))
    found = (
        F.when(first & has("primaryModelId", "contextTokensUsed") & (has("contextWindowTokens") | has("toolsUsed")), "grok")
        .when(first & (kind == "session") & number & json.strict_string(v, "$.id").isNotNull(), "deepseek")
        .when(first & has("sessionId", "projectHash") & ~has("messages"), "gemini")
        .when(first & (kind == "session.start") & json.strict_string(v, "$.data.producer").startswith("copilot"), "copilot")
        .when(has("parentUuid"), "claude")
        .when(kind.isin("session_meta", "turn_context", "event_msg", "response_item"), "codex")
    )
    marked = rows.filter("not malformed").withColumn("__p", found)
    at = F.when(F.col("__p").isNotNull(), F.col("line_no"))
    found = marked.groupBy("path").agg(F.min_by("__p", at).alias("provider"))
    return rows.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("provider", F.lit("codex")).alias("provider"))
