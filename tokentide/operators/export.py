"""Shapes in which results leave: JSON rows, text lines, flattened documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentide.functions import tokens as t
from tokentide.operators.analysis import COUNTERS, session_totals
from tokentide.schemas import NAMES, STORES


def usage_json(priced: DataFrame) -> DataFrame:
    """One JSON string per row, fields in key order; a null matched model is left out."""
    usage = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sorted([*t.BUCKETS, "total", "web_search"])])
    return priced.select(F.to_json(F.struct("cost_usd", "matched_model", "model", usage.alias("usage"))).alias("value"))


def usage_text(priced: DataFrame) -> DataFrame:
    """'model (matched): $0.000000' in order of cost and model."""
    shown = F.when(F.col("matched_model").isNotNull(), F.concat("model", F.lit(" ("), "matched_model", F.lit(")"))).otherwise(F.col("model"))
    return priced.orderBy("cost_usd", "model").select(F.format_string("%s: $%.6f", shown, F.col("cost_usd")).alias("value"))


def analysis_text(rows: DataFrame) -> DataFrame:
    pairs = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in COUNTERS]
    return rows.orderBy("model").select(F.concat("model", F.lit(": "), F.concat_ws(" ", *pairs)).alias("value"))


def with_total(rows: DataFrame, label: str, sums: list[str]) -> DataFrame:
    """The rows and a TOTAL row."""
    total = rows.agg(*[F.sum(c).alias(c) for c in sums]).withColumn(label, F.lit("TOTAL"))
    return rows.select(label, *sums).unionByName(total.select(label, *sums))


def provider_footer(days: DataFrame) -> DataFrame:
    """Providers with active days, then the row over all (provider null)."""
    return days.filter((F.col("days") > 0) | F.col("provider").isNull())


#: Names that sessions bear outside. Fixed values.
EXTENSIONS = dict(zip(NAMES, ["Claude-Code", "Codex", "Copilot-CLI", "Gemini", "Grok", "DeepSeek-Harness", "OpenCode", "Cursor", "Hermes"]))
_CALLS = {"Bash": "run", "Edit": "edit", "Read": "read", "TodoWrite": "todo", "Write": "write"}


def _details(op: str, extra: list[tuple[str, str]], bare: bool = True) -> Column:
    """A session's operations of one kind in order, as structs."""
    base = [("line_count", "lineCount"), ("char_count", "characterCount"), ("file_path", "filePath"), ("ts_ms", "timestamp"), *extra]
    fields = F.struct("seq", F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(n) if c in ("command", "description", "content") else F.col(c).alias(n) for c, n in sorted(base, key=lambda x: x[1])]).alias("d"))
    shown = (F.col("op") == op) & F.col("file_path").isNotNull() & (F.lit(bare) | (F.col("line_count") > 0))
    return F.transform(F.array_sort(F.collect_list(F.when(shown, fields))), lambda x: x["d"])


def analysis_dataset(operations: DataFrame, sessions: DataFrame, requests: DataFrame, user: str = "", machine: str = "", version: str = "") -> DataFrame:
    """(provider, path, value): one JSON document per session: providers in scan order, logs by path, sessions of stores by date and source."""
    counts = session_totals(operations, ["path"])
    details = operations.groupBy("path").agg(
        _details("write", [("content", "content")]).alias("writeFileDetails"), _details("read", [], bare=False).alias("readFileDetails"),
        _details("edit", [("old_string", "oldString"), ("new_string", "newString")]).alias("editFileDetails"), _details("run", [("command", "command"), ("description", "description")]).alias("runCommandDetails"),
    )
    sums = {"cache_creation_input_tokens": F.sum(F.col("cc_5m") + F.col("cc_1h")), "cache_read_input_tokens": F.sum("cache_read"), "input_tokens": F.sum("input"), "output_tokens": F.sum("output")}
    reasons = F.when(F.first("provider").isin("claude", "grok"), None).otherwise(F.sum("reasoning"))
    used = requests.filter("NOT is_advisor AND model IS NOT NULL").groupBy("path", "model").agg(F.struct(*[x.cast("bigint").alias(n) for n, x in sums.items()], reasons.cast("bigint").alias("reasoning_output_tokens")).alias("u"))
    usage = used.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "u")))).alias("conversationUsage"))
    rows = sessions.join(counts.drop("last_ts"), "path", "left").join(details, "path", "left").join(usage, "path", "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0))
    fields = {f"total{op.title()}{name}": whole(f"{op}_{kind}") for op in ("edit", "read", "write") for kind, name in (("chars", "Characters"), ("lines", "Lines"))}
    fields |= {c: F.coalesce(F.col(c), F.array()) for c in ("editFileDetails", "readFileDetails", "runCommandDetails", "writeFileDetails")}
    fields |= {"conversationUsage": F.coalesce("conversationUsage", F.expr("map()")), "toolCallCounts": F.struct(*[whole(f"{op}_calls").alias(n) for n, op in _CALLS.items()]), "totalUniqueFiles": whole("unique_files")}
    fields |= {"folderPath": F.col("folder_path"), "gitRemoteUrl": F.col("git_remote_url"), "taskId": F.col("session_id"), "timestamp": F.col("last_ts")}
    record = F.struct(*[fields[n].alias(n) for n in sorted(fields)])
    name = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[F.col("provider")]
    document = F.struct(name.alias("extensionName"), F.lit(version).alias("insightsVersion"), F.lit(machine).alias("machineId"), F.array(record).alias("records"), F.lit(user).alias("user"))
    stored = F.when(F.col("provider").isin(STORES), F.col("session_date"))
    return rows.orderBy(scan_rank(F.col("provider")), stored, "path").select("provider", "path", F.to_json(document).alias("value"))


def _flat(value: object, path: str) -> Iterator[tuple[str, str]]:
    inside = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    if inside and len(inside if isinstance(value, dict) else value):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from _flat(v, f"{path}[{k}]" if isinstance(value, list) else f"{path}.{k}" if path else k)
    else:
        shown = value if isinstance(value, str) else "null" if value is None else json.dumps(value)
        yield path or "(root)", shown


@F.udtf(returnType="path string, value string")
class Flattened:
    """The leaves of a JSON text as (dotted path, value); empty objects and lists are leaves. Text that is no JSON has none."""

    def eval(self, text: str):
        try:
            yield from _flat(json.loads(text), "")
        except (TypeError, ValueError):
            return


def flatten_json(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the leaves of a JSON column, one row each."""
    return rows.lateralJoin(Flattened(F.col(column).outer()))


def scan_rank(provider: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in NAMES]), provider)


def failures_in_order(failures: DataFrame) -> DataFrame:
    """(provider, path, error) by scan order, path and error."""
    return failures.orderBy(scan_rank(F.col("provider")), "path", "error")


def with_places(failures: DataFrame) -> DataFrame:
    """``failures`` with their ``place`` in that order, from 1, which survives being written.

    Places are counted within each provider and moved by the counts of the providers before it.
    """
    counts = failures.groupBy("provider").agg(F.count("*").alias("__n")).withColumn("__rank", scan_rank(F.col("provider")))
    earlier = counts.select("provider", (F.sum("__n").over(Window.orderBy("__rank")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("provider").orderBy("path", "error"))
    return failures.withColumn("__own", own).join(F.broadcast(earlier), "provider").select(*failures.columns, (F.col("__before") + F.col("__own")).alias("place"))
