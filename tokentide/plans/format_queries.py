"""Queries of log formats, patches, shell commands and quotas over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.functions import json, text
from tokentide.operators import diagnostics, export
from tokentide.plans.adapters import event_log, table
from tokentide.plans.registry import query
from tokentide.schemas import NAMES
from tokentide.sources import accounting, logs, operations, quota, sqlite
from tokentide.streaming import incremental

E = "events"
N, U = "event_id", "user_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


@query(f"""SELECT {N}, CASE WHEN {N} % 3 = 0 THEN 'add' WHEN {N} % 3 = 1 THEN 'update' ELSE 'delete' END AS action,
    CASE WHEN {N} % 3 = 1 AND {N} % 2 = 0 THEN 'moved-' ELSE 'file-' END || {U} AS file,
    CASE WHEN {N} % 3 = 0 THEN '' ELSE 'was ' || {N} END AS old, CASE WHEN {N} % 3 = 2 THEN '' ELSE 'is' || chr(10) || '+' || {U} END AS new FROM {E}""")
def patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of one file from each event, and what its parts are."""
    kind = F.element_at(F.array(F.lit("Add"), F.lit("Update"), F.lit("Delete")), (F.col(N) % 3 + 1).cast("int"))
    head = F.concat(F.lit("noise\n*** Begin Patch\n*** "), kind, F.lit(" File: file-"), F.col(U), F.lit(" \r\n"))
    move = F.when((F.col(N) % 3 == 1) & (F.col(N) % 2 == 0), F.concat(F.lit("*** Move to: moved-"), F.col(U), F.lit("\n"))).otherwise("")
    old = F.when(F.col(N) % 3 == 0, "").otherwise(F.concat(F.lit("@@ -1 +1 @@\n-was "), F.col(N), F.lit("\n")))
    new = F.when(F.col(N) % 3 == 2, "").otherwise(F.concat(F.lit("+is\n same\n++"), F.col(U), F.lit("\n")))
    patch = F.concat(head, move, old, new, F.lit("*** End Patch\n*** Add File: no"))
    files = events(spark, sf_dir).select(N, F.explode(text.patch_files(patch, moves=True)).alias("f"))
    return files.select(N, "f.action", "f.file", "f.old", "f.new")


@query(f"SELECT {N}, CASE {N} % 4 WHEN 0 THEN 'sed' WHEN 1 THEN 'cat' WHEN 2 THEN 'patch' ELSE 'run' END AS kind, CASE {N} % 4 WHEN 0 THEN 'a-' || {U} WHEN 1 THEN 'b-' || {U} ELSE '' END AS path FROM {E}")
def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [F.concat(F.lit("cd x && sed -n '1,5p' \"a-"), F.col(U), F.lit('"')), F.concat(F.lit("set -e\n cat b-"), F.col(U), F.lit(" | wc")), F.lit("apply <<E\n*** Begin Patch\nE"), F.concat(F.lit("ls "), F.col(U))]
    command = F.element_at(F.array(*shapes), (F.col(N) % 4 + 1).cast("int"))
    return events(spark, sf_dir).select(N, text.shell_kind(command).alias("kind"), text.shell_read_path(command).alias("path"))


@query(f"SELECT {N}, CASE WHEN {N} % 3 = 2 THEN {_lines("'Key: 1'", "'Output:'", f"{N}::VARCHAR")} ELSE {N}::VARCHAR END AS body FROM {E}")
def exec_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.element_at(F.array(F.lit("Chunk ID: 1\nWall time: 2 seconds\nOutput:\n"), F.lit("Output:\n"), F.lit("Key: 1\nOutput:\n")), (F.col(N) % 3 + 1).cast("int"))
    return events(spark, sf_dir).select(N, text.strip_exec_header(F.concat(heads, F.col(N))).alias("body"))


@query(f"""SELECT {N}, CASE WHEN {N} % 3 = 0 THEN {_lines("'a: b'", f"{N}::VARCHAR")} WHEN {N} % 3 = 1 THEN {_lines(f"{N}::VARCHAR", "'x'")} ELSE '' END AS body,
    {_lines(f"{U}::VARCHAR", "'two'")} AS numbered FROM {E}""")
def read_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col(N).cast("string")
    shapes = [F.concat(F.lit("<content>\n1: a: b\n2: "), n, F.lit("\n</content>")), F.concat(F.lit("p\nfile\n\n1: "), n, F.lit("\n2: x\nend")), F.concat(F.lit("p\ndirectory\n\n1: "), n)]
    output = F.element_at(F.array(*shapes), (F.col(N) % 3 + 1).cast("int"))
    piped = F.concat(F.lit("   1|"), F.col(U), F.lit("\nnote\n 22|two"))
    return events(spark, sf_dir).select(N, text.read_body(output).alias("body"), text.numbered_lines(piped).alias("numbered"))


@query(f"""SELECT {N}, CASE {N} % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'pending' WHEN 4 THEN 'unsupported' ELSE 'unsupported' END AS status FROM {E}""")
def tool_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ['{"status": "success"}', '{"status": "error"}', '{"status": "running"}', '{"result": []}', '{"result": [1]}', '{"status": "odd"}']
    call = F.element_at(F.array(*map(F.lit, shapes)), (F.col(N) % 6 + 1).cast("int"))
    return events(spark, sf_dir).select(N, operations.tool_status(F.parse_json(call)).alias("status"))


@query(f"""SELECT {N}, CASE {N} % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE false END AS usable, {N} % 5 = 0 AS usable_if_not_empty FROM {E}""")
def usable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which token objects count: whole numbers, an empty one where the format allows it, no text, null or unknown field alone."""
    shapes = ['{"a": 1, "x": "y"}', "{}", '{"a": "1"}', '{"a": 1, "b": null}', '{"x": 1}']
    v = F.parse_json(F.element_at(F.array(*map(F.lit, shapes)), (F.col(N) % 5 + 1).cast("int")))
    return events(spark, sf_dir).select(N, json.usable_counts(v, ["a", "b"]).alias("usable"), json.usable_counts(v, ["a", "b"], empty=False).alias("usable_if_not_empty"))


@query(f"SELECT {N}, e.key AS path, e.value::VARCHAR AS value FROM (SELECT {N}, unnest(map_entries(CAST(json(props) AS MAP(VARCHAR, JSON)))) AS e FROM {E}) UNION ALL SELECT {N}, 'list[' || k || '].n', ({U} + k)::VARCHAR FROM {E}, range(2) r(k)")
def flattened_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = F.concat(F.substring_index("props", "}", 1), F.lit(', "list": [{"n": '), F.col(U), F.lit('}, {"n": '), F.col(U) + 1, F.lit("}]}"))
    return export.flatten_json(events(spark, sf_dir).select(N, deep.alias("j")), "j").select(N, "path", "value")


@query(f"""SELECT {N}, CASE WHEN {N} % 4 IN (0, 3) THEN {U}::DOUBLE WHEN {N} % 4 = 1 THEN 50.0 END AS five_hour, CASE WHEN {N} % 4 IN (0, 3) THEN 50.0 WHEN {N} % 4 = 1 THEN {U}::DOUBLE END AS seven_day,
    CASE WHEN {U} >= 90 THEN 'red' WHEN {U} >= 70 THEN 'yellow' ELSE 'green' END AS shade, {N} % 2 = 1 AS live FROM {E}""")
def quota_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows told in either order, by position, or of lengths that no slot has; which are live and how full."""
    seconds = lambda *of: F.element_at(F.array(*[F.lit(x).cast("long") for x in of]), (F.col(N) % 4 + 1).cast("int"))
    first = quota.window(F.col(U), F.col(N) % 2 + 9)
    five, seven = quota.slots([(first, seconds(18000, 604800, 60, None)), (quota.window(F.lit(50), F.lit(1)), seconds(604800, 18000, 60, None))])
    return events(spark, sf_dir).select(N, five["used_percent"].alias("five_hour"), seven["used_percent"].alias("seven_day"), quota.gauge_class(F.col(U)).alias("shade"), quota.is_live(first, F.lit(9)).alias("live"))


@query(f"SELECT {N}, printf('%.2f', {N} / 100.0) || CASE WHEN {N} % 2 = 0 THEN '' ELSE ' EUR' END AS amount, CASE WHEN {N} > 21600 THEN 'old' WHEN {N} > 3600 THEN 'stale' ELSE 'fresh' END AS age FROM {E}")
def money_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = quota.money(F.col(N), F.lit(2), F.when(F.col(N) % 2 == 1, "EUR"))
    return events(spark, sf_dir).select(N, F.regexp_replace(shown, r"^\$", "").alias("amount"), quota.staleness(F.col(N)).alias("age"))


@query(f"SELECT {U}, list(x ORDER BY x NULLS LAST) AS expirations FROM (SELECT {U}, CASE WHEN {N} % 3 = 0 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS x FROM {E} WHERE event_type <> 'view') GROUP BY {U}")
def reset_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of credits for each user, the views used up; when the others expire, unknown ones last."""
    when = F.when(F.col(N) % 3 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    credit = F.struct(F.when(F.col("event_type") == "view", "used").otherwise("available").alias("status"), when.alias("expires_at"))
    bodies = events(spark, sf_dir).groupBy(U).agg(F.to_json(F.struct(F.collect_list(credit).alias("credits"))).alias("body")).withColumn("now", F.lit(0).cast("long"))
    return quota.reset_credits(bodies).filter(F.size("expirations") > 0).select(U, "expirations")


@query(f"""WITH r AS (SELECT {N}, {U}, ts::DATE AS day FROM {E}), k AS (SELECT *, dense_rank() OVER (PARTITION BY {U} % 4 ORDER BY day DESC) AS d FROM r)
    SELECT {N} FROM k WHERE d <= 14 ORDER BY {N} DESC LIMIT 64""")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 last changed of the files in the 14 latest folders of each root: the limits are the feature."""
    root = F.concat(F.lit("/r"), F.col(U) % 4)
    files = events(spark, sf_dir).select(root.alias("root"), F.concat(root, F.lit("/"), F.to_date("ts"), F.lit("/"), F.lpad(F.col(N).cast("string"), 9, "0")).alias("path"), F.col(N).alias("modified"))
    return quota.newest_files(files).select(F.col("modified").alias(N))


@query(f"SELECT {N}, CASE {N} % 5 WHEN 0 THEN 'plain' WHEN 1 THEN 'text' WHEN 2 THEN 'p/m' WHEN 3 THEN 'q/m' END AS model FROM {E}")
def legacy_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [" plain ", '"text"', '{"id": "m", "providerID": "p"}', '{"id": "q/m", "provider_id": "q"}', "null"]
    return events(spark, sf_dir).select(N, sqlite.legacy_model(F.element_at(F.array(*map(F.lit, shapes)), (F.col(N) % 5 + 1).cast("int"))).alias("model"))


@query(f"SELECT {U}::VARCHAR AS path, CASE {U} % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'gemini' WHEN 2 THEN 'codex' ELSE 'codex' END AS provider FROM {E} GROUP BY {U}")
def detected_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of each user's events whose records bear a marker late, first, only second, or none."""
    at = F.row_number().over(_by_user())
    records = F.when((F.col(U) % 4 == 0) & (at == 1) | (at == 2) & (F.col(U) % 4 == 0), F.lit('{"parentUuid": null}'))
    records = records.when((F.col(U) % 4 == 1) & (at == 1), F.lit('{"sessionId": "s", "projectHash": "h"}')).when((F.col(U) % 4 == 2) & (at == 2), F.lit('{"sessionId": "s", "projectHash": "h"}'))
    lines = events(spark, sf_dir).select(F.col(U).cast("string").alias("path"), F.to_date("ts").alias("session_date"), at.cast("long").alias("line_no"), F.parse_json(F.coalesce(records, F.lit('{"type": "x"}'))).alias("v"))
    return logs.detect_provider(lines.withColumn("malformed", F.lit(False)))


def _by_user():
    from pyspark.sql.window import Window

    return Window.partitionBy(U).orderBy("ts", N)


@query(f"""SELECT {U}::VARCHAR AS path, count(*) AS records, count(*) FILTER (WHERE {N} % 9 = 0) AS malformed, count(*) FILTER (WHERE {N} % 9 <> 0 AND event_type IN ('view', 'click')) AS recognized FROM {E} GROUP BY {U}""")
def record_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(F.lit("view"), F.lit("assistant"), F.lit("click"), F.lit("frame-link"))[F.col("event_type")]
    v = F.when(F.col(N) % 9 != 0, F.parse_json(F.concat(F.lit('{"type": "'), F.coalesce(kinds, F.lit("strange")), F.lit('"}'))))
    lines = events(spark, sf_dir).select(F.col(U).cast("string").alias("path"), F.col(N), v.alias("v")).withColumn("malformed", F.col("v").isNull())
    return accounting.source_counters(lines.withColumns({"session_date": F.lit(None).cast("date"), "line_no": F.col(N)}), "claude").select("path", "records", "malformed", "recognized")


@query(f"SELECT {U}::VARCHAR AS path, max({N}) AS modified, count(*) AS length FROM {E} GROUP BY {U} HAVING bool_or(event_type = 'view')")
def versions_with_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source for each user that has viewed, whose version takes in all of the user's events."""
    rows = events(spark, sf_dir).select(F.col(U).cast("string").alias("source"), "event_type", F.col(N).alias("modified"), F.lit(1).cast("long").alias("length"))
    first = rows.filter("event_type = 'view'").groupBy("source").agg(F.min("modified").alias("modified"), F.first("length").alias("length")).withColumn("path", F.col("source"))
    sides = rows.join(first.select("source", F.col("modified").alias("own")), "source").filter("modified <> own")
    return incremental.with_sides(first, sides).select("path", "modified", "length")


@query(f"""WITH r AS (SELECT {U}::VARCHAR AS path, {N} % 13 = 0 AS malformed, event_type IN ('view', 'click', 'purchase') AS known,
        CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS relevant,
        CASE event_type WHEN 'view' THEN ({N} % 3 <> 0 AND {N} % 5 <> 0)::INT WHEN 'click' THEN 1 + ({N} % 2)::INT ELSE 0 END AS normalized FROM {E}),
    c AS (SELECT path, count(*) AS records, count_if(malformed) AS malformed, count_if(known AND NOT malformed) AS recognized,
        coalesce(sum(relevant) FILTER (WHERE NOT malformed), 0)::BIGINT AS relevant, coalesce(sum(normalized) FILTER (WHERE NOT malformed), 0)::BIGINT AS normalized FROM r GROUP BY path)
    SELECT *, CASE WHEN records > 0 AND recognized = 0 OR relevant > 0 AND normalized = 0 THEN 'failed' WHEN malformed > 0 OR normalized < relevant THEN 'partial' ELSE 'ok' END AS verdict FROM c""")
def record_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs whose views are requests, some without a model or with a count that is none, and whose clicks call two tools, one of which may lack its command."""
    n = F.col(N)
    usage = F.concat(F.lit('{"type": "assistant", "message": {"model": "'), F.when(n % 3 != 0, "m").otherwise(""), F.lit('", "usage": {"input_tokens": '), F.when(n % 5 != 0, "7").otherwise('"7"'), F.lit("}}}"))
    calls = F.concat(F.lit('{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "TodoWrite"}, {"type": "tool_use", "name": "Bash", "input": {"command": "'), F.when(n % 2 == 1, "ls").otherwise(" "), F.lit('"}}]}}'))
    kind = F.col("event_type")
    raw = F.when(n % 13 == 0, "{").when(kind == "view", usage).when(kind == "click", calls).when(kind == "purchase", '{"type": "system"}').otherwise('{"type": "strange"}')
    rows = events(spark, sf_dir).select(F.col(U).cast("string").alias("path"), F.to_date("ts").alias("session_date"), n.alias("line_no"), F.try_parse_json(raw).alias("v"))
    counted = accounting.source_counters(rows.withColumns({"malformed": F.col("v").isNull(), "session_date": F.lit(None).cast("date")}), "claude")
    return diagnostics.verdict(counted).select("path", "records", "malformed", "recognized", "relevant", "normalized", "verdict")


@query(f"""SELECT {N}, {U}, row_number() OVER (ORDER BY {U} % 9, {U}::VARCHAR, 'error of ' || {N}) AS place FROM {E} WHERE event_type = 'error'""")
def failure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every failure in scan order."""
    provider = F.element_at(F.array(*map(F.lit, NAMES)), (F.col(U) % 9 + 1).cast("int")).alias("provider")
    error = F.concat(F.lit("error of "), F.col(N).cast("string")).alias("error")
    failures = events(spark, sf_dir).filter("event_type = 'error'").select(provider, F.col(U).cast("string").alias("path"), error, N, U)
    return export.with_places(failures).select(N, U, "place")
