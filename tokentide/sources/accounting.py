"""What became of a log's records: each source's counters, its verdict and why it failed.

A record is malformed (no JSON), recognized (of a type that its format has) or strange. A record or
a call is relevant if it should bear a request or an operation, and normalized if it did. What a
line tells by itself is an array of verdicts, made in one pass over the lines; what only a call and
its result tell together comes from the pairs that the operation readers make.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions import json
from tokentide.operators import diagnostics, windows
from tokentide.operators.windows import nonempty
from tokentide.sources import operations, usage_logs
from tokentide.sources.operations import _blank
from tokentide.sources.usage_logs import _get

COUNTERS = "provider string, path string, session_date date, records bigint, malformed bigint, recognized bigint, relevant bigint, normalized bigint"
_NONE = "cast(array() as array<boolean>)"


def _one(condition: Column, fine: Column) -> Column:
    """A verdict where ``condition`` holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.coalesce(fine, F.lit(False)))).otherwise(F.expr(_NONE))


def _each(items: Column, condition, fine) -> Column:
    kept = F.filter(items, lambda x: F.coalesce(condition(x), F.lit(False)))
    return F.transform(kept, lambda x: F.coalesce(fine(x), F.lit(False)))


def _typed(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(json.variant_type(v, path) == kind, F.lit(False))


def _claude_line(v: Column, kind: Column) -> Column:
    spoken = kind == "assistant"
    usage, model = _get(v, "$.message.usage"), nonempty(json.strict_string(v, "$.message.model"))

    def usable(u: Column) -> Column:
        return json.usable_counts(u, usage_logs._CLAUDE, usage_logs._CLAUDE_NESTED)

    counted = spoken & json.has(v, "$.message.usage") & ~_typed(v, "$.message.usage", "VOID")
    fine = usable(usage) & model.isNotNull()
    steps = F.when(counted & fine, json.items(usage, "$.iterations")).otherwise(F.expr("cast(array() as array<variant>)"))
    advised = _each(steps, lambda x: json.strict_string(x, "$.type") == "advisor_message", lambda x: usable(x) & (F.coalesce(json.strict_string(x, "$.model"), model) != ""))

    def fits(x: Column) -> Column:
        given = {f: json.strict_string(x, f"$.input.{f}") for f in ("file_path", "content", "old_string", "new_string", "command")}
        named, name = ~_blank(given["file_path"]), json.strict_string(x, "$.name")
        fit = F.when(name == "Read", named).when(name == "Write", named & given["content"].isNotNull()).when(name == "Edit", named & given["old_string"].isNotNull() & given["new_string"].isNotNull())
        return F.coalesce(fit.when(name == "Bash", ~_blank(given["command"])).otherwise(name.isin(operations._CLAUDE_TODO)), F.lit(False))

    def judged(x: Column) -> Column:
        """Calls of file tools that do not fit wait for their result, if they have an id."""
        name = json.strict_string(x, "$.name")
        known = name.isin("Bash", *operations._CLAUDE_TODO) | name.isin(list(operations._CLAUDE_FILE)) & (fits(x) | (F.coalesce(json.strict_string(x, "$.id"), F.lit("")) == ""))
        return (json.strict_string(x, "$.type") == "tool_use") & known

    content = F.when(spoken, json.items(v, "$.message.content")).otherwise(F.expr("cast(array() as array<variant>)"))
    return F.concat(_one(spoken & ~json.is_object(v, "$.message"), F.lit(False)), _one(counted, fine), advised, _each(content, judged, fits))


def _claude_pairs(lines: DataFrame) -> DataFrame:
    calls, shown, met = operations.claude_exchange(operations.claude_rows(lines))
    files = list(operations._CLAUDE_FILE)
    odd = F.col("call.name").isin(files) & ~F.coalesce("call.fits", F.lit(False))
    seen = shown.filter("what IS NOT NULL").select("path", (F.col("what") != "unsupported").alias("normalized"))
    refused = met.filter(F.col("error") & odd).select("path", F.lit(True).alias("normalized"))
    told = met.filter(~F.col("top") & F.col("side") & ~F.col("error") & F.col("call.name").isin(files)).select("path", F.coalesce("call.fits", F.lit(False)).alias("normalized"))
    last = calls.filter("id <> ''").groupBy("path", "id").agg(F.max_by(F.struct("line_no", "pos", "name", "fits"), "at").alias("c"))
    last = last.select("path", "c.*").filter(F.col("name").isin(files) & ~F.coalesce("fits", F.lit(False)))
    waiting = last.join(met.select("path", "call.line_no", "call.pos"), ["path", "line_no", "pos"], "left_anti").select("path", F.lit(False).alias("normalized"))
    return reduce(DataFrame.unionByName, [seen, refused, told, waiting])


def _codex_line(v: Column, kind: Column) -> Column:
    inner, event, item = json.strict_string(v, "$.payload.type"), kind == "event_msg", kind == "response_item"
    there = json.has(v, "$.payload.type") & inner.isNull()
    info = _get(v, "$.payload.info")
    counted = event & (inner == "token_count") & info.isNotNull() & ~_typed(v, "$.payload.info", "VOID")
    patched = event & (inner == "patch_apply_end") & F.try_variant_get(v, "$.payload.success", "boolean")
    shell = item & (inner == "function_call") & json.strict_string(v, "$.payload.name").isin("shell", "exec_command")
    return F.concat(
        _one((event | item) & there, F.lit(False)),
        _one(counted, usage_logs._codex_usable(info)),
        _one(patched, json.is_object(v, "$.payload.changes") & (F.size(operations.codex_changes(v)) > 0)),
        _one(shell & json.strict_string(v, "$.payload.call_id").isNull(), F.lit(False)),
    )


def _codex_pairs(lines: DataFrame) -> DataFrame:
    rows = operations.codex_rows(lines)
    v = F.col("v")
    calls, met, custom, done = operations.codex_exchange(rows)
    made = calls.filter("script IS NOT NULL").select("path", F.lit(True).alias("normalized"))
    output = F.col("result.output")
    fine = F.col("call.script").isNotNull() | F.coalesce(operations.rejects_arguments(output), F.lit(False))
    ran = met.select("path", fine.alias("normalized"))
    last = calls.groupBy("path", "id").agg(F.max_by(F.struct("line_no", "pos", "script"), "at").alias("c")).select("path", "c.*").filter("script IS NULL")
    waiting = last.join(met.select("path", "call.line_no", "call.pos"), ["path", "line_no", "pos"], "left_anti").select("path", F.lit(False).alias("normalized"))
    begun = rows.filter((json.strict_string(v, "$.payload.type") == "custom_tool_call") & (json.strict_string(v, "$.type") == "response_item") & json.strict_string(v, "$.payload.name").isin("exec", "apply_patch"))
    begun = begun.select("path", "line_no").join(custom.select("path", "line_no", F.lit(True).alias("ok")), ["path", "line_no"], "left").select("path", F.coalesce("ok", F.lit(False)).alias("normalized"))
    ended = done.select("path", ((F.col("call.name") == "exec") | (operations.patch_result(F.coalesce(output, F.lit(""))) != "unknown")).alias("normalized"))
    return reduce(DataFrame.unionByName, [made, ran, waiting, begun, ended])


def _copilot_line(v: Column, kind: Column) -> Column:
    metrics = F.map_values(json.entries(v, "$.data.modelMetrics"))

    def supported(m: Column) -> Column:
        nothing = ~json.has(m, "$.usage") | _typed(m, "$.usage", "VOID")
        return F.coalesce(json.is_object(m) & (nothing | json.usable_counts(_get(m, "$.usage"), usage_logs._COPILOT)), F.lit(False))

    named = {f: nonempty(json.strict_string(v, f"$.data.{f}")).isNotNull() for f in ("toolCallId", "toolName")}
    return F.concat(
        _one(kind == "session.shutdown", json.is_object(v, "$.data.modelMetrics") & F.forall(metrics, supported)),
        _one((kind == "tool.execution_start") & ~(named["toolCallId"] & named["toolName"]), F.lit(False)),
        _one((kind == "tool.execution_complete") & ~named["toolCallId"], F.lit(False)),
    )


def _copilot_pairs(lines: DataFrame) -> DataFrame:
    rows, _, ends, met = operations.copilot_exchange(lines)
    v, kind = F.col("v"), json.strict_string(F.col("v"), "$.type")
    said = rows.filter((kind == "session.model_change") | (kind == "assistant.message") & json.has(v, "$.data.outputTokens"))
    said = said.select("path", "line_no", F.when(kind == "session.model_change", json.strict_string(v, "$.data.newModel")).alias("named"), (kind == "assistant.message").alias("spoken"), json.strict_int(v, "$.data.outputTokens").alias("n"))
    said = windows.carry_forward(usage_logs.in_parts(said), "named", ["path"], ["line_no"], "model", usage_logs.PART).filter("spoken").select("path", F.expr("n IS NOT NULL AND model IS NOT NULL").alias("normalized"))
    alone = ends.filter("ok").join(met.select("path", "result.line_no"), ["path", "line_no"], "left_anti").select("path", F.lit(False).alias("normalized"))
    a, tool = F.col("call.a"), F.col("call.tool")
    named = nonempty(json.first_string(a, ["path"])).isNotNull()
    body, old, new = (json.first_string(a, f).isNotNull() for f in (["file_text", "content"], ["old_string", "old_str", "old_text"], ["new_string", "new_str", "new_text"]))
    read = json.has(a, "$.view_range[1]") | F.col("result.said").isNotNull()
    whole = (
        F.when(tool == "read", named & read).when(tool == "write", named & body).when(tool == "edit", named & old & new).when(tool == "patch", F.exists(operations.copilot_patch(a), lambda p: p["file"] != ""))
        .when(tool == "shell", ~_blank(json.first_string(a, ["command", "cmd"]))).when(tool == "input", ~_blank(json.first_string(a, ["input"]))).otherwise(True)
    )
    fine = F.when(F.col("result.ok").isNull(), False).when(~F.col("result.ok"), True).otherwise(F.coalesce(whole, F.lit(False)))
    done = met.filter(tool.isNotNull()).select("path", fine.alias("normalized"))
    return reduce(DataFrame.unionByName, [said, alone, done])


def _gemini_line(v: Column, kind: Column) -> Column:
    message = json.strict_string(v, "$.id").isNotNull() & kind.isNotNull()
    several = F.coalesce(~message, F.lit(True)) & json.has(v, "$['$set'].messages")
    unnamed = lambda m: (json.strict_string(m, "$.type") == "gemini") & nonempty(json.strict_string(m, "$.id")).isNull()
    listed = F.when(several, json.items(v, "$['$set'].messages")).otherwise(F.expr("cast(array() as array<variant>)"))
    return F.concat(_one(several & ~json.is_array(v, "$['$set'].messages"), F.lit(False)), _one(message & unnamed(v), F.lit(False)), _each(listed, unnamed, lambda m: F.lit(False)))


def _gemini_pairs(lines: DataFrame) -> DataFrame:
    m = F.col("m")
    usable = json.usable_counts(_get(m, "$.tokens"), usage_logs._GEMINI, empty=False) & nonempty(json.strict_string(m, "$.model")).isNotNull()
    some = json.has(m, "$.tokens") & ~_typed(m, "$.tokens", "VOID")
    rows = usage_logs.gemini_revisions(lines.filter("not malformed")).withColumn("tokens", F.when(some, F.coalesce(usable, F.lit(False))))
    last = windows.last_revision(rows.withColumn("ts_ms", F.lit(None).cast("bigint")), ["path"], "id", ["line_no", "pos"], ["tokens"])
    counted = last.filter("tokens IS NOT NULL").select("path", F.col("tokens").alias("normalized"))
    status = F.col("status")
    called = operations.gemini_calls(last).select("path", F.when(status == "success", F.coalesce("whole", F.lit(False))).otherwise(status == "failed").alias("normalized"))
    return counted.unionByName(called)


def _deepseek_line(v: Column, kind: Column) -> Column:
    told = (kind == "assistant/message") & json.has(v, "$.data.usage") & ~json.is_object(v, "$.data.usage")
    sampled = (kind == "assistant/chunk") & (json.strict_string(v, "$.data.chunk.type") == "usage") & json.has(v, "$.data.chunk.usage") & ~json.is_object(v, "$.data.chunk.usage")
    return F.concat(_one(told, F.lit(False)), _one(sampled, F.lit(False)))


def _deepseek_pairs(lines: DataFrame) -> DataFrame:
    good = lines.filter("not malformed")
    routed = usage_logs.deepseek_samples(good).select("path", F.col("model").isNotNull().alias("normalized"))
    rows = usage_logs.readable_deepseek(good).withColumns({"pos": F.lit(0), "ts_ms": F.lit(0).cast("bigint")})
    a, meta, tool = F.try_parse_json("args"), F.col("meta"), F.col("tool")
    file = json.strict_string(a, "$.file_path")
    fine = F.when(tool == "read", nonempty(F.coalesce(json.strict_string(meta, "$.path"), file)).isNotNull()).when(tool.isin("write", "edit"), file.isNotNull()).when(tool == "run", json.strict_string(a, "$.command").isNotNull()).otherwise(True)
    done = operations.deepseek_exchange(rows).filter("NOT bad AND tool IS NOT NULL").select("path", fine.alias("normalized"))
    return routed.unionByName(done)


_LINES = {"claude": _claude_line, "codex": _codex_line, "copilot": _copilot_line, "gemini": _gemini_line, "deepseek": _deepseek_line}
_PAIRS = {"claude": _claude_pairs, "codex": _codex_pairs, "copilot": _copilot_pairs, "gemini": _gemini_pairs, "deepseek": _deepseek_pairs}


def line_verdicts(lines: DataFrame, provider: str) -> DataFrame:
    """``lines`` with ``recognized`` and ``verdicts``, an array with one boolean, normalized or not, for each thing relevant that the line tells by itself."""
    v = F.col("v")
    made = _LINES[provider](v, json.strict_string(v, "$.type"))
    return diagnostics.recognized(lines, provider).withColumn("verdicts", F.when(F.col("malformed"), F.expr(_NONE)).otherwise(made))


def pair_verdicts(lines: DataFrame, provider: str) -> DataFrame:
    """(path, normalized) of everything relevant that several lines tell together."""
    return _PAIRS[provider](lines)


def source_counters(lines: DataFrame, provider: str) -> DataFrame:
    """COUNTERS of every source of a provider whose logs are lines. A source of a foreign version has nothing recognized."""
    judged = line_verdicts(lines, provider)
    if provider == "deepseek":
        known = usage_logs.readable_deepseek(lines.select("path", "v")).select("path").distinct().withColumn("known", F.lit(True))
        judged = judged.join(known, "path", "left").withColumn("recognized", F.col("recognized") & F.coalesce("known", F.lit(False)))
    alone = judged.groupBy("path", "session_date").agg(
        F.count("*").alias("records"), F.count_if("malformed").alias("malformed"), F.count_if("recognized").alias("recognized"),
        F.sum(F.size("verdicts")).alias("relevant"), F.sum(F.size(F.filter("verdicts", lambda x: x))).alias("normalized"),
    )
    paired = pair_verdicts(lines, provider).groupBy("path").agg(F.count("*").alias("__relevant"), F.count_if("normalized").alias("__normalized"))
    both = alone.join(paired, "path", "left")
    sums = {c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in ("relevant", "normalized")}
    return both.select(F.lit(provider).alias("provider"), "path", "session_date", "records", "malformed", "recognized", *[x.cast("long").alias(c) for c, x in sums.items()])


def grok_counters(signals: DataFrame, summaries: DataFrame, updates: DataFrame) -> DataFrame:
    """COUNTERS of Grok's sessions: their signals, a broken summary, and every ended call of a known tool."""
    v = F.col("v")
    folder = operations._folder(F.col("path")).alias("folder")
    good = usage_logs.is_grok_signals(v) & ~F.col("malformed")
    own = signals.select("path", "session_date", folder, F.col("malformed").cast("long").alias("malformed"), F.coalesce(good, F.lit(False)).cast("long").alias("recognized"))
    broken = summaries.filter("malformed").select(folder).unionByName(updates.filter("malformed").select(folder)).groupBy("folder").agg(F.count("*").alias("broken"))
    _, met = operations.grok_exchange(own.filter("recognized = 1").select("path", "folder"), updates)
    a, o, name = F.col("call.a"), F.col("result.o"), F.col("call.name")
    changed = nonempty(F.coalesce(json.strict_string(o, "$.EditsApplied.absolute_path"), json.strict_string(a, "$.file_path"))).isNotNull()
    seen = nonempty(F.coalesce(json.strict_string(o, "$.FileContent.absolute_path"), json.strict_string(a, "$.target_file"))).isNotNull()
    edits = (F.size(json.items(o, "$.EditsApplied.edits.details")) > 0) | json.strict_string(a, "$.old_string").isNotNull() & json.strict_string(a, "$.new_string").isNotNull()
    fine = (
        F.when(F.col("result.status") == "failed", True).when(name == "read_file", seen).when(name == "grep", json.strict_int(o, "$.exit_code").isNotNull())
        .when(name == "write", changed & json.strict_string(a, "$.content").isNotNull()).when(name == "search_replace", changed & edits)
        .when(name == "run_terminal_command", json.strict_string(a, "$.command").isNotNull()).otherwise(True)
    )
    tracked = name.isin(operations._GROK_TOOLS)
    known = met.filter(tracked | name.isin(operations._GROK_OTHER)).groupBy("path").agg(F.count("*").alias("ended"), F.count_if(tracked).alias("told"), F.count_if(tracked & fine).alias("fine"))
    rows = own.join(broken, "folder", "left").join(known, "path", "left").fillna(0, ["broken", "ended", "told", "fine"])
    sums = {"records": F.lit(1) + F.col("broken") + F.col("ended"), "malformed": F.col("malformed") + F.col("broken"), "recognized": F.col("recognized") + F.col("ended"), "relevant": F.col("recognized") + F.col("told"), "normalized": F.col("recognized") + F.col("fine")}
    return rows.select(F.lit("grok").alias("provider"), "path", "session_date", *[x.cast("long").alias(c) for c, x in sums.items()])


def provider_counters(provider: str, tables: tuple[DataFrame, ...]) -> DataFrame:
    """COUNTERS from what the provider's operation reader takes."""
    return grok_counters(*tables[:3]) if provider == "grok" else source_counters(tables[0], provider)
