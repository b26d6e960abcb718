"""File operations of the file providers: what tools read, wrote, edited and ran.

Each reader takes its provider's lines and returns (operations, sessions), as OPERATIONS and
SESSIONS say. Calls meet their results by key (operators.pairing); what a tool's name and
arguments mean is looked up in columns; measures and paths are computed once, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tokentide.functions import json, text, times
from tokentide.operators import windows
from tokentide.operators.pairing import pair_calls, take_calls
from tokentide.operators.windows import nonempty
from tokentide.schemas import OPERATIONS, SESSIONS
from tokentide.sources import cursor as cursor_store
from tokentide.sources import logs, sqlite, usage_logs
from tokentide.sources.sqlite import scan_sqlite
from tokentide.sources.usage_logs import _get

AT = ["path", "line_no", "pos"]
_DRAFT = {"op": "string", "file": "string", "body": "string", "old": "string", "command": "string", "description": "string", "ts_ms": "bigint", "counts": "boolean", "raw": "boolean", "bare": "string"}


def _draft(rows: DataFrame, op: Column | str, **given: Column | str | bool) -> DataFrame:
    """Rows of (AT, _DRAFT): ``body`` is what was read or written or the edit's new text; ``counts`` tells whether the row is
    a call (true if not given); ``raw`` edits never become writes; ``bare``: what a read without lines leaves, nothing, its
    'count' or its 'path' too."""
    given = {"op": op, "counts": True, "raw": False, "bare": "nothing", "ts_ms": F.col("ts_ms")} | given
    columns = []
    for name, kind in _DRAFT.items():
        x = given.get(name)
        x = x if isinstance(x, Column) else F.lit(x)
        columns.append(x.cast(kind).alias(name))
    return rows.select(*AT, *columns)


def _at() -> Column:
    return F.struct("line_no", "pos").alias("at")


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def finish(drafts: DataFrame, sessions: DataFrame, provider: str) -> DataFrame:
    """OPERATIONS: paths under the session's folder, line and character counts; rows that mean nothing go."""
    rows = drafts.join(sessions.select("path", "session_id", "folder_path"), "path", "left")
    op, body = F.col("op"), text.trim_feeds(F.coalesce("body", F.lit("")))
    named = F.when(nonempty(F.col("file")).isNotNull(), text.normalize_path(F.col("file"), F.col("folder_path")))
    edits = F.when(op == "edit", text.classify_edit(F.col("old"), F.col("body"), F.col("raw"))).otherwise(op)
    rows = rows.withColumns({"resolved": named, "op": edits, "body": body, "lines": text.line_count(body)})
    called = F.col("file").isNull() & F.col("counts")
    kept = (
        F.when(F.col("op") == "read", called | (F.col("lines") > 0) & F.col("resolved").isNotNull() | (F.col("bare") == "count") | (F.col("bare") == "path"))
        .when(F.col("op").isin("write", "edit"), called | F.col("resolved").isNotNull())
        .when(F.col("op") == "run", ~_blank(F.col("command")) | F.col("command").isNull())
        .otherwise(True)
    )
    op, run = F.col("op"), F.col("op") == "run"
    command = F.trim("command")
    shown = F.when((op == "read") & (F.col("lines") == 0) & (F.col("bare") != "path"), None).otherwise(F.col("resolved"))
    given = {
        "provider": F.lit(provider), "path": F.col("path"), "session_id": F.col("session_id"), "seq": F.col("line_no") * (1 << 20) + F.col("pos"), "op": op,
        "file_path": F.when(run, F.col("folder_path")).otherwise(shown), "line_count": F.when(run, 0).otherwise(F.col("lines")),
        "char_count": F.when(run, F.coalesce(F.char_length(command), F.lit(0))).otherwise(F.char_length("body")), "ts_ms": F.col("ts_ms"), "counts_call": F.col("counts"),
        "content": F.when(op == "write", F.col("body")), "old_string": F.when(op == "edit", text.trim_feeds(F.coalesce("old", F.lit("")))), "new_string": F.when(op == "edit", F.col("body")),
        "command": F.when(run, command), "description": F.when(run, F.coalesce("description", F.lit(""))),
    }
    return rows.filter(kept).select(*[given[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(OPERATIONS)])


def _sessions(rows: DataFrame, provider: str, *, session_id: Column, folder: Column, ts: Column, remote: Column | None = None, last_id: bool = False) -> DataFrame:
    """SESSIONS: the first value that is not empty of each, or the last id; the latest time."""

    def first(x: Column) -> Column:
        return F.min_by(nonempty(x), F.when(nonempty(x).isNotNull(), F.col("line_no")))

    def last(x: Column) -> Column:
        return F.max_by(nonempty(x), F.when(nonempty(x).isNotNull(), F.col("line_no")))

    found = rows.groupBy("path", "session_date").agg(
        F.coalesce((last if last_id else first)(session_id), F.lit("")).alias("session_id"),
        F.coalesce(F.max(ts), F.lit(0)).alias("last_ts"),
        F.coalesce(first(folder), F.lit("")).alias("folder_path"),
        F.coalesce(first(remote) if remote is not None else F.lit(""), F.lit("")).alias("git_remote_url"),
    )
    return found.withColumn("provider", F.lit(provider)).select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SESSIONS)])


def _patched(rows: DataFrame, patches: Column, ts: Column, raw_updates: bool = False) -> DataFrame:
    """Drafts of the files of patches: added ones are writes, deleted ones edits to nothing."""
    each = rows.select("path", "line_no", ts.alias("ts_ms"), F.posexplode(patches).alias("pos", "p"))
    p = F.col("p")
    op = F.when(p["action"] == "add", "write").otherwise("edit")
    body = F.when(p["action"] == "delete", "").otherwise(p["new"])
    return _draft(each.filter(p["file"] != ""), op, file=p["file"], body=body, old=p["old"], raw=F.lit(raw_updates) | (p["action"] == "delete"))


# --- Claude ----------------------------------------------------------------------------------

#: Tools that keep lists of tasks. Fixed values.
_CLAUDE_TODO = ["TodoWrite", "TaskCreate", "TaskUpdate", "TaskStop"]
_CLAUDE_FILE = {"Read": "read", "Write": "write", "Edit": "edit"}


def _result_kind(t: Column, expected: Column) -> Column:
    """What a top-level result shows: 'read', 'write', 'edit', 'image', 'unsupported' or null (irrelevant), by its call's tool, else by its shape."""
    kind = F.coalesce(json.strict_string(t, "$.type"), F.lit(""))
    s = {f: json.strict_string(t, f"$.{f}") for f in ("filePath", "content", "oldString", "newString")}
    file = json.is_object(t, "$.file")
    path, body, old, new = (s[f].isNotNull() for f in s)
    image = F.when(file, "image").otherwise("unsupported")
    shown = (kind == "text") & ~_blank(json.strict_string(t, "$.file.filePath")) & json.strict_string(t, "$.file.content").isNotNull()
    read = F.when(kind == "image", image).when(shown, "read").otherwise("unsupported")
    made = kind.isin("create", "update")
    write = F.when(made & ~_blank(s["filePath"]) & body, "write").otherwise("unsupported")
    edit = F.when(~_blank(s["filePath"]) & old & new, "edit").otherwise("unsupported")
    plan = (kind == "") & ~body & ~old & ~new  # a plan's path, and no body
    by_shape = (
        F.when(kind == "image", image).when((kind == "text") | file, read).when(made | path & body, write).when((path | old | new) & ~plan, edit)
    )
    return F.when(expected == "Read", read).when(expected == "Write", write).when(expected == "Edit", edit).when(expected.isNull(), by_shape)


def claude_rows(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    return lines.filter("not malformed").withColumn("ts_ms", times.iso_ms(json.strict_string(v, "$.timestamp"))).withColumn("kind", json.strict_string(v, "$.type"))


def claude_exchange(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, what top-level results that met no call or met one show, results that met a call) of claude_rows()."""
    v, block = F.col("v"), F.col("b")
    content = json.items(v, "$.message.content")
    blocks = rows.select("path", "line_no", "ts_ms", "kind", "v", F.posexplode(content).alias("pos", "b")).withColumn("block", json.strict_string(block, "$.type"))
    calls = blocks.filter("kind = 'assistant' AND block = 'tool_use'").select(
        *AT, _at(), "ts_ms", json.strict_string(block, "$.id").alias("id"), json.strict_string(block, "$.name").alias("name"),
        *[json.strict_string(block, f"$.input.{f}").alias(f) for f in ("file_path", "content", "old_string", "new_string", "command", "description")],
    )
    path = ~_blank(F.col("file_path"))
    fits = F.when(F.col("name") == "Read", path).when(F.col("name") == "Write", path & F.col("content").isNotNull())
    fits = fits.when(F.col("name") == "Edit", path & F.col("old_string").isNotNull() & F.col("new_string").isNotNull()).otherwise(False)
    calls = calls.withColumn("fits", fits)
    result = _get(v, "$.toolUseResult")
    texts = [f"$.{f}" for f in ("type", "filePath", "content", "oldString", "newString", "file.filePath", "file.content")]
    odd = F.array_contains(F.array(*[F.coalesce(json.variant_type(result, f), F.lit("VOID")).isin("STRING", "VOID") for f in texts]), False)
    whole = json.is_object(result) & ~odd & (json.is_object(result, "$.file") | (F.coalesce(json.variant_type(result, "$.file"), F.lit("VOID")) == "VOID"))
    first = F.try_element_at(F.filter(content, lambda b: F.coalesce(json.strict_string(b, "$.type") == "tool_result", F.lit(False))), F.lit(1))
    whole = F.coalesce(whole, F.lit(False))
    top = rows.filter(whole).select("path", "line_no", F.lit(-1).alias("pos"), "ts_ms", first.alias("b"), result.alias("t"), F.lit(True).alias("top"), F.lit(False).alias("side"))
    side = F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False))
    inner = blocks.filter((F.col("kind") == "user") & (F.col("block") == "tool_result") & ~whole).select(*AT, "ts_ms", "b", F.lit(None).cast("variant").alias("t"), F.lit(False).alias("top"), side.alias("side"))
    parts = F.filter(F.transform(json.items(block, "$.content"), lambda x: json.strict_string(x, "$.text")), lambda x: x.isNotNull())
    said = F.coalesce(json.strict_string(block, "$.content"), F.array_join(parts, "\n"))
    results = top.unionByName(inner).select(
        *AT, _at(), "ts_ms", json.strict_string(block, "$.tool_use_id").alias("id"), F.coalesce(F.try_variant_get(block, "$.is_error", "boolean"), F.lit(False)).alias("error"), "t", "top", "side", said.alias("said")
    )
    paired = pair_calls(calls.filter("id <> ''"), results.filter("id IS NOT NULL"), ["path", "id"], "at").select("path", "call", "result")
    met = paired.select("path", *[F.col(f"result.{c}").alias(c) for c in ("line_no", "pos", "ts_ms", "error", "t", "top", "side", "said")], "call")
    alone = results.filter("top").join(met.select(*AT), AT, "left_anti").select("path", "line_no", "pos", "ts_ms", "error", "t", "top", "side", "said").withColumn("call", F.lit(None).cast(met.schema["call"].dataType))
    alone = alone.withColumn("error", F.lit(False))  # an error is one of a known call
    shown = met.unionByName(alone).filter("top AND NOT error").withColumn("what", _result_kind(F.col("t"), F.col("call.name")))
    return calls, shown, met


def claude(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls count where they are made, with arguments that fit; bodies come from results, which must not be errors."""
    v, t = F.col("v"), F.col("t")
    rows = claude_rows(lines)
    cwd, sid = json.strict_string(v, "$.cwd"), json.strict_string(v, "$.sessionId")
    sessions = _sessions(rows, "claude", session_id=sid, folder=cwd, ts=F.col("ts_ms"), last_id=True)
    calls, shown, met = claude_exchange(rows)
    op = F.create_map(*[F.lit(x) for pair in _CLAUDE_FILE.items() for x in pair])[F.col("name")]
    made = [
        _draft(calls.filter("fits"), op, bare="count"),
        _draft(calls.filter(F.col("name").isin(_CLAUDE_TODO)), "todo"),
        _draft(calls.filter("name = 'Bash' AND command IS NOT NULL"), "run", command=F.col("command"), description=F.col("description")),
    ]
    made += [
        _draft(shown.filter("what = 'read'"), "read", file=json.strict_string(t, "$.file.filePath"), body=json.strict_string(t, "$.file.content"), counts=False),
        _draft(shown.filter("what = 'image'"), "read", file=F.coalesce("call.file_path", F.lit("")), counts=False, bare="path"),
        _draft(shown.filter("what = 'write'"), "write", file=json.strict_string(t, "$.filePath"), body=json.strict_string(t, "$.content"), counts=False),
        _draft(shown.filter("what = 'edit'"), "edit", file=json.strict_string(t, "$.filePath"), old=json.strict_string(t, "$.oldString"), body=json.strict_string(t, "$.newString"), counts=False),
    ]
    told = met.filter("NOT top AND side AND NOT error AND call.fits")
    body = F.when(F.col("call.name") == "Read", F.col("said")).when(F.col("call.name") == "Write", F.col("call.content")).otherwise(F.col("call.new_string"))
    op = F.create_map(*[F.lit(x) for pair in _CLAUDE_FILE.items() for x in pair])[F.col("call.name")]
    made.append(_draft(told, op, file=F.col("call.file_path"), body=body, old=F.col("call.old_string"), counts=False))
    return finish(reduce(DataFrame.unionByName, made), sessions, "claude"), sessions


# --- Codex -----------------------------------------------------------------------------------

#: How outputs of applied and of refused patches begin. Fixed values.
_APPLIED = ["Success. Updated the following files:"]
_REFUSED = ["Failed", "Error", "apply_patch verification failed:", "Invalid patch", "apply_patch handler received", "apply_patch is unavailable"]
#: How an output that rejects a call's arguments begins, and what it says. Fixed values.
_REJECTS = ["error", "failed"]
_REASONS = ["failed to parse", "missing field", "missing required", "invalid argument"]


def _output_text(v: Column) -> Column:
    """A tool's output: a string, an object's ``output``, or the texts of its blocks; a string that is JSON with an ``output`` is that."""
    blocks = F.transform(json.items(v, "$.payload.output"), lambda b: F.coalesce(json.strict_string(b, "$"), json.strict_string(b, "$.text")))
    plain = F.coalesce(json.strict_string(v, "$.payload.output"), json.strict_string(v, "$.payload.output.output"), F.array_join(F.filter(blocks, lambda b: b.isNotNull()), "\n"))
    return F.coalesce(json.strict_string(F.try_parse_json(plain), "$.output"), plain)


def _begins(said: Column, texts: list[str]) -> Column:
    return reduce(Column.__or__, [said.startswith(x) for x in texts])


def rejects_arguments(output: Column) -> Column:
    """Whether a tool's output says that the model's arguments could not be read, so nothing ran."""
    said = F.lower(F.ltrim(text.strip_exec_header(output)))
    return _begins(said, _REJECTS) & reduce(Column.__or__, [F.contains(said, F.lit(x)) for x in _REASONS])


def patch_result(output: Column) -> Column:
    """'applied', 'refused' or 'unknown', by what a patch tool's output says: a text, a JSON string or an object's ``output``."""
    body = F.trim(text.strip_exec_header(output))
    parsed = F.try_parse_json(body)
    said = F.trim(F.coalesce(json.strict_string(parsed, "$"), json.strict_string(parsed, "$.output"), body))
    return F.when(_begins(said, _APPLIED) | (said == "Done!"), "applied").when(_begins(said, _REFUSED), "refused").otherwise("unknown")


def codex_rows(lines: DataFrame) -> DataFrame:
    return lines.filter("not malformed").withColumn("ts_ms", times.iso_ms(json.strict_string(F.col("v"), "$.timestamp"))).withColumn("pos", F.lit(0))


def codex_exchange(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(shell calls, those that met an output, custom calls that can be read, those that met one) of codex_rows()."""
    v = F.col("v")
    kind, inner = json.strict_string(v, "$.type"), json.strict_string(v, "$.payload.type")
    args = F.coalesce(json.strict_string(v, "$.payload.arguments"), json.strict_string(v, "$.payload.input"), F.when(json.is_object(v, "$.payload.arguments"), F.to_json(_get(v, "$.payload.arguments"))))
    items = rows.filter(kind == "response_item").select(*AT, _at(), "ts_ms", inner.alias("kind"), json.strict_string(v, "$.payload.call_id").alias("id"), json.strict_string(v, "$.payload.name").alias("name"), args.alias("args"), _output_text(v).alias("output"))

    a = F.try_parse_json("args")
    words = F.transform(json.items(a, "$.command"), lambda x: json.strict_string(x, "$"))
    shell = F.col("name") == "shell"
    script = F.when(shell, F.coalesce(F.try_element_at(words, F.lit(-1)), F.when(json.is_array(a, "$.command"), ""))).otherwise(json.strict_string(a, "$.cmd"))
    calls = items.filter("kind = 'function_call' AND name IN ('shell', 'exec_command') AND id IS NOT NULL").withColumn("script", script).withColumn("full", F.when(shell, F.array_join(words, " ")).otherwise(F.col("script")))
    outputs = items.filter("kind = 'function_call_output' AND id IS NOT NULL")
    met = pair_calls(calls, outputs, ["path", "id"], "at")
    custom = items.filter("kind = 'custom_tool_call' AND id IS NOT NULL").withColumn("patches", F.filter(text.patch_files(F.col("args")), lambda p: p["file"] != ""))
    custom = custom.filter((F.col("name") == "exec") & ~_blank(F.col("args")) | (F.col("name") == "apply_patch") & (F.size("patches") > 0))
    done = pair_calls(custom, items.filter("kind = 'custom_tool_call_output' AND id IS NOT NULL"), ["path", "id"], "at")
    return calls, met, custom, done


def codex_changes(v: Column) -> Column:
    """The files of a report that a patch was applied, in order of their names."""
    changes = F.array_sort(F.map_entries(json.entries(v, "$.payload.changes")), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))

    def change(e: Column) -> Column:
        old, new = text.diff_parts(json.strict_string(e["value"], "$.unified_diff"))
        return F.struct(json.strict_string(e["value"], "$.type").alias("action"), e["key"].alias("file"), old.alias("old"), new.alias("new"))

    return F.filter(F.transform(changes, change), lambda p: p["action"].isin("add", "update", "delete") & (p["file"] != ""))


def codex(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shell calls by what their script does, custom calls, and patches, each counted once by its first report."""
    v = F.col("v")
    rows = codex_rows(lines)
    kind, inner = json.strict_string(v, "$.type"), json.strict_string(v, "$.payload.type")
    meta = kind == "session_meta"
    sessions = _sessions(
        rows, "codex", session_id=F.when(meta, json.strict_string(v, "$.payload.id")), folder=F.when(kind.isin("session_meta", "turn_context"), json.strict_string(v, "$.payload.cwd")),
        remote=F.when(meta, json.strict_string(v, "$.payload.git.repository_url")), ts=F.col("ts_ms"),
    )
    _, met, _, done = codex_exchange(rows)
    ran = met.filter("call.script IS NOT NULL")
    ran = ran.select("path", "result.line_no", "result.pos", "call.ts_ms", "call.script", "call.full", text.strip_exec_header(F.col("result.output")).alias("output"))
    ran = ran.withColumn("does", text.shell_kind(F.col("script")))
    body = F.when(F.col("does") == "cat", F.substring_index("output", "\n---", 1)).otherwise(F.col("output"))
    made = [
        _patched(ran.filter("does = 'patch'"), text.patch_files(F.col("script")), F.col("ts_ms")),
        _draft(ran.filter("does IN ('sed', 'cat')"), "read", file=text.shell_read_path(F.col("script")), body=body),
        _draft(ran.filter("does = 'run'"), "run", command=F.when(F.col("full") == "", F.col("script")).otherwise(F.col("full"))),
    ]
    done = done.select("path", "id", "result.line_no", "result.pos", "call.ts_ms", "call.name", "call.args", "call.patches", "result.output")
    made.append(_draft(done.filter("name = 'exec'"), "run", command=F.col("args")))
    applied = done.filter((F.col("name") == "apply_patch") & (patch_result(F.col("output")) == "applied")).select(*AT, "id", "ts_ms", "patches")
    known = codex_changes(v)
    ended = rows.filter((kind == "event_msg") & (inner == "patch_apply_end") & F.try_variant_get(v, "$.payload.success", "boolean") & json.is_object(v, "$.payload.changes"))
    ended = ended.select(*AT, json.strict_string(v, "$.payload.call_id").alias("id"), "ts_ms", known.alias("patches")).filter(F.size("patches") > 0)
    either = applied.unionByName(ended)
    once = windows.first_per_key(either.filter("id IS NOT NULL"), ["path", "id"], ["line_no", "pos"]).unionByName(either.filter("id IS NULL"))
    made.append(_patched(once, F.col("patches"), F.col("ts_ms")))
    return finish(reduce(DataFrame.unionByName, made), sessions, "codex"), sessions


# --- Copilot ---------------------------------------------------------------------------------

#: What the tools do, by name. Fixed values.
_COPILOT_TOOLS = {
    "read": ["view", "show_file", "read_file"],
    "search": ["rg", "grep", "glob", "web_search", "web_fetch"],
    "write": ["create", "write_file", "write"],
    "edit": ["str_replace", "edit", "replace", "edit_file"],
    "patch": ["apply_patch"],
    "shell": ["bash", "shell", "execute"],
    "input": ["write_bash"],
}


def _tool(name: Column, tools: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for op, names in tools.items() for n in names for x in (n, op)]
    return F.create_map(*pairs)[name]


def copilot_exchange(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records with their times, calls, completions, completions that met a call)."""
    v = F.col("v")
    rows = lines.filter("not malformed").withColumn("ts_ms", times.iso_ms(json.strict_string(v, "$.timestamp"))).withColumn("pos", F.lit(0))
    kind = json.strict_string(v, "$.type")
    key = nonempty(json.strict_string(v, "$.data.toolCallId")).alias("id")
    name = json.strict_string(v, "$.data.toolName")
    calls = rows.filter(kind == "tool.execution_start").select(*AT, _at(), "ts_ms", key, _tool(name, _COPILOT_TOOLS).alias("tool"), _get(v, "$.data.arguments").alias("a")).filter("id IS NOT NULL")
    ends = rows.filter(kind == "tool.execution_complete").select(*AT, _at(), key, F.try_variant_get(v, "$.data.success", "boolean").alias("ok"), json.strict_string(v, "$.data.result.content").alias("said")).filter("id IS NOT NULL")
    return rows, calls, ends, pair_calls(calls, ends, ["path", "id"], "at")


def copilot_patch(a: Column) -> Column:
    given = F.coalesce(json.strict_string(a, "$"), *[json.strict_string(a, f"$.{f}") for f in ("input", "patch", "patchText", "string")])
    return text.patch_files(given, moves=True)


def copilot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls whose completion reports success."""
    v = F.col("v")
    rows, _, _, met = copilot_exchange(lines)
    start = json.strict_string(v, "$.type") == "session.start"
    folder = F.coalesce(nonempty(json.strict_string(v, "$.data.context.cwd")), json.strict_string(v, "$.data.context.gitRoot"))
    remote = text.repo_url(json.strict_string(v, "$.data.context.repositoryHost"), json.strict_string(v, "$.data.context.repository"))
    sessions = _sessions(rows, "copilot", session_id=F.when(start, json.strict_string(v, "$.data.sessionId")), folder=F.when(start, folder), remote=F.when(start, remote), ts=F.col("ts_ms"))
    done = met.filter("result.ok AND call.tool IS NOT NULL").select("path", "result.line_no", "result.pos", "call.ts_ms", "call.tool", "call.a", "result.said")
    a = F.col("a")
    path = nonempty(json.first_string(a, ["path"]))
    done = done.withColumn("file", path)
    ends = [json.strict_int(a, f"$.view_range[{i}]") for i in (0, 1)]
    span = F.greatest(ends[1] - ends[0] + 1, F.lit(0))
    ranged = json.has(a, "$.view_range[1]")
    body = F.when(ranged, F.array_join(F.array_repeat(F.lit("-"), F.coalesce(span, F.lit(0)).cast("int")), "\n")).otherwise(F.col("said"))
    old, new = (json.first_string(a, [f"{w}_{x}" for x in ("string", "str", "text")]) for w in ("old", "new"))
    command = json.first_string(a, ["command", "cmd"])
    made = [
        _draft(done.filter("tool = 'read' AND file IS NOT NULL"), "read", file=F.col("file"), body=body, bare="count"),
        _draft(done.filter("tool = 'search'"), "read", bare="count"),
        _draft(done.withColumn("body", json.first_string(a, ["file_text", "content"])).filter("tool = 'write' AND file IS NOT NULL AND body IS NOT NULL"), "write", file=F.col("file"), body=F.col("body")),
        _draft(done.withColumns({"o": old, "n": new}).filter("tool = 'edit' AND file IS NOT NULL AND o IS NOT NULL AND n IS NOT NULL"), "edit", file=F.col("file"), old=F.col("o"), body=F.col("n")),
        _patched(done.filter("tool = 'patch'"), copilot_patch(a), F.col("ts_ms"), raw_updates=True),
        _draft(done.filter("tool = 'shell'"), "run", command=F.coalesce(command, F.lit("")), description=json.first_string(a, ["description"])),
        _draft(done.filter("tool = 'input'"), "run", command=F.coalesce(json.first_string(a, ["input"]), F.lit(""))),
    ]
    return finish(reduce(DataFrame.unionByName, made), sessions, "copilot"), sessions


# --- Gemini ----------------------------------------------------------------------------------

_GEMINI_TOOLS = {
    "read": ["read_file"],
    "write": ["write_file", "create_file"],
    "edit": ["edit_file", "replace_in_file", "replace"],
    "run": ["run_command", "run_shell_command", "execute_command", "shell"],
    "todo": ["write_todos"],
    "many": ["read_many_files"],
}


def tool_status(call: Column) -> Column:
    """'success', 'failed', 'pending' or 'unsupported', of a Gemini tool call."""
    status, result = json.strict_string(call, "$.status"), F.coalesce(json.variant_type(call, "$.result"), F.lit("VOID"))
    unset = ~json.has(call, "$.status") & ((result == "VOID") | json.is_array(call, "$.result") & (F.size(json.items(call, "$.result")) == 0))
    return F.when(status == "success", "success").when(status.isin("error", "failed"), "failed").when(status.isin("pending", "running") | F.coalesce(unset, F.lit(False)), "pending").otherwise("unsupported")


def gemini_calls(last: DataFrame) -> DataFrame:
    """The calls of known tools in the last revisions of messages, with their ``status`` and whether they are ``whole``."""
    m, c = F.col("m"), F.col("c")
    place = {"line_no": F.col("first_seen.line_no"), "message_pos": F.col("first_seen.pos")}
    calls = last.withColumns(place).drop("pos").select("path", "line_no", "message_pos", "ts_ms", F.posexplode(json.items(m, "$.toolCalls")).alias("pos", "c"))
    calls = calls.withColumn("pos", F.col("message_pos") * 1024 + F.col("pos")).withColumns({"tool": _tool(json.strict_string(c, "$.name"), _GEMINI_TOOLS), "status": tool_status(c)})
    calls = calls.filter("tool IS NOT NULL")
    a = _get(c, "$.args")
    read = {"file": nonempty(json.first_string(a, ["file_path"])), "content": json.first_string(a, ["content"]), "command": json.first_string(a, ["command", "cmd"]), "description": json.first_string(a, ["description"])}
    read |= {"old": json.first_string(a, ["old_string", "old_text"]), "new": json.first_string(a, ["new_string", "new_text"]), "said": json.strict_string(c, "$.result[0].functionResponse.response.output")}
    calls = calls.withColumns(read)
    named = F.col("file").isNotNull()
    fits = F.when(F.col("tool") == "read", named & F.col("said").isNotNull()).when(F.col("tool") == "write", named & F.col("content").isNotNull())
    fits = fits.when(F.col("tool") == "edit", named & F.col("old").isNotNull() & F.col("new").isNotNull()).when(F.col("tool") == "run", ~_blank(F.col("command"))).otherwise(True)
    return calls.withColumn("whole", fits & (F.col("status") == "success"))


def gemini(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tool calls of each message's last revision; one that failed or does not fit is a call and no more."""
    v, m = F.col("v"), F.col("m")
    good = lines.filter("not malformed")
    revisions = usage_logs.gemini_revisions(good).withColumn("ts_ms", times.iso_ms(json.strict_string(m, "$.timestamp")))
    last = windows.last_revision(revisions, ["path"], "id", ["line_no", "pos"], [])
    heads = good.select("path", "session_date", "line_no", json.strict_string(v, "$.sessionId").alias("sid"), F.lit(0).cast("long").alias("ts_ms"))
    dated = heads.unionByName(last.select("path", "session_date", "line_no", F.lit(None).cast("string").alias("sid"), "ts_ms"))
    sessions = _sessions(dated, "gemini", session_id=F.col("sid"), folder=F.lit(None).cast("string"), ts=F.col("ts_ms"))
    calls = gemini_calls(last).filter("status <> 'unsupported'")
    op = F.when(F.col("tool") == "many", "read").otherwise(F.col("tool"))
    done = calls.filter("whole")
    made = [
        _draft(calls.filter("NOT whole OR tool IN ('many', 'todo')"), op, bare="count"),
        _draft(done.filter("tool = 'read'"), "read", file=F.col("file"), body=F.col("said"), bare="count"),
        _draft(done.filter("tool = 'write'"), "write", file=F.col("file"), body=F.col("content")),
        _draft(done.filter("tool = 'edit'"), "edit", file=F.col("file"), old=F.col("old"), body=F.col("new"), raw=True),
        _draft(done.filter("tool = 'run'"), "run", command=F.col("command"), description=F.col("description")),
    ]
    return finish(reduce(DataFrame.unionByName, made), sessions, "gemini"), sessions


# --- Grok ------------------------------------------------------------------------------------

#: Tools whose calls are counted, and others that are known. Fixed values.
_GROK_TOOLS = ["read_file", "grep", "write", "search_replace", "run_terminal_command", "todo_write"]
_GROK_OTHER = ["spawn_subagent", "get_command_or_subagent_output"]


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def grok_exchange(sources: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends of calls, those that met their call) of the sessions ``sources`` (path, folder)."""
    v = F.col("v")
    u = _get(v, "$.params.update")
    said = updates.filter("not malformed").select(_folder(F.col("path")).alias("folder"), "line_no", F.lit(0).alias("pos"), F.coalesce(json.strict_int(v, "$.timestamp"), F.lit(0)).alias("sec"), u.alias("u")).join(sources.select("folder", "path"), "folder")
    u = F.col("u")
    kind, key = json.strict_string(u, "$.sessionUpdate"), json.strict_string(u, "$.toolCallId").alias("id")
    name = F.coalesce(json.strict_string(u, "$._meta['x.ai/tool'].name"), json.strict_string(u, "$.title"))
    calls = said.filter(kind == "tool_call").select(*AT, _at(), key, name.alias("name"), _get(u, "$.rawInput").alias("a")).filter("id IS NOT NULL")
    status = json.strict_string(u, "$.status")
    ends = said.filter((kind == "tool_call_update") & status.isin("completed", "failed")).select(*AT, _at(), key, (F.col("sec") * 1000).alias("ts_ms"), status.alias("status"), _get(u, "$.rawOutput").alias("o")).filter("id IS NOT NULL")
    return ends, pair_calls(calls, ends, ["path", "id"], "at")


def grok(signals: DataFrame, summaries: DataFrame, updates: DataFrame, cwd_markers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Completed tool calls of ``updates``; ``path`` is that of the session's signals. ``cwd_markers``: read_files of the files .cwd."""
    s = F.col("s")
    sources = signals.filter("not malformed").filter(usage_logs.is_grok_signals(F.col("v"))).select("path", "session_date", _folder(F.col("path")).alias("folder"))
    beside = summaries.select(_folder(F.col("path")).alias("folder"), F.col("v").alias("s"))
    rows = sources.join(beside, "folder", "left").withColumn("workspace", _folder(F.col("folder")))
    if cwd_markers is not None:
        rows = rows.join(cwd_markers.select(_folder(F.col("path")).alias("workspace"), F.trim("value").alias("marker")), "workspace", "left")
    else:
        rows = rows.withColumn("marker", F.lit(None).cast("string"))
    encoded = F.substring_index("workspace", "/", -1)
    plain = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))  # Spark's paths are URIs, which encode the folder's name once more
    decoded = F.trim(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))))
    decoded = F.when((decoded != plain) & decoded.startswith("/"), decoded)
    stamp = F.greatest(*[times.iso_ms(json.strict_string(s, f"$.{f}")) for f in ("updated_at", "last_active_at")])
    rows = rows.withColumns(
        {
            "sid": F.coalesce(nonempty(json.strict_string(s, "$.info.id")), F.substring_index("folder", "/", -1)),
            "cwd": F.coalesce(nonempty(json.strict_string(s, "$.info.cwd")), nonempty(F.col("marker")), decoded),
            "remote": json.strict_string(s, "$.git_remotes[0]"),
            "stamp": F.coalesce(stamp, F.lit(0)),
        }
    )
    ends, met = grok_exchange(sources, updates)
    done = met.filter("result.status = 'completed'").filter(F.col("call.name").isin(_GROK_TOOLS))
    done = done.select("path", "result.line_no", "result.pos", "result.ts_ms", "call.name", "call.a", "result.o")
    a, o = F.col("a"), F.col("o")
    changed = nonempty(F.coalesce(json.strict_string(o, "$.EditsApplied.absolute_path"), json.strict_string(a, "$.file_path")))
    done = done.withColumns({"file": changed, "old": json.strict_string(a, "$.old_string"), "new": json.strict_string(a, "$.new_string")})
    details = json.items(o, "$.EditsApplied.edits.details")
    whole = (F.size(details) > 0) & F.forall(details, lambda d: json.strict_string(d, "$.old_string").isNotNull() & json.strict_string(d, "$.new_string").isNotNull())
    edits = done.filter("name = 'search_replace' AND file IS NOT NULL").withColumn("hunks", F.when(whole, details))
    hunks = edits.filter("hunks IS NOT NULL").select("path", "line_no", "ts_ms", "file", F.posexplode("hunks").alias("pos", "h"))
    h = F.col("h")
    seen = nonempty(F.coalesce(json.strict_string(o, "$.FileContent.absolute_path"), json.strict_string(a, "$.target_file")))
    made = [
        _draft(done.withColumn("file", seen).filter("name = 'read_file' AND file IS NOT NULL"), "read", file=F.col("file"), body=json.strict_string(o, "$.FileContent.content"), bare="path"),
        _draft(done.filter((F.col("name") == "grep") & json.strict_int(o, "$.exit_code").isin(0, 1)), "read", bare="count"),
        _draft(done.withColumn("body", json.strict_string(a, "$.content")).filter("name = 'write' AND file IS NOT NULL AND body IS NOT NULL"), "write", file=F.col("file"), body=F.col("body")),
        _draft(hunks, "edit", file=F.col("file"), old=json.strict_string(h, "$.old_string"), body=json.strict_string(h, "$.new_string"), raw=True, counts=F.col("pos") == 0),
        _draft(edits.filter("hunks IS NULL AND old IS NOT NULL AND new IS NOT NULL"), "edit", file=F.col("file"), old=F.col("old"), body=F.col("new"), raw=True),
        _draft(done.filter("name = 'run_terminal_command'"), "run", command=F.coalesce(json.strict_string(a, "$.command"), F.lit("")), description=json.strict_string(a, "$.description")),
        _draft(done.filter("name = 'todo_write'"), "todo"),
    ]
    latest = ends.join(sources.select("path"), "path").groupBy("path").agg(F.max("ts_ms").alias("worked"))
    dated = rows.join(latest, "path", "left").withColumn("stamp", F.greatest("stamp", F.coalesce("worked", F.lit(0)))).withColumn("line_no", F.lit(0))
    sessions = _sessions(dated, "grok", session_id=F.col("sid"), folder=F.col("cwd"), remote=F.col("remote"), ts=F.col("stamp"))
    return finish(reduce(DataFrame.unionByName, made), sessions, "grok"), sessions


# --- DeepSeek --------------------------------------------------------------------------------

_DEEPSEEK_TOOLS = {"read": ["read", "read_image"], "write": ["write"], "edit": ["edit", "str_replace_editor"], "run": ["bash", "pwsh"], "todo": ["todo_write"]}


def deepseek_exchange(rows: DataFrame) -> DataFrame:
    """Results with the call that each takes: (path, line_no, pos, ts_ms, bad, meta, tool, args)."""
    v = F.col("v")
    kind = json.strict_string(v, "$.type")
    calls = rows.filter(kind == "tool/call").select(
        "path", "line_no", json.strict_int(v, "$.seq").alias("seq"), _tool(json.strict_string(v, "$.data.name"), _DEEPSEEK_TOOLS).alias("tool"), json.strict_string(v, "$.data.arguments").alias("args"), json.strict_string(v, "$.data.name").alias("name")
    )
    calls = calls.filter("seq IS NOT NULL AND name IS NOT NULL AND args IS NOT NULL")
    bad = F.coalesce(json.variant_type(v, "$.data.error"), F.lit("VOID")) != "VOID"
    named = F.filter(F.transform(json.items(v, "$.sourceEventSeqs"), lambda s: json.strict_int(s, "$")), lambda s: s.isNotNull())
    results = rows.filter(kind == "tool/result").select(*AT, "ts_ms", bad.alias("bad"), _get(v, "$.data.meta").alias("meta"), named.alias("named"))
    met = take_calls(calls, results, ["path"], ["line_no"], "seq", "named").select("path", "line_no", F.col("call.line_no").alias("call_line"))
    own = calls.select("path", F.col("line_no").alias("call_line"), "tool", "args")
    return results.drop("named").join(met, ["path", "line_no"]).join(own, ["path", "call_line"])


def deepseek(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls whose result reports no error. A result names several earlier events; the first that is a pending call is its own."""
    v = F.col("v")
    rows = usage_logs.readable_deepseek(lines.filter("not malformed")).withColumn("pos", F.lit(0))
    kind = json.strict_string(v, "$.type")
    head = kind == "session"
    time = json.strict_int(v, "$.time")
    stamp = F.greatest(F.coalesce(time, F.lit(0)), F.coalesce(F.when(head, json.strict_int(v, "$.createdAt")), F.lit(0)))
    sessions = _sessions(rows, "deepseek", session_id=F.when(head, json.strict_string(v, "$.id")), folder=F.when(head, json.strict_string(v, "$.cwd")), ts=stamp)
    rows = windows.running_max(usage_logs.in_parts(rows).withColumn("stamp", stamp), "stamp", ["path"], ["line_no"], "ts_ms", usage_logs.PART)
    rows = rows.withColumn("ts_ms", F.coalesce(time, F.col("ts_ms")))
    done = deepseek_exchange(rows).filter("NOT bad AND tool IS NOT NULL")
    done = done.withColumn("a", F.try_parse_json("args"))
    a, meta = F.col("a"), F.col("meta")
    done = done.withColumn("file", json.strict_string(a, "$.file_path"))
    shown = F.filter(F.transform(json.items(meta, "$.lines"), lambda x: json.strict_string(x, "$.text")), lambda x: x.isNotNull())
    made = [
        _draft(done.withColumn("file", nonempty(F.coalesce(json.strict_string(meta, "$.path"), F.col("file")))).filter("tool = 'read' AND file IS NOT NULL"), "read", file=F.col("file"), body=F.array_join(shown, "\n"), bare=F.when(F.array_join(shown, "\n") == "", "path").otherwise("nothing")),
        _draft(done.filter("tool = 'write' AND file IS NOT NULL"), "write", file=F.col("file"), body=json.strict_string(a, "$.content")),
        _draft(done.filter("tool = 'edit' AND file IS NOT NULL"), "edit", file=F.col("file"), old=json.strict_string(a, "$.old_string"), body=json.strict_string(a, "$.new_string")),
        _draft(done.filter("tool = 'run'"), "run", command=F.coalesce(json.strict_string(a, "$.command"), F.lit("")), description=json.strict_string(a, "$.description")),
        _draft(done.filter("tool = 'todo'"), "todo"),
    ]
    return finish(reduce(DataFrame.unionByName, made), sessions, "deepseek"), sessions


# --- stores ----------------------------------------------------------------------------------


def _of_messages(rows: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, models) of rows (source, path, session_id, session_date, ts, folder, model), each a source of its own."""
    given = {
        "provider": F.lit(provider), "path": F.col("source"), "session_id": F.col("session_id"), "session_date": F.col("session_date"), "last_ts": F.col("ts"),
        "folder_path": F.coalesce("folder", F.lit("")), "git_remote_url": F.lit(""),
    }
    sessions = rows.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SESSIONS)])
    return sessions, rows.select(F.lit(provider).alias("provider"), F.col("source").alias("path"), "model")


def opencode(spark: SparkSession, paths: list[str], since_ms: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, sessions, models). A source is a message, or a session of a store without messages; tool parts are matched to it in columns."""
    key = lambda c: F.concat_ws("#", "path", c).alias("source")
    columns = ["path", "id", "session_id", "session_date", "ts", "folder", "model"]
    modern = sqlite.opencode_messages(spark, paths, since_ms).select(*columns)
    legacy = sqlite.opencode_sessions(spark, paths, since_ms).withColumn("session_id", F.col("id")).select(*columns)
    sources = modern.unionByName(legacy).withColumn("source", key("id"))
    sessions, models = _of_messages(sources, "opencode")
    tool = "CASE WHEN json_valid(data) THEN json_extract(data, '$.type') = 'tool' ELSE 0 END"
    parts = scan_sqlite(spark, paths, f"SELECT id, message_id, data FROM part WHERE {tool}", "part string, owner string, data string", "message")
    old = scan_sqlite(spark, paths, f"SELECT id, session_id, data FROM part WHERE {tool}", "part string, owner string, data string", "part", without="message")
    v = F.col("v")
    parts = parts.unionByName(old).select(key("owner"), "part", F.try_parse_json("data").alias("v")).filter(json.strict_string(v, "$.state.status") == "completed")
    place = F.row_number().over(Window.partitionBy("source").orderBy("part")) - 1
    owned = parts.join(sources.select("source", "ts"), "source").withColumns({"line_no": place.cast("long"), "pos": F.lit(0), "path": F.col("source")})
    given = {f: json.strict_string(v, f"$.state.input.{f}") for f in ("filePath", "oldString", "newString", "content", "command", "description", "patchText")}
    started = F.coalesce(json.strict_int(v, "$.state.time.start"), F.col("ts")).alias("ts_ms")
    calls = owned.select(*AT, started, json.strict_string(v, "$.tool").alias("tool"), *[x.alias(f) for f, x in given.items()], json.strict_string(v, "$.state.output").alias("output"))
    calls = calls.withColumn("file", nonempty(F.col("filePath"))).withColumn("body", text.read_body(F.col("output")))
    reads = calls.filter("tool = 'read' AND file IS NOT NULL AND output IS NOT NULL")
    patches = F.transform(text.patch_files(F.col("patchText"), moves=True), lambda p: p)
    made = [
        _draft(reads.filter("body <> ''"), "read", file=F.col("file"), body=F.col("body")),
        _draft(reads.filter("body = ''"), "read", bare="count"),
        _draft(calls.filter("tool = 'edit' AND file IS NOT NULL AND oldString IS NOT NULL AND newString IS NOT NULL"), "edit", file=F.col("file"), old=F.col("oldString"), body=F.col("newString")),
        _draft(calls.filter("tool = 'write' AND file IS NOT NULL AND content IS NOT NULL"), "write", file=F.col("file"), body=F.col("content")),
        _draft(calls.filter("tool = 'bash'"), "run", command=F.coalesce("command", F.lit("")), description=F.col("description")),
        _draft(calls.filter("tool = 'todowrite'"), "todo"),
        _patched(calls.filter("tool = 'apply_patch' AND patchText IS NOT NULL"), patches, F.col("ts_ms"), raw_updates=True),
    ]
    return finish(reduce(DataFrame.unionByName, made), sessions, "opencode"), sessions, models


def cursor(spark: SparkSession, roots: list[str], tracking: list[str] = (), stores: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations, sessions, models). A source is a store on a date."""
    stores = cursor_store.find_stores(roots) if stores is None else stores
    v, c = F.col("v"), F.col("c")
    turns = cursor_store.nodes(spark, stores).filter((json.strict_string(v, "$.role") == "assistant") & json.is_array(v, "$.content"))
    turns = turns.withColumn("session_date", times.ms_to_date(F.col("ts"))).filter("session_date IS NOT NULL").withColumn("source", F.concat_ws("#", "path", "session_date"))
    days = turns.groupBy("path", "source", "session_date").agg(F.max("ts").alias("ts"))
    days = days.join(cursor_store.store_models(spark, stores, list(tracking)), "path").withColumns({"session_id": cursor_store.conversation(F.col("path")), "folder": F.lit("")})
    sessions, models = _of_messages(days, "cursor")
    place = F.row_number().over(Window.partitionBy("source").orderBy("id")) - 1
    turns = turns.withColumn("line_no", place.cast("long"))
    calls = turns.select("source", F.col("path").alias("store"), "line_no", F.col("ts").alias("ts_ms"), F.posexplode(json.items(v, "$.content")).alias("pos", "c")).filter(json.strict_string(c, "$.type") == "tool-call")
    given = {f: json.strict_string(c, f"$.args.{f}").alias(f) for f in ("contents", "old_string", "new_string", "command", "description")}
    calls = calls.select(
        F.col("source").alias("path"), "store", "line_no", "pos", "ts_ms", json.strict_string(c, "$.toolName").alias("tool"), nonempty(json.strict_string(c, "$.args.path")).alias("file"),
        nonempty(json.strict_string(c, "$.toolCallId")).alias("call_id"), *given.values(),
    )
    results = cursor_store.read_results(spark, stores).select(F.col("path").alias("store"), "call_id", text.numbered_lines(F.col("body")).alias("body"))
    reads = calls.filter("tool IN ('Read', 'ReadFile') AND file IS NOT NULL AND call_id IS NOT NULL").join(results, ["store", "call_id"], "left")
    made = [
        _draft(calls.filter("tool = 'Write' AND file IS NOT NULL AND contents IS NOT NULL"), "write", file=F.col("file"), body=F.col("contents")),
        _draft(calls.filter("tool = 'StrReplace' AND file IS NOT NULL AND old_string IS NOT NULL AND new_string IS NOT NULL"), "edit", file=F.col("file"), old=F.col("old_string"), body=F.col("new_string")),
        _draft(reads.filter("body <> ''"), "read", file=F.col("file"), body=F.col("body")),
        _draft(reads.filter("coalesce(body, '') = ''"), "read", bare="count"),
        _draft(calls.filter("tool = 'Shell'"), "run", command=F.coalesce("command", F.lit("")), description=F.col("description")),
        _draft(calls.filter("tool = 'TodoWrite'"), "todo"),
    ]
    return finish(reduce(DataFrame.unionByName, made), sessions, "cursor"), sessions, models


READERS = {"claude": claude, "codex": codex, "copilot": copilot, "gemini": gemini, "deepseek": deepseek, "grok": grok}


def provider_tables(spark: SparkSession, provider: str, paths: str | list[str], only: list[str] | None = None) -> tuple[DataFrame, ...]:
    """What a provider's reader of operations takes (see usage_logs.provider_lines)."""
    given = usage_logs.provider_lines(spark, provider, paths, only)
    if provider == "grok":
        kept = logs.existing(spark, [paths] if isinstance(paths, str) else paths)
        updates = kept if only is None else usage_logs.beside(spark, only, "updates.jsonl")
        given = (*given, logs.read_lines(spark, updates, "updates.jsonl", r"/sessions/[^/]+/[^/]+/updates\.jsonl$", lenient=True), logs.read_files(spark, kept, ".cwd", lenient=True))
    return given


def read_operations(spark: SparkSession, roots: dict[str, str | list[str]]) -> tuple[DataFrame, DataFrame]:
    """(OPERATIONS, SESSIONS) of all file providers in ``roots`` (provider -> folder or folders)."""
    found = [READERS[provider](*provider_tables(spark, provider, paths)) for provider, paths in roots.items()]
    return tuple(reduce(DataFrame.unionByName, part) for part in zip(*found))
