import json

from pyspark.sql import functions as F

from tests.test_sources import put
from tokentide.functions import text
from tokentide.operators.analysis import session_totals
from tokentide.sources import operations

COUNTS = ["read_lines", "read_chars", "write_lines", "write_chars", "edit_lines", "edit_chars", "read_calls", "write_calls", "edit_calls", "run_calls", "todo_calls", "unique_files"]


def totals(spark, provider, root):
    """(session, counts, operations) of the one session below ``root``."""
    ops, sessions = operations.read_operations(spark, {provider: str(root)})
    ops = ops.cache()
    session = sessions.first()
    row = session_totals(ops, ["path"]).first()
    return session, tuple(row[c] for c in COUNTS) if row else None, ops


def details(ops, *columns, op):
    return sorted(tuple(r) for r in ops.filter((F.col("op") == op) & F.col("file_path").isNotNull()).select(*columns).collect())


def test_deepseek_session(spark, tmp_path):
    began = 1_700_000_100_000
    log = [{"type": "session", "version": 0, "id": "garden-1", "createdAt": began, "cwd": "/srv/garden"}]

    def did(name, given, error=None, **meta):
        """A call and its result, a second apart."""
        seq = 2 * len(log)
        log.append({"type": "tool/call", "seq": seq, "time": began + 500 * seq, "data": {"name": name, "arguments": json.dumps(given)}})
        log.append({"type": "tool/result", "seq": seq + 1, "time": began + 500 * seq + 1000, "sourceEventSeqs": [seq], "data": {"meta": meta} | ({"error": error} if error else {})})
        return began + 500 * seq + 1000

    wrote = did("write", {"file_path": "log.md", "content": "sown\n"})
    did("todo_write", {"todos": []})
    did("bash", {"command": "make dry-run", "description": "Try it"})
    did("glob", {"pattern": "*.md"}, shape="paths")
    did("read", {"file_path": "none.md"}, error={"code": "gone"})
    did("read", {"file_path": "plan.md"}, path="/srv/garden/beds/plan.md", lines=[{"number": n, "text": x} for n, x in enumerate(["# Beds", "- kale", "- leeks", "- peas"])])
    last = did("edit", {"file_path": "beds/plan.md", "old_string": "- kale", "new_string": "- chard\n- kale\n- dill"})
    put(tmp_path, "sessions/p/s/session.jsonl", log)
    session, counts, ops = totals(spark, "deepseek", tmp_path / "sessions")
    assert (session.session_id, session.folder_path, session.last_ts) == ("garden-1", "/srv/garden", last)
    read, edit = "# Beds\n- kale\n- leeks\n- peas", "- chard\n- kale\n- dill"
    assert counts == (4, len(read), 1, len("sown"), 3, len(edit), 1, 1, 1, 1, 1, 2)
    assert details(ops, "file_path", "content", "ts_ms", op="write") == [("/srv/garden/log.md", "sown", wrote)]
    assert details(ops, "file_path", "char_count", "command", "description", op="run") == [("/srv/garden", 12, "make dry-run", "Try it")]
    put(tmp_path / "other", "sessions/p/s/session.jsonl", [log[0] | {"version": 1}, *log[1:]])
    assert operations.read_operations(spark, {"deepseek": str(tmp_path / "other/sessions")})[0].count() == 0


def test_grok_session(spark, tmp_path):
    log = []

    def did(name, output, status="completed", **given):
        """A call at an even second and its end at the next."""
        key, sec = f"call {len(log)}", 1_700_000_000 + len(log)
        log.append({"timestamp": sec, "params": {"update": {"sessionUpdate": "tool_call", "toolCallId": key, "rawInput": given, "_meta": {"x.ai/tool": {"name": name}}}}})
        log.append({"timestamp": sec + 1, "params": {"update": {"sessionUpdate": "tool_call_update", "toolCallId": key, "status": status, "rawOutput": output}}})
        return 1000 * (sec + 1)

    did("todo_write", {}, todos=[])
    did("grep", {"exit_code": 1})
    did("grep", {"exit_code": 3})
    did("spawn_subagent", {}, task="look around")
    did("write", {}, status="failed", file_path="never.yaml", content="x")
    did("write", {"EditsApplied": {"absolute_path": "/srv/kiln/ramp.yaml"}}, file_path="ramp.yaml", content="- 100\n- 300\n")
    edited = did("search_replace", {}, file_path="firing.md", old_string="cone 6\n", new_string="cone 10\nslow\n")
    did("read_file", {"FileContent": {"absolute_path": "/srv/kiln/kiln.yaml", "content": "temp: 900\nhold: 20\n"}}, target_file="kiln.yaml")
    did("run_terminal_command", {"exit_code": 0}, command="fire --dry", description="No heat")
    signals = {"primaryModelId": "k", "modelsUsed": ["k"], "contextTokensUsed": 77, "contextWindowTokens": 1000}
    summary = {"info": {"id": "kiln-1", "cwd": "/srv/kiln"}, "updated_at": "2023-11-15T00:00:00.5Z", "git_remotes": ["ssh://h/kiln"]}
    put(tmp_path, "sessions/w/s/signals.json", [json.dumps(signals, indent=1)])
    put(tmp_path, "sessions/w/s/summary.json", [json.dumps(summary, indent=1)])
    put(tmp_path, "sessions/w/s/updates.jsonl", log)
    session, counts, ops = totals(spark, "grok", tmp_path / "sessions")
    assert (session.session_id, session.folder_path, session.git_remote_url, session.last_ts) == ("kiln-1", "/srv/kiln", "ssh://h/kiln", 1_700_006_400_500)
    assert counts == (2, len("temp: 900\nhold: 20"), 2, len("- 100\n- 300"), 2, len("cone 10\nslow"), 2, 1, 1, 1, 1, 3)
    assert details(ops, "file_path", "old_string", "new_string", "ts_ms", op="edit") == [("/srv/kiln/firing.md", "cone 6", "cone 10\nslow", edited)]

    put(tmp_path / "two", "sessions/%2Fhome%2Fa%2Bb/s/signals.json", [json.dumps(signals)])
    bare = operations.read_operations(spark, {"grok": str(tmp_path / "two/sessions")})[1].first()
    assert (bare.session_id, bare.folder_path) == ("s", "/home/a+b")


def test_claude_counts_calls_and_takes_bodies_from_results(spark, tmp_path):
    def use(key, name, **args):
        return {"type": "tool_use", "id": key, "name": name, "input": args}

    def said(*blocks, at=1, **more):
        return {"type": "assistant", "cwd": "/w", "sessionId": "s", "timestamp": f"2024-01-01T00:00:{at:02}Z", "message": {"content": list(blocks)}} | more

    def told(key, result=None, error=False, side=False, content="", at=2):
        block = {"type": "tool_result", "tool_use_id": key, "is_error": error, "content": content}
        return {"type": "user", "timestamp": f"2024-01-01T00:00:{at:02}Z", "isSidechain": side, "message": {"content": [block]}} | ({} if result is None else {"toolUseResult": result})

    records = [
        said(use("1", "Read", file_path="a.py"), use("2", "Write", file_path="b.py", content="x"), use("3", "Edit", file_path="c.py", old_string="", new_string="new"), use("4", "Bash", command=" ls ", description="d")),
        told("1", {"type": "text", "file": {"filePath": "/w/a.py", "content": "one\ntwo\n"}}), told("2", {"type": "create", "filePath": "/w/b.py", "content": "x\ny"}),
        told("3", {"filePath": "c.py", "oldString": "", "newString": "new"}),
        said(use("5", "Read", file_path="img.png"), use("6", "Read"), use("7", "TodoWrite"), use("8", "Edit", file_path="d.py", old_string="a", new_string="b")),
        told("5", {"type": "image", "file": {}}), told("6", error=True, content="bad"), told("8", {"filePath": "d.py", "oldString": "a", "newString": "b"}, error=True),
        said(use("9", "Read", file_path="side.py"), at=5), told("9", side=True, content=[{"type": "text", "text": "l1"}, {"type": "text", "text": "l2"}], at=6),
        {"type": "user", "toolUseResult": {"type": "update", "filePath": "/w/e.py", "content": "uncorrelated"}}, {"type": "user", "toolUseResult": {"filePath": "/w/plan.md"}}, {"type": "user", "toolUseResult": "rejected"},
    ]
    put(tmp_path, "p/x.jsonl", records)
    put(tmp_path, "p/x.meta.jsonl", records)
    session, counts, ops = totals(spark, "claude", tmp_path)
    assert (session.session_id, session.folder_path, session.last_ts) == ("s", "/w", 1704067206000)
    assert details(ops, "file_path", "line_count", op="read") == [("/w/a.py", 2), ("/w/img.png", 0), ("/w/side.py", 2)]
    assert details(ops, "file_path", "content", op="write") == [("/w/b.py", "x\ny"), ("/w/c.py", "new"), ("/w/e.py", "uncorrelated")]
    assert details(ops, "file_path", "command", op="run") == [("/w", "ls")]
    assert counts == (4, 12, 4, 18, 0, 0, 3, 1, 2, 1, 1, 6)


def test_codex_shell_patches_and_their_reports(spark, tmp_path):
    def item(kind, key, **more):
        return {"timestamp": "2024-01-01T00:00:01Z", "type": "response_item", "payload": {"type": kind, "call_id": key} | more}

    def shell(key, command):
        return item("function_call", key, name="exec_command", arguments=json.dumps({"cmd": command}))

    def end(key, success=True, **changes):
        return {"timestamp": "2024-01-01T00:00:02Z", "type": "event_msg", "payload": {"type": "patch_apply_end", "call_id": key, "success": success, "changes": changes}}

    patch = "*** Begin Patch\n*** Add File: new.py\n+one\n+two\n*** Update File: old.py\r\n@@ -1 +1 @@\n-was\n+is\n same\n*** Delete File: gone.py\n*** End Patch\n*** Add File: no.py"
    head = "Chunk ID: 1\nWall time: 1 seconds\nProcess exited with code 0\nOutput:\n"
    records = [
        {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "s", "cwd": "/w", "git": {"repository_url": "u"}}},
        shell("1", "sed -n '1,2p' \"a.py\""), item("function_call_output", "1", output=head + "x\ny\n"),
        item("function_call", "2", name="shell", arguments=json.dumps({"command": ["bash", "-lc", "cat b.py"]})), item("function_call_output", "2", output=json.dumps({"output": "k: v\nOutput:\nrest\n---\ncut", "metadata": {}})),
        shell("3", "cargo test"), item("function_call_output", "3", output="ok"), item("function_call", "4", name="shell", arguments="{}"), item("function_call_output", "4", output="failed to parse"),
        item("custom_tool_call", "5", name="apply_patch", input=patch), item("custom_tool_call_output", "5", output=json.dumps({"output": "Success. Updated the following files:\nA new.py"})), end("5", **{"new.py": {"type": "add"}}),
        item("custom_tool_call", "6", name="apply_patch", input=patch), item("custom_tool_call_output", "6", output="Failed"), item("custom_tool_call", "7", name="exec", input="await x()"), item("custom_tool_call_output", "7", output=[{"type": "text", "text": "y"}]),
        end("8", **{"z.py": {"type": "update", "unified_diff": "@@\n-a\n+b\n+c\n"}, "y.py": {"type": "add"}}), end("8", **{"z.py": {"type": "add"}}), end("9", success=False, **{"q.py": {"type": "add"}}),
    ]
    put(tmp_path, "x.jsonl", records)
    session, counts, ops = totals(spark, "codex", tmp_path)
    assert (session.session_id, session.folder_path, session.git_remote_url) == ("s", "/w", "u")
    assert details(ops, "file_path", "line_count", op="read") == [("/w/a.py", 2), ("/w/b.py", 3)]
    assert details(ops, "file_path", "content", op="write") == [("/w/new.py", "one\ntwo"), ("/w/y.py", "")]
    assert details(ops, "file_path", "old_string", "new_string", op="edit") == [("/w/gone.py", "", ""), ("/w/old.py", "was", "is"), ("/w/z.py", "a", "b\nc")]
    assert details(ops, "command", op="run") == [("await x()",), ("cargo test",)]
    assert counts[6:] == (2, 2, 3, 2, 0, 7)


def test_copilot_dispatches_what_succeeded(spark, tmp_path):
    made = [{"type": "session.start", "timestamp": "2024-01-01T00:00:00Z", "data": {"sessionId": "s", "producer": "copilot-agent", "context": {"gitRoot": "/g", "repository": "o/r", "repositoryHost": "h"}}}]

    def call(key, tool, success=True, said=None, **args):
        made.append({"type": "tool.execution_start", "timestamp": "2024-01-01T00:00:01Z", "data": {"toolCallId": key, "toolName": tool, "arguments": args}})
        made.append({"type": "tool.execution_complete", "data": {"toolCallId": key, "success": success, "result": {"content": said}}})

    call("1", "view", said="a\nb\n", path="a")
    call("2", "view", said="ignored", path="b", view_range=[3, 6])
    call("3", "view", said=None, path="c")
    call("4", "grep", said="x")
    call("5", "create", path="d", file_text="t")
    call("6", "edit", path="e", old_str="", new_str="n")
    call("7", "apply_patch", input="*** Begin Patch\n*** Update File: f\n*** Move to: g\n-x\n+y\n*** End Patch")
    call("8", "bash", command="ls", description="d")
    call("9", "write_bash", input="yes")
    call("10", "create", success=False, path="no", file_text="t")
    call("11", "report_intent", path="no")
    made.append({"type": "tool.execution_complete", "data": {"toolCallId": "orphan", "success": True}})
    put(tmp_path, "session-state/a/events.jsonl", made)
    session, counts, ops = totals(spark, "copilot", tmp_path / "session-state")
    assert (session.session_id, session.folder_path, session.git_remote_url) == ("s", "/g", "https://h/o/r")
    assert details(ops, "file_path", "line_count", op="read") == [("/g/a", 2), ("/g/b", 4)]
    assert details(ops, "file_path", op="write") == [("/g/d",), ("/g/e",)]
    assert details(ops, "file_path", "old_string", "new_string", op="edit") == [("/g/g", "x", "y")]
    assert counts[6:] == (4, 2, 1, 2, 0, 5)


def test_gemini_takes_the_last_revision(spark, tmp_path):
    def message(key, *calls):
        return {"id": key, "type": "gemini", "timestamp": "2024-01-01T00:00:01Z", "toolCalls": list(calls)}

    def call(name, status="success", said=None, **args):
        return {"name": name, "args": args, "result": [{"functionResponse": {"response": {"output": said}}}]} | ({"status": status} if status else {})

    records = [
        {"sessionId": "s", "projectHash": "h"}, message("1", call("read_file", said="x", file_path="old.py")),
        {"$set": {"messages": [message("1", call("read_file", said="a\nb", file_path="/a.py"), call("replace", file_path="/b.py", old_string="", new_string="n"), call("write_file", "error", file_path="/c.py", content="x"))]}},
        {"$rewindTo": "1"}, message("2", call("shell", command="ls"), call("write_todos"), call("read_many_files"), call("unknown_tool"), call("write_file", "odd", file_path="/d.py", content="x")), message("", call("shell", command="no")),
    ]
    put(tmp_path, "t/chats/s.jsonl", records)
    put(tmp_path, "t/chats/s.json", records)
    session, counts, ops = totals(spark, "gemini", tmp_path)
    assert (session.session_id, session.folder_path) == ("s", "")
    assert details(ops, "file_path", "line_count", op="read") == [("/a.py", 2)]
    assert details(ops, "file_path", "new_string", op="edit") == [("/b.py", "n")]
    assert counts[6:] == (2, 1, 1, 1, 1, 2)


def test_exec_headers_are_a_closed_set(spark):
    rows = spark.createDataFrame([("Output:\nx",), ("Key: v\nOutput:\nx",), ("Wall time: 1\nOutput:\n",)], "b string")
    assert [r[0] for r in rows.select(text.strip_exec_header(F.col("b"))).collect()] == ["x", "Key: v\nOutput:\nx", ""]
