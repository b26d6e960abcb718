import json

import pytest

from tests.test_sources import put
from tokentide.operators import diagnostics
from tokentide.schemas import NAMES
from tokentide.sources import accounting, operations, usage_logs

NAME = {"claude": "p/s.jsonl", "codex": "s.jsonl", "copilot": "session-state/s/events.jsonl", "gemini": "t/chats/s.jsonl", "deepseek": "sessions/p/s/session.jsonl"}

ROOT = {"copilot": "session-state", "deepseek": "sessions"}


def counted(spark, tmp_path, provider, records):
    """(records, malformed, recognized, relevant, normalized, verdict) of one log."""
    put(tmp_path, NAME[provider], records)
    lines = usage_logs.provider_lines(spark, provider, str(tmp_path / ROOT.get(provider, ".")))
    row = diagnostics.verdict(accounting.provider_counters(provider, lines)).first()
    return (row.records, row.malformed, row.recognized, row.relevant, row.normalized, row.verdict)


def use(name, key="k", **given):
    return {"type": "tool_use", "name": name, "id": key, "input": given}


def test_claude(spark, tmp_path):
    usage = {"input_tokens": 1, "iterations": [{"type": "advisor_message", "input_tokens": 2}, {"type": "advisor_message", "input_tokens": "x"}, {"type": "message"}]}
    calls = [use("Read", "a", file_path="f"), use("Write", "b", file_path="f"), use("Edit", "c", file_path="f"), use("Edit", "", file_path="f"), use("Bash", "d", command=" "), use("TodoWrite", "e"), use("Grep", "g")]
    records = [
        {"type": "assistant", "message": {"model": "m", "usage": usage}},  # 1 + 1 fine, 1 not
        {"type": "assistant", "message": {"usage": {"input_tokens": 1}}},  # no model
        {"type": "assistant"},  # no message
        {"type": "assistant", "message": {"content": calls}},  # Read and TodoWrite fine; Edit without an id and Bash not; two wait
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "b", "is_error": True}]}},  # refused: fine
        {"type": "user", "toolUseResult": {"type": "text", "file": {"filePath": "f", "content": "x"}}, "message": {"content": [{"type": "tool_result", "tool_use_id": "a"}]}},  # fine
        {"type": "user", "toolUseResult": {"type": "text", "file": {"filePath": "f"}}},  # no body
        {"type": "custom"},
        "{broken",
    ]  # the other call waits for good: not
    assert counted(spark, tmp_path, "claude", records) == (9, 1, 7, 13, 6, "partial")


def test_codex(spark, tmp_path):
    def item(kind, key=None, **more):
        return {"type": "response_item", "payload": {"type": kind, "call_id": key} | more}

    patch = "*** Begin Patch\n*** Add File: a\n+x\n*** End Patch"
    records = [
        {"type": "session_meta", "payload": {"id": "s"}}, {"type": "world_state"}, {"type": "compacted"}, {"type": "inter_agent_communication_metadata"}, {"type": "odd"},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 1}}}},  # fine
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": "1"}}}},  # not
        {"type": "event_msg", "payload": {"type": "token_count", "info": None}},
        {"type": "event_msg", "payload": {"type": 5}},  # not
        {"type": "event_msg", "payload": {"type": "patch_apply_end", "success": True, "changes": {}}},  # not
        item("function_call", "1", name="shell", arguments='{"command": ["ls"]}'), item("function_call_output", "1", output="x"),  # fine twice
        item("function_call", "2", name="exec_command", arguments="{}"), item("function_call_output", "2", output="Error: missing field `cmd`"),  # refused: fine
        item("function_call", "3", name="exec_command", arguments="{}"), item("function_call_output", "3", output="ran"),  # not
        item("function_call", "4", name="exec_command", arguments="{}"),  # not
        item("function_call", None, name="shell", arguments='{"command": ["ls"]}'),  # not
        item("custom_tool_call", "5", name="apply_patch", input=patch), item("custom_tool_call_output", "5", output="apply_patch verification failed: x"),  # fine twice
        item("custom_tool_call", "6", name="apply_patch", input=patch), item("custom_tool_call_output", "6", output="hm"),  # fine, not
        item("custom_tool_call", "7", name="exec", input=" "),  # not
    ]
    assert counted(spark, tmp_path, "codex", records) == (23, 0, 22, 15, 7, "partial")


def test_copilot(spark, tmp_path):
    def start(key, tool, **given):
        return {"type": "tool.execution_start", "data": {"toolCallId": key, "toolName": tool, "arguments": given}}

    def end(key, ok, content=None):
        return {"type": "tool.execution_complete", "data": {"toolCallId": key, "success": ok, "result": {"content": content}}}

    records = [
        {"type": "assistant.message", "data": {"outputTokens": 5}},  # no model yet
        {"type": "session.model_change", "data": {"newModel": "m"}}, {"type": "assistant.message", "data": {"outputTokens": 5}}, {"type": "assistant.message", "data": {"outputTokens": "5"}},  # fine, not
        {"type": "session.shutdown", "data": {"modelMetrics": {"m": {"usage": {"inputTokens": 1}}, "n": {}}}}, {"type": "session.shutdown", "data": {"modelMetrics": {"m": {"usage": {"inputTokens": "1"}}}}},  # fine, not
        start("a", "view", path="f"), end("a", True, "x"), start("b", "view", path="f"), end("b", True),  # fine, not
        start("c", "create", path="f"), end("c", False), start("d", "create", path="f"), end("d", None), start("e", "other"), end("e", True),  # fine, not, nothing
        end("orphan", True), end("orphan", False), end("", True), start("f", ""), end("f", True),  # not, nothing, not, not, nothing
    ]
    assert counted(spark, tmp_path, "copilot", records) == (21, 0, 21, 12, 4, "partial")


def test_gemini(spark, tmp_path):
    def message(key, **more):
        return {"id": key, "type": "gemini"} | more

    calls = [{"name": "read_file", "status": "success", "args": {"file_path": "f"}}, {"name": "write_file", "status": "error"}, {"name": "write_todos", "status": "success"}, {"name": "shell", "status": "running"}, {"name": "other", "status": "odd"}]
    records = [
        {"sessionId": "s", "projectHash": "h"}, {"$rewindTo": "x"}, {"id": "u", "type": "user"}, {"id": "z", "type": "strange"},
        message("a", model="m", tokens={"input": 1}), message("a", model="m", toolCalls=calls),  # tokens fine; two calls fine, two not
        message("b", tokens={"input": 1}), message("", model="m"),  # not, not
        {"$set": {"messages": 5}}, {"$set": {"messages": [message("c", model="m", tokens={"input": 3}), {"type": "gemini"}]}},  # not; fine, not
    ]
    assert counted(spark, tmp_path, "gemini", records) == (10, 0, 9, 10, 4, "partial")


def test_deepseek(spark, tmp_path):
    def call(seq, name, **given):
        return {"type": "tool/call", "seq": seq, "data": {"name": name, "arguments": json.dumps(given)}}

    def result(seq, of, **data):
        return {"type": "tool/result", "seq": seq, "sourceEventSeqs": [of], "data": data}

    def chunk(turn, usage):
        return {"type": "assistant/chunk", "data": {"turn": turn, "step": 1, "chunk": {"type": "usage", "usage": usage}}}

    records = [
        {"type": "session", "version": 0, "id": "s"}, chunk(1, {"inputTokens": 1}), {"type": "request/context", "data": {"model": "m"}}, chunk(2, {"inputTokens": 1}), chunk(2, {"inputTokens": 2}), chunk(3, 5),  # not, fine, not
        call(10, "write", file_path="f"), result(11, 10), call(12, "write"), result(13, 12), call(14, "bash"), result(15, 14, error="x"), call(16, "plugin"), result(17, 16),  # fine, not, nothing, nothing
    ]
    assert counted(spark, tmp_path, "deepseek", records) == (14, 0, 14, 5, 2, "partial")


def test_grok(spark, tmp_path):
    def update(kind, key, **more):
        return {"timestamp": 5, "params": {"update": {"sessionUpdate": kind, "toolCallId": key} | more}}

    signals = {"primaryModelId": "m", "contextTokensUsed": 5, "toolsUsed": []}
    put(tmp_path, "sessions/w/s/signals.json", [signals])
    put(tmp_path, "sessions/w/t/signals.json", [{"other": 1}])
    put(tmp_path, "sessions/w/s/summary.json", ["{broken"])
    updates = [update("tool_call", "a", title="read_file", rawInput={"target_file": "f"}), update("tool_call_update", "a", status="completed"), update("tool_call", "b", title="write", rawInput={}), update("tool_call_update", "b", status="completed")]
    updates += [update("tool_call", "c", title="spawn_subagent"), update("tool_call_update", "c", status="completed"), update("tool_call", "d", title="grep"), update("tool_call_update", "d", status="failed"), "{broken"]
    put(tmp_path, "sessions/w/s/updates.jsonl", updates)
    tables = operations.provider_tables(spark, "grok", str(tmp_path / "sessions"))
    rows = {r.path.split("/")[-2]: r for r in diagnostics.verdict(accounting.provider_counters("grok", tables)).collect()}
    got = {k: (r.records, r.malformed, r.recognized, r.relevant, r.normalized, r.verdict) for k, r in rows.items()}
    assert got == {"s": (7, 2, 5, 4, 3, "partial"), "t": (1, 0, 0, 0, 0, "failed")}


@pytest.mark.parametrize("provider", sorted(NAME))
def test_no_lines(spark, provider):
    empty = usage_logs.provider_lines(spark, provider, [])
    assert accounting.provider_counters(provider, empty).count() == 0
    assert provider in NAMES
