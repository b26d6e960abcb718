import json
import sqlite3

import zstandard
from pyspark.sql import functions as F

from tokentide.sources import logs, prices, sqlite, usage_logs


def put(folder, name, records):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return path


def buckets(rows):
    cols = ["model", "input", "output", "reasoning", "cache_read", "cc_5m", "cc_1h"]
    return sorted(tuple(r) for r in rows.select(*cols).collect())


def usage(spark, provider, root):
    return usage_logs.read_usage(spark, {provider: str(root)})


def test_claude_splits_cache_writes_and_takes_advisors(spark, tmp_path):
    said = {"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 10, "cache_creation": {"ephemeral_5m_input_tokens": 2, "ephemeral_1h_input_tokens": 8}}
    records = [
        {"type": "assistant", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "message": {"model": "a", "usage": said | {"iterations": [{"type": "advisor_message", "model": "b", "input_tokens": 4}]}}},
        {"type": "assistant", "message": {"model": "a", "usage": {"input_tokens": "5"}}},  # a wrong type spoils the whole object
        {"type": "user"},
        "{broken",
        "",
    ]
    put(tmp_path, "p/x.jsonl", records)
    rows = usage(spark, "claude", tmp_path)
    assert buckets(rows) == [("a", 5, 7, 0, 3, 2, 8), ("b", 4, 0, 0, 0, 0, 0)]
    assert {(r.model, r.is_advisor, r.request_context, r.ts_ms) for r in rows.collect()} == {("a", False, 18, 1704067200000), ("b", True, 4, 1704067200000)}
    assert [r.line_no for r in logs.read_lines(spark, str(tmp_path), "*.jsonl").orderBy("line_no").collect()] == [0, 1, 2, 3]
    counted = logs.lines(logs.read_files(spark, str(tmp_path), "*.jsonl")).agg(F.count("*"), F.count_if("malformed")).first()
    assert tuple(counted) == (4, 1)


def test_codex_takes_increments_and_restarts(spark, tmp_path):
    def count(**total):
        return {"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": total}}}

    put(tmp_path, "a.jsonl", [
        count(input_tokens=10, cached_input_tokens=0, output_tokens=1, reasoning_output_tokens=0, total_tokens=11),
        {"timestamp": "t", "type": "turn_context", "payload": {"model": "m"}},
        count(input_tokens=30, cached_input_tokens=5, output_tokens=9, reasoning_output_tokens=4, total_tokens=39),
        count(input_tokens=4, cached_input_tokens=1, output_tokens=2, reasoning_output_tokens=1, total_tokens=6),
    ])
    archived = tmp_path / "archived"
    put(archived, "a.jsonl", [{"timestamp": "t", "type": "turn_context", "payload": {"model": "again"}}, count(input_tokens=9, total_tokens=9)])
    put(tmp_path / "sessions", "a.jsonl", (tmp_path / "a.jsonl").read_text().splitlines())
    rows = usage_logs.read_usage(spark, {"codex": [str(tmp_path / "sessions"), str(archived), str(tmp_path / "not there")]})
    assert buckets(rows) == [("m", 3, 1, 1, 1, 0, 0), ("m", 15, 4, 4, 5, 0, 0)]
    assert sorted(r.published_total for r in rows.collect()) == [6, 28]


def test_copilot_prefers_the_last_shutdown(spark, tmp_path):
    def shutdown(n):
        return {"type": "session.shutdown", "data": {"modelMetrics": {"claude-x-4.5": {"usage": {"inputTokens": n, "outputTokens": 9, "reasoningTokens": 2, "cacheReadTokens": 1}}}}}

    said = [{"type": "session.model_change", "data": {"newModel": "gpt.5"}}, {"type": "assistant.message", "data": {"outputTokens": 4}}]
    put(tmp_path, "session-state/a/events.jsonl", [*said, shutdown(5), shutdown(6)])
    put(tmp_path, "session-state/b/events.jsonl", [*said, *said])
    assert buckets(usage(spark, "copilot", tmp_path / "session-state")) == [("claude-x-4-5", 6, 7, 2, 1, 0, 0), ("gpt.5", 0, 4, 0, 0, 0, 0), ("gpt.5", 0, 4, 0, 0, 0, 0)]


def test_gemini_keeps_the_last_revision(spark, tmp_path):
    def message(i, tokens):
        return {"id": i, "type": "gemini", "model": "g", "tokens": tokens}

    put(tmp_path, "t/chats/s.jsonl", [{"sessionId": "s", "projectHash": "h"}, message("1", {"input": 10, "cached": 4, "output": 3, "thoughts": 2, "tool": 1, "total": 16}), message("1", None), message("2", {"input": 1, "cached": 5}), {"$set": {"messages": [message("3", {"input": 7}), message("", {"input": 9}), message(None, {"input": 9})]}}, {"id": "3", "type": "gemini", "tokens": {"input": 8}}, message("4", {})])
    rows = usage(spark, "gemini", tmp_path)
    assert buckets(rows) == [("g", 0, 0, 0, 5, 0, 0), ("g", 6, 3, 2, 4, 0, 0), ("g", 7, 0, 0, 0, 0, 0)]


def test_deepseek_counts_a_step_once_and_survives_torn_frames(spark, tmp_path):
    def use(kind, turn, step, n, model=None):
        u = {"inputTokens": n, "outputTokens": 50, "reasoningTokens": 30, "cacheReadTokens": 2}
        data = {"turn": turn, "step": step}
        return {"type": f"assistant/{kind}", "seq": n, "time": 1, "data": data | ({"chunk": {"type": "usage", "usage": u}} if kind == "chunk" else {"usage": u, "message": {"source": {"model": model}}})}

    records = [{"type": "session", "version": 0, "id": "s"}, {"type": "request/context", "data": {"model": "r"}}, use("chunk", 1, 1, 5), use("message", 1, 1, 6, "own"), use("chunk", 1, 2, 7)]
    put(tmp_path, "sessions/p/a/session.jsonl", records)
    put(tmp_path, "sessions/p/c/session.jsonl", [{"type": "session", "version": 2, "id": "foreign"}, *records[1:]])
    frames = [zstandard.ZstdCompressor().compress((json.dumps(r) + "\n").encode()) for r in records]
    (tmp_path / "sessions/p/b").mkdir()
    (tmp_path / "sessions/p/b/session.jsonl.zstd").write_bytes(b"".join(frames[:4]) + frames[4][:-6])
    assert buckets(usage(spark, "deepseek", tmp_path / "sessions")) == [("own", 6, 20, 30, 2, 0, 0), ("own", 6, 20, 30, 2, 0, 0), ("r", 7, 20, 30, 2, 0, 0)]


def test_grok_reads_one_gauge(spark, tmp_path):
    signals = {"primaryModelId": "", "contextTokensUsed": 12345, "toolsUsed": []}
    put(tmp_path, "sessions/c/s/signals.json", [json.dumps(signals | {"modelsUsed": [" ", " k "]}, indent=1)])
    put(tmp_path, "sessions/c/t/signals.json", [json.dumps(signals)])
    put(tmp_path, "sessions/c/t/summary.json", [json.dumps({"current_model_id": "alias"})])
    put(tmp_path, "sessions/deep/sessions/c/u/signals.json", [json.dumps(signals | {"modelsUsed": ["too deep"]})])
    assert buckets(usage(spark, "grok", tmp_path / "sessions")) == [("alias", 0, 0, 0, 12345, 0, 0), ("k", 0, 0, 0, 12345, 0, 0)]


def test_detect_provider(spark, tmp_path):
    put(tmp_path, "a", [{"type": "session.start", "data": {"producer": "copilot-agent"}}])
    put(tmp_path, "b", ["{broken", {"x": 1}, {"parentUuid": None}])
    put(tmp_path, "c", [{"x": 1}, {"sessionId": "late", "projectHash": "h"}])
    put(tmp_path, "d", [{"type": "session", "version": 7, "id": "i"}])
    put(tmp_path, "e", [{"primaryModelId": "g", "contextTokensUsed": 1, "toolsUsed": []}])
    put(tmp_path, "f", [{"primaryModelId": "g", "contextTokensUsed": 1}])
    put(tmp_path, "g", [{"sessionId": "s", "projectHash": "h", "messages": []}])
    put(tmp_path, "h", [{"sessionId": "s", "projectHash": "h"}, {"parentUuid": "u"}])
    put(tmp_path, "i", [{"type": "session", "version": "0", "id": "i"}, {"type": "session.start", "data": {"producer": "copilot"}}])
    found = logs.detect_provider(logs.lines(logs.read_files(spark, str(tmp_path))))
    assert {r.path[-1]: r.provider for r in found.collect()} == dict(zip("abcdefghi", ["copilot", "claude", "codex", "deepseek", "grok", "codex", "codex", "gemini", "codex"]))


def test_sqlite_stores(spark, tmp_path):
    with sqlite3.connect(tmp_path / "o.db") as con:
        con.execute("CREATE TABLE session (id, directory, time_updated)")
        con.execute("CREATE TABLE message (id, session_id, data)")
        con.execute("INSERT INTO session VALUES ('s', '/', 1700000000000)")
        data = {"role": "assistant", "providerID": "p", "modelID": "m", "cost": 0.5, "tokens": {"input": 1, "output": 2, "reasoning": 3, "cache": {"read": 4, "write": 5}}}
        con.execute("INSERT INTO message VALUES ('1', 's', ?), ('2', 's', '{\"role\":\"user\"}')", [json.dumps(data)])
    with sqlite3.connect(tmp_path / "empty.db") as con:
        con.execute("CREATE TABLE x (y)")
    rows = sqlite.opencode(spark, [str(tmp_path / "o.db"), str(tmp_path / "empty.db")])
    assert buckets(rows) == [("p/m", 1, 2, 3, 4, 5, 0)]
    assert [(str(r.session_date), r.stored_cost) for r in rows.collect()] == [("2023-11-14", 0.5)]

    with sqlite3.connect(tmp_path / "h.db") as con:
        counts = "input_tokens, output_tokens, reasoning_tokens, cache_read_tokens, cache_write_tokens, estimated_cost_usd, actual_cost_usd"
        con.execute(f"CREATE TABLE session_model_usage (session_id, model, {counts}, first_seen, last_seen)")
        con.execute(f"CREATE TABLE sessions (id, model, {counts}, started_at, ended_at)")
        con.execute("INSERT INTO session_model_usage VALUES ('s', 'm', 10, 6, 2, 0, 0, 0.1, 0, 1700000000, NULL), ('s', 'n', NULL, 6, 2, 0, 0, 0.1, 0, 1700000000, NULL)")
        con.execute("INSERT INTO sessions VALUES ('s', 'z', 25, 10, 9, 1, 0, 0.3, 0, 1700000000, 1700000100)")
    assert buckets(sqlite.hermes(spark, [str(tmp_path / "h.db")])) == [("m", 10, 4, 2, 0, 0, 0), ("z", 15, 0, 4, 1, 0, 0)]


def test_price_levels(spark, tmp_path):
    listed = {
        "t": {"input_cost_per_token": 1.0, "output_cost_per_token": 2.0, "input_cost_per_token_above_200k_tokens": 4.0, "max_tokens": 5},
        "r": {"tiered_pricing": [{"range": [0, 32000], "input_cost_per_token": 1.0}, {"range": [32000, 128000], "input_cost_per_token": 3.0}]},
        "free": {"input_cost_per_token": 0},
    }
    (tmp_path / "p.json").write_text(json.dumps(listed))
    got = {r.model_key: r for r in prices.read_prices(spark, str(tmp_path / "p.json")).collect()}
    assert set(got) == {"t", "r"}
    assert (got["t"].bounds, [(x.input, x.output) for x in got["t"].levels]) == ([200000], [(4.0, 2.0)])
    assert (got["r"].bounds, got["r"].base.input, [x.input for x in got["r"].levels]) == ([31999], 1.0, [3.0])
