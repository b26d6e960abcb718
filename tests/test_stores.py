import datetime
import json
import sqlite3

from pyspark.sql import functions as F

from tests.test_operations import COUNTS
from tests.test_sources import buckets, put
from tokentide import api
from tokentide.functions import text
from tokentide.operators.analysis import session_totals
from tokentide.schemas import PRICES
from tokentide.sources import catalog, cursor, operations, sqlite

DAY = 1_700_000_000_000  # 2023-11-14


def varint(x):
    out = b""
    while x > 0x7F:
        out, x = out + bytes([x & 0x7F | 0x80]), x >> 7
    return out + bytes([x])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def node(message, gauge=None, ts=None):
    body = json.dumps(message).encode() if not isinstance(message, bytes) else message
    return field(1, b"\0") + field(4, body) + (b"" if gauge is None else field(5, gauge)) + (b"" if ts is None else field(26, ts))


def cursor_store(root, conversation, blobs, meta=()):
    path = root / "p" / conversation / "store.db"
    path.parent.mkdir(parents=True)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE blobs (id TEXT PRIMARY KEY, data BLOB)")
        con.execute("CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT)")
        con.executemany("INSERT INTO blobs VALUES (?, ?)", blobs)
        con.executemany("INSERT INTO meta VALUES (?, ?)", meta)


def test_cursor_gauges_and_models(spark, tmp_path):
    turn = {"role": "assistant", "content": []}
    blobs = [("a", node(turn, field(1, 300), DAY)), ("b", node(turn, field(2, 7) + field(1, 5), DAY + 1)), ("c", node({"role": "user"}, field(1, 9), DAY)), ("d", node(turn, b"", DAY)), ("e", node(turn, field(3, 1), DAY)), ("f", b"{}"), ("g", node(turn, field(1, 1), DAY)[:-4])]
    cursor_store(tmp_path, "one", blobs, [("a", "not json"), ("b", json.dumps({"lastUsedModel": "composer"}).encode().hex())])
    cursor_store(tmp_path, "two", blobs[:1], [("a", json.dumps({"lastUsedModel": "own"}))])
    cursor_store(tmp_path, "three", blobs[:1])
    (tmp_path / "deep/x/y").mkdir(parents=True)
    with sqlite3.connect(tmp_path / "t.db") as con:
        con.execute("CREATE TABLE ai_code_hashes (conversationId, model)")
        con.executemany("INSERT INTO ai_code_hashes VALUES (?, ?)", [("two", "z"), ("two", "b"), ("two", "a"), ("two", "b"), ("two", "z"), ("", "x"), ("one", "")])
    rows = cursor.read_usage(spark, [str(tmp_path)], [str(tmp_path / "t.db")])
    assert buckets(rows) == [("b", 0, 0, 0, 300, 0, 0), ("composer", 0, 0, 0, 5, 0, 0), ("composer", 0, 0, 0, 300, 0, 0), ("unknown", 0, 0, 0, 300, 0, 0)]
    got = {(str(r.session_date), r.model): (r.cache_read, r.ts_ms) for r in cursor.gauges_by_date(rows).collect()}
    assert got[("2023-11-14", "composer")] == (305, DAY + 1)


def test_nodes_end_where_their_bytes_do():
    assert cursor.decode_node(node(b"m", field(1, 2), 3)) == (b"m", field(1, 2), 3)
    assert cursor.decode_node(varint(2 << 3 | 5) + b"1234" + varint(3 << 3 | 1) + b"12345678" + field(26, 9)) == (None, None, 9)
    for broken in (b"", b"\x80", varint(4 << 3 | 2) + varint(99) + b"x", b"\x0b", b"\xff" * 12):
        assert cursor.decode_node(broken) == (None, None, None)
    assert cursor.gauge_count(field(9, b"xx") + field(1, 2**64 - 1)) == -1


def totals(ops):
    return {r["path"].rsplit("#", 1)[1]: tuple(r[c] for c in COUNTS) for r in session_totals(ops, ["path"]).collect()}


def test_cursor_operations(spark, tmp_path):
    def call(tool, key="k", **args):
        return {"type": "tool-call", "toolName": tool, "toolCallId": key, "args": args}

    calls = [call("Write", path="/repo/output.rs", contents="first\nsecond"), call("StrReplace", path="/a", old_string="x", new_string="y"), call("Read", "r1", path="/b"), call("ReadFile", "r2", path="/c"), call("Shell", command="ls"), call("TodoWrite"), call("Grep"), call("Write", path="/no")]
    said = {"role": "tool", "content": [{"type": "tool-result", "toolName": "Read", "toolCallId": "r1", "result": "     1|one\n    12|two\nnote"}, {"type": "tool-result", "toolName": "Read", "toolCallId": "r2", "result": {}}]}
    blobs = [("a", node({"role": "assistant", "content": calls}, field(1, 1), DAY)), ("b", json.dumps(said).encode()), ("c", node({"role": "assistant", "content": [call("TodoWrite")]}, None, DAY + 86_400_000)), ("d", node({"role": "assistant", "content": "text"}, None, DAY))]
    cursor_store(tmp_path, "one", blobs)
    ops, sessions, models = operations.cursor(spark, [str(tmp_path)])
    assert totals(ops) == {"2023-11-14": (2, 7, 2, 12, 1, 1, 2, 1, 1, 1, 1, 3), "2023-11-15": (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0)}
    assert {(r.session_id, str(r.session_date), r.last_ts) for r in sessions.collect()} == {("one", "2023-11-14", DAY), ("one", "2023-11-15", DAY + 86_400_000)}
    assert {r.model for r in models.collect()} == {"unknown"}


def part(tool, status="completed", output=None, **given):
    return json.dumps({"type": "tool", "tool": tool, "state": {"status": status, "input": given, "output": output}})


PARTS = [
    part("read", output="<content>\n1: a\n2: b\n</content>", filePath="r.py"), part("read", output="listing", filePath="dir"), part("read", output="/p\nfile\n\n1: x\n2: y\nend", filePath="/p"), part("edit", filePath="e", oldString="", newString="n"),
    part("write", filePath="w", content="c\n"), part("bash", command="ls"), part("todowrite"), part("write", "error", filePath="no", content="c"), part("apply_patch", patchText="*** Begin Patch\n*** Update File: f\n*** Move to: g\n+y\n*** End Patch"), part("grep"),
]


def opencode_store(path, modern):
    with sqlite3.connect(path) as con:
        tokens = ", ".join(f"tokens_{c}" for c in ("input", "output", "reasoning", "cache_read", "cache_write"))
        con.execute(f"CREATE TABLE session (id, model, directory, time_updated, cost, {tokens})")
        con.execute("CREATE TABLE part (id, message_id, session_id, data)")
        rows = [("s", "plain", "/d", DAY, 0.5), ("t", '{"id": "m", "providerID": "p"}', "/d", DAY, 0.25), ("u", "null", "/d", DAY, 1.0), ("old", "plain", "/d", DAY - 10 * 86_400_000, 2.0)]
        con.executemany("INSERT INTO session VALUES (?, ?, ?, ?, ?, 1, 2, 3, 4, 5)", rows)
        con.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", [(f"{i:02}", "1", "s", p) for i, p in enumerate(PARTS)] + [("99", "1", "s", "broken")])
        if modern:
            con.execute("CREATE TABLE message (id, session_id, data)")
            data = {"role": "assistant", "model": {"modelID": "m", "providerID": " p "}, "tokens": {"input": 1, "cache": {"read": 2}}, "time": {"completed": "text", "created": DAY + 0.5}}
            odd = {"role": "assistant", "modelID": "q/m", "providerID": "q", "tokens": {"cache": {"other": 1}}}
            con.executemany("INSERT INTO message VALUES (?, ?, ?)", [("1", "s", json.dumps(data)), ("2", "s", json.dumps(odd)), ("3", "old", json.dumps(data | {"time": {}})), ("4", "s", '{"role": "user"}')])


def test_opencode_stores_of_both_kinds(spark, tmp_path):
    new, old = (str(tmp_path / n) for n in ("new.db", "old.db"))
    opencode_store(new, True)
    opencode_store(old, False)
    assert buckets(sqlite.opencode(spark, [new], DAY)) == [("p/m", 1, 0, 0, 2, 0, 0)]
    assert buckets(sqlite.opencode(spark, [new])) == [("p/m", 1, 0, 0, 2, 0, 0)] * 2
    legacy = sqlite.opencode(spark, [old], DAY)
    assert buckets(legacy) == [("p/m", 1, 2, 3, 4, 5, 0), ("plain", 1, 2, 3, 4, 5, 0)] and {r.stored_cost for r in legacy.collect()} == {0.5, 0.25}
    assert {r.path.rsplit("/", 1)[1]: r.n for r in sqlite.opencode_candidates(spark, [new, old], DAY).collect()} == {"new.db": 2, "old.db": 3}
    want = (4, 6, 2, 2, 1, 1, 3, 2, 1, 1, 1, 5)
    for path, sources in ((new, {"1", "2", "3"}), (old, {"s", "t", "old"})):
        ops, sessions, models = operations.opencode(spark, [path])
        assert totals(ops) == {min(sources) if path == new else "s": want}
        assert {r.path.rsplit("#", 1)[1] for r in sessions.collect()} == sources and models.count() == 3


def test_a_store_that_cannot_be_read_in_place_is_copied(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w.db")
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE t (x)")
    con.execute("INSERT INTO t VALUES (1)")
    con.commit()
    real = sqlite3.connect

    def refuse(name, **options):
        if options.get("uri"):
            raise sqlite3.OperationalError("unable to open")
        return real(name, **options)

    monkeypatch.setattr(sqlite.sqlite3, "connect", refuse)
    with sqlite.opened(path, "t") as store:
        assert store.execute("SELECT x FROM t").fetchall() == [(1,)]
    con.close()


def test_read_bodies(spark):
    rows = [("x\nfile\r\n\r\n1: a\r\n2: b: c\nnot",), ("<content>\n7: only\nplain\n",), ("x\ndirectory\n\n1: a",), ("x",)]
    got = spark.createDataFrame(rows, "o string").select(text.read_body(F.col("o")).alias("b")).collect()
    assert [r.b for r in got] == ["a\nb: c", "only\nplain", "", ""]


def test_catalog():
    env = {"XDG_DATA_HOME": "relative", "GROK_HOME": "/g", "DSH_HOME": "  ", "HERMES_HOME": "/h"}
    got = catalog.catalog("/home/u", env)
    assert got["codex"] == ["/home/u/.codex/sessions", "/home/u/.codex/archived_sessions"]
    assert (got["grok"], got["deepseek"], got["hermes"], got["opencode"]) == (["/g/sessions"], ["/home/u/.dsh/sessions"], ["/h/state.db"], ["/home/u/.local/share/opencode/opencode.db"])
    assert catalog.catalog("/home/u", {"XDG_DATA_HOME": "/x"})["opencode"] == ["/x/opencode/opencode.db"]


def test_both_views_from_a_home_folder(spark, tmp_path):
    message = {"type": "assistant", "sessionId": "s", "cwd": "/w", "message": {"model": "m", "usage": {"input_tokens": 10, "output_tokens": 2}, "content": [{"type": "tool_use", "id": "1", "name": "Bash", "input": {"command": "ls"}}]}}
    put(tmp_path, ".claude/projects/p/x.jsonl", [message])
    (tmp_path / ".local/share/opencode").mkdir(parents=True)
    opencode_store(tmp_path / ".local/share/opencode/opencode.db", True)
    cursor_store(tmp_path / ".cursor/chats", "one", [("a", node({"role": "assistant", "content": []}, field(1, 7), DAY))])
    roots = catalog.catalog(str(tmp_path), {})
    rates = (1.0, 1.0, 0.0, 1.0, 1.0, 0.0)
    prices = spark.createDataFrame([("m", rates, [], False, None, 0.0)], PRICES)
    views = api.usage(spark, roots, prices)
    assert {(r.provider, r.model): r.cost_usd for r in views["by_provider"].collect()} == {("claude", "m"): 12.0, ("opencode", "p/m"): 0.0, ("cursor", "unknown"): 0.0}
    assert {r.provider: r.days for r in views["days"].collect()} == {"claude": 1, "opencode": 2, "cursor": 1, None: 3}
    late = api.usage(spark, roots, prices, "daily", datetime.date(2023, 11, 14), ["opencode", "cursor"])["by_model"]
    assert {r.model: r.total for r in late.collect()} == {"p/m": 3, "unknown": 7}
    done = api.analysis(spark, roots)
    assert {(r.provider, r.model): (r.run_calls, r.read_calls) for r in done["by_provider_model"].collect()} == {("claude", "m"): (1, 0), ("opencode", "p/m"): (1, 3), ("opencode", "q/m"): (0, 0), ("cursor", "unknown"): (0, 0)}
    assert api.usage(spark, {}, prices)["by_provider"].count() == 0


def test_single_files_tell_their_provider(spark, tmp_path):
    claude = put(tmp_path, "c.jsonl", [{"x": 1}, {"parentUuid": "u", "type": "assistant", "message": {"model": "m", "usage": {"input_tokens": 3}, "content": []}}])
    signals = put(tmp_path, "g/signals.json", [json.dumps({"primaryModelId": "k", "contextTokensUsed": 4, "toolsUsed": []}, indent=1)])
    for path, want in ((claude, ("claude", "m", 3)), (signals, ("grok", "k", 4))):
        provider, rows, _, sessions = api.parse_file(spark, str(path))
        row = rows.first()
        assert (provider, row.model, row.input + row.cache_read) == want and sessions.count() == 1
