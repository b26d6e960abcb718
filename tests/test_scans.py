import datetime
import json
import os
import sqlite3

import pytest
import zstandard

from tests.test_sources import buckets, put
from tests.test_stores import opencode_store
from tokentide import api
from tokentide.functions.tokens import BUCKETS
from tokentide.schemas import PRICES
from tokentide.sources import accounting, logs, scans, sqlite
from tokentide.streaming import state as states


def assistant(n, **more):
    return {"type": "assistant", "sessionId": "s", "message": {"model": "m", "usage": {"input_tokens": n}}} | more


@pytest.fixture
def prices(spark):
    return spark.createDataFrame([], PRICES)


def named(reported):
    return {r.path.rsplit("/", 1)[1]: r for r in reported.collect()}


def world(tmp_path):
    """Logs and stores, of which some are broken, each in its own way."""
    put(tmp_path, "claude/good.jsonl", [assistant(1), {"type": "user"}])
    put(tmp_path, "claude/blank.jsonl", [" ", ""])
    put(tmp_path, "claude/part [1] é%20.jsonl", [assistant(2), "{broken", {"type": "odd"}, {"type": "assistant"}])
    put(tmp_path, "claude/strange.jsonl", [{"type": "odd"}])
    put(tmp_path, "claude/useless.jsonl", [{"type": "assistant"}])
    lines = [{"type": "session", "version": 0, "id": "s"}, {"type": "request/context", "data": {"model": "r"}}, {"type": "assistant/message", "data": {"turn": 1, "step": 1, "usage": {"inputTokens": 4}}}]
    frames = [zstandard.ZstdCompressor().compress((json.dumps(r) + "\n").encode()) for r in [*lines, {"type": "turn/end"}]]
    (tmp_path / "sessions/p/a").mkdir(parents=True)
    (tmp_path / "sessions/p/a/session.jsonl.zstd").write_bytes(b"".join(frames[:3]) + frames[3][:-6])
    opencode_store(tmp_path / "good.db", True)
    (tmp_path / "bad.db").write_bytes(b"no store at all " * 300)
    with sqlite3.connect(tmp_path / "other.db") as con:
        con.execute("CREATE TABLE unrelated (x)")
    return {
        "claude": [str(tmp_path / "claude"), str(tmp_path / "gone")], "deepseek": [str(tmp_path / "sessions")],
        "opencode": [str(tmp_path / "good.db"), str(tmp_path / "bad.db"), str(tmp_path / "none.db")], "hermes": [str(tmp_path / "other.db")],
    }


ERRORS = {
    "part%20%5B1%5D%20é%2520.jsonl": "partially parsed: skipped 3 malformed or unsupported records", "strange.jsonl": "none of 1 records is of a known type", "useless.jsonl": "none of 1 relevant records could be read",
    "session.jsonl.zstd": "partially parsed: skipped 1 malformed or unsupported records", "bad.db": "file is not a database", "other.db": "no such table: session_model_usage",
}


def test_broken_sources_do_not_end_the_views(spark, prices, tmp_path):
    roots = world(tmp_path)
    views = api.usage(spark, roots, prices)
    assert {(r.provider, r.model): r.input for r in views["by_provider"].collect()} == {("claude", "m"): 3, ("deepseek", "r"): 4, ("opencode", "p/m"): 2}
    failures = [(r.provider, r.path.rsplit("/", 1)[1], r.error) for r in views["failures"].collect()]
    assert {n: e for _, n, e in failures} == ERRORS
    assert [p for p, _, _ in failures] == ["claude", "claude", "claude", "deepseek", "opencode", "hermes"] and failures[:3] == sorted(failures[:3])
    counts = [(r.provider, r.candidates, r.parsed, r.failures) for r in views["scan"].collect()]
    assert counts == [("claude", 5, 3, 3), ("deepseek", 1, 1, 1), ("opencode", 2, 1, 1), ("hermes", 1, 0, 1), (None, 9, 5, 6)]
    done = api.analysis(spark, roots)
    assert len(done["failures"].collect()) == 5
    assert {(r.provider, r.model) for r in done["by_provider_model"].collect()} >= {("claude", "m")}


def test_a_store_that_breaks_half_way_gives_nothing(spark, tmp_path):
    path = tmp_path / "torn.db"
    opencode_store(path, True)
    with sqlite3.connect(path) as con:
        con.executemany("INSERT INTO message VALUES (?, 's', ?)", [(f"x{i}", json.dumps({"role": "user", "text": "y" * 900})) for i in range(400)])
    whole = path.read_bytes()
    path.write_bytes(whole[: len(whole) // 2])
    assert api._good_stores(spark, {"opencode": [str(path)]}, None) == {"opencode": []}
    assert buckets(api.requests(spark, {"opencode": [str(path)]})) == []
    error = sqlite.store_failures(spark, "opencode", [str(path)]).first()
    assert error.lasting and "malformed" in error.error


def test_a_file_that_goes_while_it_is_read_is_no_candidate(spark, tmp_path):
    for name in ("a", "b"):
        put(tmp_path, f"c/{name}.jsonl", [assistant(1)])
    reported = scans.file_report(spark, "claude", [str(tmp_path / "c")])
    os.remove(tmp_path / "c/b.jsonl")
    rows = named(reported)
    assert rows.keys() == {"a.jsonl"} and rows["a.jsonl"].parsed


def test_a_file_that_is_read_in_part_fails(spark):
    counted = [("claude", f"/{n}.jsonl", None, 1, 0, 1, 1, 1, read, length) for n, read, length in (("a", 10, 10), ("b", 11, 10), ("c", 7, 10), ("d", 6, 10), ("e", None, None))]
    rows = named(scans._judged(spark.createDataFrame(counted, f"{accounting.COUNTERS}, read bigint, length bigint")))
    assert [(n, r.parsed, r.lasting) for n, r in sorted(rows.items()) if r.error] == [("d.jsonl", False, False)]
    assert rows["d.jsonl"].error == "read 6 of 10 bytes"


@pytest.mark.parametrize("tail", ["", "\n", "\r\n", "\n\n \n"])
def test_bytes_of_whole_files_are_all_read(spark, tmp_path, tail):
    path = tmp_path / "c/s.jsonl"
    path.parent.mkdir()
    path.write_bytes(b"\xef\xbb\xbf" + json.dumps({"é": 1}).encode() + b"\r\n\n{}" + tail.encode())
    row = scans.file_reads(spark, "claude", [str(tmp_path / "c")]).first()
    assert row.length - 3 <= row.read <= row.length + 1


def test_torn_frames():
    frames = [zstandard.ZstdCompressor().compress(x) for x in (b"one\n", b"two\nthree\n")]
    assert logs._decoded(b"".join(frames)) == b"one\ntwo\nthree\n"
    assert logs._decoded(frames[0] + frames[1][:-3]) .endswith(logs.TORN) and logs._decoded(frames[0] + frames[1][:-3]).startswith(b"one\n")
    assert logs._decoded(frames[0] + b"junk") == b"one\n" + logs.TORN
    assert logs._decoded(b"") == b""


def stored(spark, state, roots):
    rows, reported = states.refresh(spark, roots, str(state))
    return sorted((r.path.rsplit("/", 1)[1], r.input) for r in rows.collect()), named(reported)


def refreshes(state, kind):
    return sorted(p.name for p in (state / kind).iterdir())


def test_only_what_changed_is_read(spark, prices, tmp_path):
    for i in range(100):
        put(tmp_path, f"c/{i}.jsonl", [assistant(i + 1)])
    roots, state = {"claude": [str(tmp_path / "c")]}, tmp_path / "state"
    rows, reported = stored(spark, state, roots)
    assert len(rows) == 100 and len(reported) == 100
    stored(spark, state, roots)
    assert refreshes(state, "lists") == ["number=1"]  # nothing changed, nothing written
    put(tmp_path, "c/7.jsonl", [assistant(1000), "{broken"])
    rows, reported = stored(spark, state, roots)
    assert ("7.jsonl", 1000) in rows and ("7.jsonl", 8) not in rows and len(rows) == 100
    assert spark.read.parquet(f"{state}/reports/refresh=2").count() == 1
    assert reported["7.jsonl"].error.startswith(scans.PARTLY)
    os.remove(tmp_path / "c/3.jsonl")
    rows, reported = stored(spark, state, roots)
    assert len(rows) == 99 and "3.jsonl" not in reported
    views = api.usage(spark, roots, prices, state=str(state))
    assert {c: views["by_model"].first()[c] for c in BUCKETS[:1]} == {BUCKETS[0]: sum(n for _, n in rows)}
    assert views["scan"].first()["candidates"] == 99 and views["failures"].count() == 1


def test_state_holds_all_kinds_of_sources(spark, prices, tmp_path):
    roots, state = world(tmp_path), str(tmp_path / "state")
    put(tmp_path, "grok/%2Fw/s/signals.json", [{"primaryModelId": "", "contextTokensUsed": 5, "toolsUsed": []}])
    roots["grok"] = [str(tmp_path / "grok")]
    os.rename(tmp_path / "grok", tmp_path / "sessions-of-grok")
    os.makedirs(tmp_path / "grok")
    os.rename(tmp_path / "sessions-of-grok", tmp_path / "grok/sessions")
    roots["grok"] = [str(tmp_path / "grok/sessions")]
    day = datetime.date.today()
    plain, kept = api.usage(spark, roots, prices, today=day), api.usage(spark, roots, prices, today=day, state=state)
    for view in ("by_provider", "failures", "scan"):
        assert kept[view].collect() == plain[view].collect()
    # a side file changes a session's version, and a failure lasts until its store changes
    put(tmp_path, "grok/sessions/%2Fw/s/summary.json", [{"current_model_id": "k"}])
    kept = api.usage(spark, roots, prices, today=day, state=state)
    assert {(r.provider, r.model): r.cache_read for r in kept["by_provider"].collect()}[("grok", "k")] == 5
    assert spark.read.parquet(f"{state}/reports/refresh=2").count() == 1
    os.remove(tmp_path / "bad.db")
    opencode_store(tmp_path / "bad.db", True)
    kept = api.usage(spark, roots, prices, today=day, state=state)
    assert "bad.db" not in {r.path.rsplit("/", 1)[1] for r in kept["failures"].collect()}
    assert kept["by_provider"].filter("provider = 'opencode'").first()["input"] == 4
    # a view of some providers leaves the others' sources in the table
    api.usage(spark, {"claude": roots["claude"]}, prices, today=day, state=state)
    assert states.current(spark, state)[1].filter("provider = 'grok'").count() == 1


def test_refreshes_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(states, "MOST_REFRESHES", 2)
    roots, state = {"claude": [str(tmp_path / "c")]}, tmp_path / "state"
    want = []
    for i in range(4):
        put(tmp_path, f"c/{i}.jsonl", [assistant(i)])
        want.append((f"{i}.jsonl", i))
        assert stored(spark, state, roots)[0] == want
    assert refreshes(state, "requests") == refreshes(state, "reports") == ["refresh=4", "refresh=5"]  # 4 holds 1 to 3
    assert refreshes(state, "lists") == ["number=4", "number=5"]
    # a refresh that ends before its list is written is as if it had not been
    (state / "requests/refresh=99").mkdir()
    (state / "lists/number=99").mkdir()
    assert stored(spark, state, roots)[0] == want


def test_failures_that_may_pass_are_tried_again(spark, tmp_path, monkeypatch):
    put(tmp_path, "c/a.jsonl", [assistant(1)])
    roots, state = {"claude": [str(tmp_path / "c")]}, tmp_path / "state"
    from pyspark.sql import functions as F

    report = scans.file_report
    monkeypatch.setattr(scans, "file_report", lambda *a: report(*a).withColumns({"parsed": F.lit(False), "error": F.lit("locked"), "lasting": F.lit(False)}))
    assert stored(spark, state, roots)[1]["a.jsonl"].error == "locked"
    monkeypatch.setattr(scans, "file_report", report)
    rows, reported = stored(spark, state, roots)
    assert rows == [("a.jsonl", 1)] and reported["a.jsonl"].error is None
