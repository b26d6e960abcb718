import json

from pyspark.sql import functions as F

from tests.test_sources import put
from tokentide.functions import formats, text, times
from tokentide.operators import analysis, export, usage
from tokentide.sources import logs, operations, quota, usage_logs

NOW = 1_000_000


def mapped(spark, mapper, *bodies):
    rows = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b), NOW) for i, b in enumerate(bodies)], "i int, body string, now bigint")
    return [r.asDict(recursive=True) for r in mapper(rows).orderBy("i").collect()]


def window(used, resets):
    return {"used_percent": used, "resets_at": resets}


def test_claude(spark):
    limits = [{"kind": "weekly_scoped", "percent": 90, "scope": {"model": {"display_name": "Idle"}}}, {"kind": "weekly_scoped", "percent": 5.5, "is_active": True, "resets_at": "1970-01-02T00:00:00Z", "scope": {"model": {"display_name": "Busy"}}}, {"kind": "other", "severity": "reached"}]
    body = {"five_hour": {"utilization": 42, "resets_at": "1970-01-01T01:00:00Z"}, "seven_day": {"utilization": None}, "limits": limits, "spend": {"balance": {"amount_minor": 1234, "exponent": 2}, "used": {"amount_minor": 5, "currency": "EUR"}}}
    got, bare, broken = mapped(spark, quota.claude, body, {"limits": "odd"}, "no json")
    assert (got["five_hour"], got["seven_day"], got["scoped_weekly"], got["scoped_label"]) == (window(42.0, 3600), window(0.0, None), window(5.5, 86400), "Busy")
    assert (got["balance"], got["spend_used"], got["limit_reached"]) == ("$12.34", "5.00 EUR", True)
    assert not bare["limit_reached"] and bare["five_hour"] is None and broken["five_hour"] is None


def test_codex_slots_and_credits(spark):
    week, day = ({"used_percent": 7, "limit_window_seconds": s, "reset_after_seconds": 60} for s in (604800, 86400))
    swapped = {"plan_type": "plus", "rate_limit": {"primary_window": week, "secondary_window": {"used_percent": 1.5, "limit_window_seconds": 18000, "reset_at": 5}, "limit_reached": False}, "credits": {"balance": 3, "approx_local_messages": [4, 9], "overage_limit_reached": True}}
    got, plain, odd = mapped(spark, quota.codex, swapped, {"rate_limit": {"primary_window": {}, "secondary_window": {"used_percent": 2}}}, {"rate_limit": {"primary_window": day}, "credits": {"balance": "1.0", "approx_local_messages": [0]}})
    assert (got["five_hour"], got["seven_day"], got["credits_balance"], got["approx_messages"], got["limit_reached"]) == (window(1.5, 5), window(7.0, NOW + 60), "3", [4, 9], True)
    assert (plain["five_hour"], plain["seven_day"], plain["limit_reached"]) == (window(0.0, None), window(2.0, None), None)
    assert (odd["five_hour"], odd["credits_balance"], odd["approx_messages"]) == (None, "1.0", None)
    credits = [{"status": "available", "expires_at": None}, {"status": "used", "expires_at": "1970-01-01T00:00:01Z"}, {"status": "available", "expires_at": "1970-01-01T00:00:09Z"}]
    assert mapped(spark, quota.reset_credits, {"available_count": -2, "credits": credits})[0]["expirations"] == [9, None]


def test_copilot_cursor_and_grok(spark):
    premium = lambda **x: {"quota_reset_date": "1970-01-02", "quota_snapshots": {"premium_interactions": x}}
    got = mapped(spark, quota.copilot, premium(percent_remaining=25.0, remaining=1, entitlement=4), premium(remaining=0, entitlement=0), premium(unlimited=True, percent_remaining=0), premium(remaining=-1, entitlement=4))
    assert [(g["premium"], g["limit_reached"]) for g in got] == [(window(75.0, 86400), False), (None, False), (None, False), (window(100.0, 86400), True)]
    plan = {"membershipType": "pro", "individualUsage": {"plan": {"totalPercentUsed": 120, "autoPercentUsed": 3}, "onDemand": {"enabled": False, "used": 5}}, "teamUsage": {"onDemand": {"used": 250}}}
    got = mapped(spark, quota.cursor, plan, plan | {"isUnlimited": True})
    assert (got[0]["total"], got[0]["auto"], got[0]["api"], got[0]["on_demand_dollars"], got[0]["limit_reached"], got[1]["limit_reached"]) == (window(100.0, None), window(3.0, None), None, 2.5, True, False)
    config = {"currentPeriod": {"type": "USAGE_PERIOD_TYPE_WEEKLY", "end": "1970-01-02T00:00:00Z"}, "creditUsagePercent": 12.5, "onDemandCap": {"val": 500}, "prepaidBalance": {}}
    got = mapped(spark, quota.grok, {"config": config}, {"config": {"onDemandUsed": {"val": 40}}})
    assert (got[0]["included"], got[0]["period_label"], got[0]["on_demand_dollars"], got[0]["on_demand_cap_dollars"], got[0]["prepaid_balance_dollars"]) == (window(12.5, 86400), "week", 0.0, 5.0, None)
    assert (got[1]["included"], got[1]["on_demand_dollars"]) == (window(0.0, None), 0.4)


def test_last_live_limits_of_a_log_and_newest_files(spark, tmp_path):
    def limits(used, resets, **more):
        return {"type": "event_msg", "payload": {"rate_limits": {"plan_type": "plus", "primary": {"used_percent": used, "window_minutes": 300, "resets_at": resets}} | more}}

    put(tmp_path, "a.jsonl", [limits(10, NOW + 9), limits(42, NOW + 5), limits(99, NOW), limits(50, NOW + 9, limit_id="other")])
    got = quota.session_limits(logs.read_lines(spark, str(tmp_path)), F.lit(NOW)).first()
    assert got.five_hour.asDict() == window(42.0, NOW + 5) and got.plan_type == "plus"
    files = [("/r", f"/r/2024/01/{d:02}/f{k}", d * 10 + k) for d in range(1, 20) for k in range(2)] + [("/s", f"/s/n{k:03}", k) for k in range(80)]
    rows = spark.createDataFrame(files, "root string, path string, modified int")
    kept = [r.path for r in quota.newest_files(rows).collect()]
    assert len(kept) == 64 and kept[0] == "/r/2024/01/19/f1" and "/s/n015" not in kept
    assert quota.newest_files(rows, most=1000).count() == 14 * 2 + 64


def test_gauges_staleness_versions(spark):
    rows = spark.createDataFrame([(95.0, 30_000, 2), (70.0, 3_601, 1), (1.0, 5, 2)], "u double, age int, schema_version int")
    got = rows.select(quota.gauge_class(F.col("u")), quota.staleness(F.col("age"))).collect()
    assert [tuple(r) for r in got] == [("red", "old"), ("yellow", "stale"), ("green", "fresh")] and quota.current_version(rows, 2).count() == 2


def test_flattened_json(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}], "d": {}}, "e": "x", "f": []}'), (2, "5"), (3, "broken"), (4, None)], "i int, j string")
    got = {(r.i, r.path, r.value) for r in export.flatten_json(rows, "j").collect()}
    assert got == {(1, "a.b[0]", "1"), (1, "a.b[1].c", "null"), (1, "a.d", "{}"), (1, "e", "x"), (1, "f", "[]"), (2, "(root)", "5")}


def test_dataset_of_a_session(spark, tmp_path):
    def event(n, kind, data, **more):
        return {"type": kind, "seq": n, "time": n, "data": data} | more

    records = [
        {"type": "session", "version": 0, "id": "s", "createdAt": 1, "cwd": "/w"}, event(2, "tool/call", {"name": "write", "arguments": json.dumps({"file_path": "n", "content": "one\ntwo\n"})}), event(3, "tool/result", {}, sourceEventSeqs=[2]),
        event(4, "assistant/message", {"turn": 1, "step": 1, "message": {"source": {"model": "m"}}, "usage": {"inputTokens": 5, "outputTokens": 80, "reasoningTokens": 30, "cacheReadTokens": 400}}),
    ]
    put(tmp_path, "p/s/session.jsonl", records)
    put(tmp_path, "sessions/p/s/session.jsonl", records)
    roots = {"deepseek": str(tmp_path / "sessions")}
    ops, sessions = operations.read_operations(spark, roots)
    value = json.loads(export.analysis_dataset(ops, sessions, usage_logs.read_usage(spark, roots)).first().value)
    record = value["records"][0]
    assert value["extensionName"] == "DeepSeek-Harness" and list(record) == sorted(record)
    assert record["conversationUsage"] == {"m": {"cache_creation_input_tokens": 0, "cache_read_input_tokens": 400, "input_tokens": 5, "output_tokens": 50, "reasoning_output_tokens": 30}}
    assert record["writeFileDetails"] == [{"characterCount": 7, "content": "one\ntwo", "filePath": "/w/n", "lineCount": 2, "timestamp": 3}]
    assert (record["toolCallCounts"]["Write"], record["totalWriteLines"], record["totalUniqueFiles"], record["readFileDetails"], record["taskId"], record["timestamp"]) == (1, 2, 1, [], "s", 4)


def test_formats_dates_and_footers(spark):
    row = spark.range(1).select(times.local_midnight_ms(F.lit("2024-01-02").cast("date")), formats.cost_compact(F.lit(1234.5)), formats.duration_until(F.lit(3_700), F.lit(0)), text.shell_kind(F.lit("cat a | wc"))).first()
    assert row[0] == 1704153600000 and row[1].startswith("$") and row[2] and row[3] == "cat"
    days = spark.createDataFrame([("codex", 2), ("grok", 0), (None, 2)], "provider string, days int")
    assert {r.provider for r in export.provider_footer(days).collect()} == {"codex", None}
    counters = spark.createDataFrame([("m", *range(len(analysis.COUNTERS)))], ["model", *analysis.COUNTERS])
    assert export.analysis_text(counters).first().value.startswith("m: read_lines=0 write_lines=1")
    assert counters.filter(analysis.any_counter()).count() == 1
    total = export.with_total(counters, "model", analysis.COUNTERS)
    assert {r.model for r in total.collect()} == {"m", "TOTAL"}
    sessions = spark.createDataFrame([("codex", "2024-01-01"), ("codex", "2024-01-01"), ("grok", "2024-01-02")], "provider string, session_date string")
    assert {r.provider: r.days for r in analysis.active_dates(sessions).collect()} == {"codex": 1, "grok": 1, None: 2}
    assert usage.derived_total() is not None


def test_origins_of_repositories(spark, tmp_path):
    from tokentide.sources import git

    put(tmp_path, "a/.git/config", ['[remote "other"]', "\turl = no", '[remote "origin"]', "\tfetch = x", "\turl = git@h:o/r.git", "[branch]"])
    put(tmp_path, "b/.git/config", ['[remote "origin"]', "[core]", "url = no"])
    rows = [("s", str(tmp_path / x), url) for x, url in (("a", ""), ("a", "kept"), ("b", ""), ("c", ""))]
    sessions = spark.createDataFrame([*rows, ("t", "", "")], "session_id string, folder_path string, git_remote_url string")
    got = sorted((r.folder_path[-1:], r.git_remote_url) for r in git.with_origins(spark, sessions).collect())
    assert got == [("", ""), ("a", "git@h:o/r"), ("a", "kept"), ("b", ""), ("c", "")]


def test_counters_of_logs(spark, tmp_path):
    from tokentide.operators import diagnostics
    from tokentide.sources import accounting

    put(tmp_path, "sessions/p/a/session.jsonl", [{"type": "session", "version": 0, "id": "s"}, {"type": "turn/end"}, {"type": "new/kind"}, "{broken"])
    put(tmp_path, "sessions/p/b/session.jsonl", [{"type": "new/kind"}])
    lines = usage_logs.provider_lines(spark, "deepseek", str(tmp_path / "sessions"))[0]
    counted = diagnostics.lost_records(accounting.source_counters(lines, "deepseek"))
    got = {r.path[-15]: (r.records, r.malformed, r.recognized, r.verdict, r.partial_failures) for r in counted.collect()}
    assert got == {"a": (4, 1, 2, "partial", 2), "b": (1, 0, 0, "failed", 0)}
    claude = spark.createDataFrame([('{"toolUseResult": {}}',), ('{"type": "user"}',), ('{"type": "x"}',)], "j string").select(F.try_parse_json("j").alias("v"))
    assert [r.recognized for r in diagnostics.recognized(claude, "claude").collect()] == [True, True, False]


def test_versions_take_in_side_files(spark):
    from tokentide.streaming import incremental

    sources = spark.createDataFrame([("s", "p", 5, 10), ("t", "q", 5, 10)], "source string, path string, modified int, length bigint")
    sides = spark.createDataFrame([("s", 9, 3), ("s", 1, 4)], "source string, modified int, length bigint")
    assert {(r.path, r.modified, r.length) for r in incremental.with_sides(sources, sides).collect()} == {("p", 9, 17), ("q", 5, 10)}


def test_kept_prices(spark, tmp_path):
    from tokentide.sources import prices

    (tmp_path / "p.json").write_text(json.dumps({"m": {"input_cost_per_token": 2.0, "max_tokens": 5}, "none": {"max_tokens": 1}}))
    for day in ("2024-01-01", "2024-01-02"):
        prices.save_prices(spark, str(tmp_path / "p.json"), str(tmp_path / "kept"), day)
    assert [p.name for p in (tmp_path / "kept").iterdir() if p.is_dir()] == ["day=2024-01-02"]
    assert {(r.model_key, r.base.input) for r in prices.saved_prices(spark, str(tmp_path / "kept")).collect()} == {("m", 2.0)}
