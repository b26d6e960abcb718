"""Canonical relations and the provider dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: provider, scan rank, label, how it is priced, whether it has file operations. Fixed values.
PROVIDERS = [
    ("claude", 0, "Claude Code", "lookup", True),
    ("codex", 1, "Codex", "lookup", True),
    ("copilot", 2, "Copilot CLI", "lookup", True),
    ("gemini", 3, "Gemini", "lookup", True),
    ("grok", 4, "Grok", "gauge", True),
    ("deepseek", 5, "DeepSeek", "lookup", True),
    ("opencode", 6, "OpenCode", "stored", True),
    ("cursor", 7, "Cursor", "estimate", True),
    ("hermes", 8, "Hermes", "stored", False),
]
NAMES = [p[0] for p in PROVIDERS]
#: Providers that keep stores rather than logs. Fixed values.
STORES = ["opencode", "cursor", "hermes"]
#: Order in which a merged row takes its matched model. Fixed values.
MATCH_ORDER = ["claude", "codex", "copilot", "gemini", "deepseek", "grok", "opencode", "cursor", "hermes"]

REQUEST_USAGE = (
    "provider string, path string, session_id string, session_date date, ts_ms bigint, model string, is_advisor boolean, "
    "input bigint, output bigint, reasoning bigint, cache_read bigint, cc_5m bigint, cc_1h bigint, web_search bigint, "
    "tool_tokens bigint, published_total bigint, request_context bigint, stored_cost double"
)
OPERATIONS = (
    "provider string, path string, session_id string, seq bigint, op string, file_path string, line_count bigint, char_count bigint, "
    "ts_ms bigint, counts_call boolean, content string, old_string string, new_string string, command string, description string"
)
SESSIONS = "provider string, path string, session_id string, session_date date, last_ts bigint, folder_path string, git_remote_url string"
PRICES = (
    "model_key string, base struct<input:double,output:double,reasoning:double,cache_read:double,cc_5m:double,cc_1h:double>, "
    "levels array<struct<input:double,output:double,reasoning:double,cache_read:double,cc_5m:double,cc_1h:double>>, "
    "ranged boolean, bounds array<bigint>, web_search double"
)


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "provider string, scan_rank int, label string, cost_basis string, has_analysis boolean")
