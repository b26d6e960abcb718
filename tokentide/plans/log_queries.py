"""Event-log, text, JSON and diagnostics queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentide.functions import formats, json, models, text
from tokentide.operators import analysis, diagnostics, pairing, windows
from tokentide.plans.adapters import EVENT_LOG, REQUESTS, event_log, requests, table
from tokentide.plans.registry import query

USER = ["user_id"]
ORDER = ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
FAR = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {EVENT_LOG} SELECT event_id, user_id, last_value(named_model IGNORE NULLS) {FAR} AS model FROM log")
def carry_forward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.carry_forward(event_log(spark, sf_dir), "named_model", USER, ORDER, "model").select("event_id", "user_id", "model")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter snapshots: every seventh omits the part, and each signup restarts the counter."""
    log = event_log(spark, sf_dir).withColumn("restarts", F.sum(F.when(F.col("event_type") == "signup", F.col("counter"))).over(windows.so_far(USER, ORDER)))
    life = F.sum((F.col("event_type") == "signup").cast("bigint")).over(windows.so_far(USER, ORDER))
    log = log.withColumn("life", life)
    inside = Window.partitionBy("user_id", "life").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("amount").over(inside)
    return log.withColumn("total", total).withColumn("part", F.when(F.col("event_id") % 7 != 0, F.floor(F.col("total") / 3).cast("bigint"))).drop("restarts", "life")


SNAPSHOTS = f"""{EVENT_LOG},
lives AS (SELECT *, (sum((event_type = 'signup')::BIGINT) {FAR}) AS life FROM log),
totals AS (SELECT *, (sum(amount) OVER (PARTITION BY user_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM lives),
snapshots AS (SELECT event_id, ts, user_id, event_type, total, CASE WHEN event_id % 7 <> 0 THEN total // 3 END AS part FROM totals),
filled AS (SELECT *, coalesce(last_value(part IGNORE NULLS) {FAR}, 0) AS now_part FROM snapshots),
pairs AS (SELECT *, coalesce(lag(total) {W}, 0) AS was_total, coalesce(lag(now_part) {W}, 0) AS was_part FROM filled)"""


@query(f"WITH {EVENT_LOG} SELECT event_id, user_id, greatest(counter - coalesce(lag(counter) {W}, 0), 0) AS counter_delta FROM log")
def codex_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.counter_deltas(event_log(spark, sf_dir), ["counter"], "counter", USER, ORDER).select("event_id", "user_id", "counter_delta")


def by_day(rows):
    """Rows of a log with the day, by which long logs are split."""
    return rows.withColumn("day", F.to_date("ts"))


@query(f"WITH {EVENT_LOG} SELECT event_id, user_id, last_value(named_model IGNORE NULLS) {FAR} AS model, max(amount) {FAR} AS peak FROM log")
def carried_over_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model in force and the peak so far, from summaries of each day of a log."""
    rows = windows.scanned(by_day(event_log(spark, sf_dir)), {"model": F.col("named_model")}, USER, ORDER, "day", {"peak": F.col("amount")})
    return rows.select("event_id", "user_id", F.col("model.now").alias("model"), F.col("peak.now").alias("peak"))


@query(f"""WITH {SNAPSHOTS} SELECT event_id, user_id, CASE WHEN total < was_total THEN total ELSE greatest(total - was_total, 0) END AS total_delta,
    CASE WHEN part IS NULL THEN 0 WHEN total < was_total THEN now_part ELSE greatest(now_part - was_part, 0) END AS part_delta FROM pairs""")
def counter_deltas_over_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.counter_deltas(by_day(snapshots(spark, sf_dir)), ["total", "part"], "total", USER, ORDER, "day")
    return rows.select("event_id", "user_id", "total_delta", "part_delta")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no FROM events")
def numbered_over_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(by_day(table(spark, sf_dir, "events")), USER, "day", ORDER, "line_no").select("event_id", "user_id", "line_no")


@query(f"""WITH {SNAPSHOTS} SELECT event_id, user_id, CASE WHEN total < was_total THEN total ELSE greatest(total - was_total, 0) END AS total_delta,
    CASE WHEN part IS NULL THEN 0 WHEN total < was_total THEN now_part ELSE greatest(now_part - was_part, 0) END AS part_delta FROM pairs""")
def counter_reset_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.counter_deltas(snapshots(spark, sf_dir), ["total", "part"], "total", USER, ORDER).select("event_id", "user_id", "total_delta", "part_delta")


@query(f"WITH {EVENT_LOG} SELECT user_id, arg_min(named_model, (ts, event_id)) FILTER (WHERE named_model IS NOT NULL) AS first_model, arg_max(named_model, (ts, event_id)) FILTER (WHERE named_model IS NOT NULL) AS last_model, max(ts) AS last_ts FROM log GROUP BY user_id")
def first_last_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("named_model").isNotNull(), F.struct(*ORDER))
    return event_log(spark, sf_dir).groupBy("user_id").agg(F.min_by("named_model", at).alias("first_model"), F.max_by("named_model", at).alias("last_model"), F.max("ts").alias("last_ts"))


@query(f"WITH {EVENT_LOG} SELECT event_id, user_id, (max(amount) {FAR})::BIGINT AS peak FROM log")
def running_max_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_max(event_log(spark, sf_dir), "amount", USER, ORDER, "peak").select("event_id", "user_id", "peak")


@query(f"""WITH {EVENT_LOG}, r AS (SELECT *, event_id % 97 AS message_id, CASE WHEN event_id % 4 <> 0 THEN amount END AS tokens FROM log),
    f AS (SELECT *, last_value(tokens IGNORE NULLS) OVER (PARTITION BY user_id, message_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kept,
        min(event_id) OVER (PARTITION BY user_id, message_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS first_event,
        row_number() OVER (PARTITION BY user_id, message_id ORDER BY ts DESC, event_id DESC) AS back FROM r)
    SELECT user_id, message_id, event_id, kept AS tokens, first_event FROM f WHERE back = 1""")
def gemini_last_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("message_id", F.col("event_id") % 97).withColumn("tokens", F.when(F.col("event_id") % 4 != 0, F.col("amount")))
    last = windows.last_revision(rows, USER, "message_id", ORDER, ["tokens"])
    return last.select("user_id", "message_id", "event_id", "tokens", F.col("first_seen.event_id").alias("first_event"))


@query(f"WITH {EVENT_LOG}, n AS (SELECT *, lead(event_type) {W} AS next FROM log) SELECT event_id, user_id, event_type, amount FROM n WHERE next IS NULL OR next <> event_type")
def dsh_step_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.supersede_runs(event_log(spark, sf_dir), USER, ["event_type"], ORDER).select("event_id", "user_id", "event_type", "amount")


@query(f"""WITH {EVENT_LOG}, s AS (SELECT user_id, arg_max(amount, (ts, event_id)) FILTER (WHERE event_type = 'purchase' AND event_id % 50 = 0) AS shutdown,
        sum(amount) FILTER (WHERE event_type = 'view') AS streamed FROM log GROUP BY user_id)
    SELECT user_id, coalesce(shutdown, streamed, 0)::BIGINT AS output, shutdown IS NOT NULL AS authoritative FROM s""")
def copilot_shutdown_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last shutdown is authoritative; without one the streamed output is summed."""
    final = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0), F.struct(*ORDER))
    sums = event_log(spark, sf_dir).groupBy("user_id").agg(F.max_by("amount", final).alias("shutdown"), F.sum(F.when(F.col("event_type") == "view", F.col("amount"))).alias("streamed"))
    return sums.select("user_id", F.coalesce("shutdown", "streamed", F.lit(0)).cast("bigint").alias("output"), F.col("shutdown").isNotNull().alias("authoritative"))


@query(f"WITH {EVENT_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, amount % 100 ORDER BY ts, event_id) AS n FROM log) SELECT user_id, amount % 100 AS call_id, event_id, event_type FROM r WHERE n = 1")
def patch_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir).withColumn("call_id", F.col("amount") % 100)
    return windows.first_per_key(rows, ["user_id", "call_id"], ORDER).select("user_id", "call_id", "event_id", "event_type")


def calls_and_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = event_log(spark, sf_dir).withColumn("call_id", F.col("event_id") % 5).select("user_id", "call_id", "event_id", "event_type", "amount")
    return rows.filter("event_type = 'view'").drop("event_type"), rows.filter("event_type = 'purchase'").drop("event_type")


CALLS = f"""{EVENT_LOG}, c AS (SELECT user_id, event_id % 5 AS call_id, event_id, amount FROM log WHERE event_type = 'view'),
    r AS (SELECT user_id, event_id % 5 AS call_id, event_id, amount FROM log WHERE event_type = 'purchase')"""


@query(f"""WITH {CALLS}, m AS (SELECT r.user_id, r.call_id, r.event_id AS result_event, max(c.event_id) AS call_event FROM r JOIN c ON r.user_id = c.user_id AND r.call_id = c.call_id AND c.event_id < r.event_id GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, call_id, call_event ORDER BY result_event) AS n FROM m)
    SELECT user_id, call_id, call_event, result_event FROM f WHERE n = 1""")
def call_result_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_and_results(spark, sf_dir)
    paired = pairing.pair_calls(calls, results, ["user_id", "call_id"], "event_id")
    return paired.select("user_id", "call_id", F.col("call.event_id").alias("call_event"), F.col("result.event_id").alias("result_event"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('view', 'purchase')),
    named AS (SELECT *, [event_id % 7 + 1, event_id // 7 % 7 + 1, event_id // 49 % 7 + 1] AS k FROM e),
    fold AS (
        SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS result_event, NULL::BIGINT AS call_event, list_transform(range(7), lambda i: NULL::BIGINT) AS pending FROM e
        UNION ALL
        SELECT user_id, n, CASE WHEN event_type = 'purchase' THEN event_id END, CASE WHEN event_type = 'purchase' THEN pending[slot] END,
            list_transform(range(1, 8), lambda i: CASE WHEN i = slot THEN CASE WHEN event_type = 'view' THEN event_id END ELSE pending[i] END)
        FROM (SELECT named.*, pending, CASE WHEN event_type = 'view' THEN k[1] WHEN pending[k[1]] IS NOT NULL THEN k[1] WHEN pending[k[2]] IS NOT NULL THEN k[2] ELSE k[3] END AS slot
            FROM fold JOIN named ON named.user_id = fold.user_id AND named.n = fold.n + 1))
    SELECT user_id, result_event, call_event FROM fold WHERE call_event IS NOT NULL""")
def multi_key_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase names three keys and takes the first that a view left pending."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (e % 7).alias("key"), F.array(e % 7, F.floor(e / 7) % 7, F.floor(e / 49) % 7).alias("named"))
    met = pairing.take_calls(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), ["user_id"], ["event_id"], "key", "named")
    return met.select("user_id", F.col("event_id").alias("result_event"), F.col("call.event_id").alias("call_event"))


@query(f"WITH {CALLS} SELECT user_id, call_id, event_id FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = r.user_id AND c.call_id = r.call_id)")
def unpaired_calls_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_and_results(spark, sf_dir)
    return pairing.unmatched(results, calls, ["user_id", "call_id"]).select("user_id", "call_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def parts_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return pairing.owned(table(spark, sf_dir, "lineitem"), owners, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT p_name AS file_name, root_rank, count(*) AS files FROM (SELECT p_name, p_partkey % 3 AS root_rank, min(p_partkey % 3) OVER (PARTITION BY p_name) AS first FROM part WHERE p_partkey % 7 <> 0 OR p_partkey % 3 <> 0) WHERE root_rank = first GROUP BY ALL""")
def sources_cross_root_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("file_name"), (F.col("p_partkey") % 3).alias("root_rank"), "p_partkey").filter("p_partkey % 7 <> 0 OR p_partkey % 3 <> 0")
    return pairing.drop_seen_names(files).groupBy("file_name", "root_rank").agg(F.count("*").alias("files"))


@query("""WITH t AS (SELECT o_orderkey AS session_id, round(o_totalprice * 100)::BIGINT AS cost, (o_custkey * 3)::BIGINT AS output, (o_custkey * 2)::BIGINT AS reasoning FROM orders),
    s AS (SELECT l_orderkey AS session_id, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cost, sum(l_quantity::BIGINT * 10)::BIGINT AS output, sum(l_linenumber)::BIGINT AS reasoning FROM lineitem GROUP BY 1)
    SELECT session_id, CASE WHEN greatest(t.cost - coalesce(s.cost, 0), 0) < 100 THEN 0 ELSE greatest(t.cost - coalesce(s.cost, 0), 0) END AS cost,
        CASE WHEN greatest(t.output - coalesce(s.output, 0), 0) < 100 THEN 0 ELSE greatest(t.output - coalesce(s.output, 0), 0) END AS output,
        least(CASE WHEN greatest(t.reasoning - coalesce(s.reasoning, 0), 0) < 100 THEN 0 ELSE greatest(t.reasoning - coalesce(s.reasoning, 0), 0) END,
            CASE WHEN greatest(t.output - coalesce(s.output, 0), 0) < 100 THEN 0 ELSE greatest(t.output - coalesce(s.output, 0), 0) END) AS reasoning
    FROM t LEFT JOIN s USING (session_id)""")
def hermes_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cost"), (F.col("o_custkey") * 3).alias("output"), (F.col("o_custkey") * 2).alias("reasoning"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cost"), (F.col("l_quantity").cast("bigint") * 10).alias("output"), F.col("l_linenumber").cast("bigint").alias("reasoning"))
    return pairing.residuals(totals, parts, "session_id", ["cost", "output", "reasoning"], {"reasoning": "output"}, noise=100)


@query(f"WITH {EVENT_LOG}, n AS (SELECT user_id, event_type, count(*) AS n FROM log GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n) SELECT user_id, event_type, n FROM r WHERE k = 1")
def dominant_model_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dominant(event_log(spark, sf_dir), "user_id", "event_type")


@query(f"WITH {EVENT_LOG} SELECT ts::DATE AS session_date, event_type AS model, sum(amount)::BIGINT AS cache_read, max(ts) AS last_ts, count(DISTINCT user_id) AS stores FROM log GROUP BY ALL")
def cursor_gauge_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy(F.to_date("ts").alias("session_date"), F.col("event_type").alias("model")).agg(F.sum("amount").cast("bigint").alias("cache_read"), F.max("ts").alias("last_ts"), F.count_distinct("user_id").alias("stores"))


@query(f"""WITH {EVENT_LOG}, d AS (SELECT user_id, named_model, count(*) AS n FROM log WHERE named_model IS NOT NULL AND user_id % 3 <> 0 GROUP BY ALL),
    t AS (SELECT user_id, arg_min(named_model, (-n, named_model)) AS tracked FROM d GROUP BY user_id),
    m AS (SELECT user_id, arg_min(named_model, (ts, event_id)) FILTER (WHERE named_model IS NOT NULL) AS meta FROM log WHERE user_id % 2 = 0 GROUP BY user_id)
    SELECT DISTINCT log.user_id, coalesce(tracked, meta, 'unknown') AS model FROM log LEFT JOIN t USING (user_id) LEFT JOIN m USING (user_id)""")
def conversation_model_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    tracked = windows.dominant(log.filter("named_model IS NOT NULL AND user_id % 3 <> 0"), "user_id", "named_model").select("user_id", F.col("named_model").alias("tracked"))
    at = F.when(F.col("named_model").isNotNull(), F.struct(*ORDER))
    meta = log.filter("user_id % 2 = 0").groupBy("user_id").agg(F.min_by("named_model", at).alias("meta"))
    users = log.select("user_id").distinct()
    return users.join(tracked, "user_id", "left").join(meta, "user_id", "left").select("user_id", F.coalesce("tracked", "meta", F.lit("unknown")).alias("model"))


# --- file operations ---------------------------------------------------------------------------

KIND = "CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'edit' WHEN 'error' THEN 'run' ELSE 'todo' END"
OPERATIONS = f"""{EVENT_LOG}, ops AS (SELECT ['claude','codex','copilot','gemini','grok','deepseek','opencode','cursor','hermes'][user_id % 9 + 1] AS provider, user_id AS session_id, ts, event_id,
    {KIND} AS op, 'file-' || (event_id % 40) AS file_path, amount % 50 AS line_count, amount AS char_count, named_model FROM log),
totals AS (SELECT provider, session_id, sum(CASE WHEN op = 'read' THEN line_count ELSE 0 END)::BIGINT AS read_lines, sum(CASE WHEN op = 'write' THEN line_count ELSE 0 END)::BIGINT AS write_lines,
    sum(CASE WHEN op = 'edit' THEN line_count ELSE 0 END)::BIGINT AS edit_lines, count(*) FILTER (WHERE op = 'read') AS read_calls, count(*) FILTER (WHERE op = 'write') AS write_calls,
    count(*) FILTER (WHERE op = 'edit') AS edit_calls, count(*) FILTER (WHERE op = 'run') AS run_calls, count(*) FILTER (WHERE op = 'todo') AS todo_calls,
    count(DISTINCT file_path) FILTER (WHERE op IN ('read', 'write', 'edit')) AS unique_files, max(ts) AS last_ts FROM ops GROUP BY ALL),
used AS (SELECT DISTINCT session_id, named_model AS model FROM ops WHERE named_model IS NOT NULL),
fanned AS (SELECT * FROM totals JOIN used USING (session_id))"""
COUNTS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in analysis.COUNTERS)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentide.schemas import NAMES

    kind = F.create_map(*[F.lit(x) for pair in (("view", "read"), ("purchase", "write"), ("click", "edit"), ("error", "run"), ("signup", "todo")) for x in pair])
    return event_log(spark, sf_dir).select(
        F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("user_id") % 9 + 1).cast("int")).alias("provider"),
        F.col("user_id").alias("session_id"),
        F.col("ts").alias("ts_ms"),
        kind[F.col("event_type")].alias("op"),
        F.concat(F.lit("file-"), (F.col("event_id") % 40).cast("string")).alias("file_path"),
        (F.col("amount") % 50).alias("line_count"),
        F.col("amount").alias("char_count"),
        F.lit(True).alias("counts_call"),
        "named_model",
    )


def fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    used = ops.filter("named_model IS NOT NULL").select("session_id", F.col("named_model").alias("model"))
    return analysis.fan_out(analysis.session_totals(ops, ["provider", "session_id"]), used, ["session_id"])


@query(f"WITH {OPERATIONS} SELECT provider, session_id, read_lines, write_lines, edit_lines, read_calls, write_calls, edit_calls, run_calls, todo_calls, last_ts FROM totals")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.session_totals(operations(spark, sf_dir), ["provider", "session_id"]).select("provider", "session_id", *analysis.COUNTERS, "last_ts")


@query(f"WITH {OPERATIONS} SELECT provider, session_id, unique_files FROM totals")
def distinct_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.session_totals(operations(spark, sf_dir), ["provider", "session_id"]).select("provider", "session_id", "unique_files")


@query(f"WITH {OPERATIONS} SELECT model, {COUNTS} FROM fanned GROUP BY model")
def analysis_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.by_model(fanned(spark, sf_dir))


@query(f"WITH {OPERATIONS} SELECT provider, {COUNTS} FROM fanned WHERE provider <> 'hermes' GROUP BY ROLLUP (provider)")
def analysis_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.by_provider(fanned(spark, sf_dir))


@query(f"WITH {OPERATIONS} SELECT session_id, model, read_lines, edit_calls FROM fanned")
def analysis_fanout_multi_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanned(spark, sf_dir).select("session_id", "model", "read_lines", "edit_calls")


# --- diagnostics -------------------------------------------------------------------------------

RECORDS = f"""{EVENT_LOG}, records AS (SELECT user_id, event_type = 'error' AS malformed, event_type <> 'error' AND user_id % 11 <> 0 AS recognized,
    event_type IN ('view', 'purchase') AS relevant, event_type = 'view' AND user_id % 5 <> 0 AS normalized FROM log),
counted AS (SELECT user_id, count(*) AS records, count_if(malformed) AS malformed, count_if(recognized) AS recognized, count_if(relevant) AS relevant, count_if(normalized) AS normalized FROM records GROUP BY user_id)"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    records = event_log(spark, sf_dir).select(
        "user_id", (kind == "error").alias("malformed"), ((kind != "error") & (user % 11 != 0)).alias("recognized"), kind.isin("view", "purchase").alias("relevant"), ((kind == "view") & (user % 5 != 0)).alias("normalized")
    )
    return diagnostics.counters(records, ["user_id"])


@query(f"WITH {RECORDS} SELECT user_id, records, malformed::BIGINT AS malformed, recognized::BIGINT AS recognized, relevant::BIGINT AS relevant, normalized::BIGINT AS normalized FROM counted")
def diagnostics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


@query(f"WITH {RECORDS} SELECT user_id, CASE WHEN (records > 0 AND recognized = 0) OR (relevant > 0 AND normalized = 0) THEN 'failed' WHEN malformed > 0 OR normalized < relevant THEN 'partial' ELSE 'ok' END AS verdict FROM counted")
def source_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.verdict(counted(spark, sf_dir)).select("user_id", "verdict")


# --- text, names, JSON, formats ------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN rtrim(coalesce(text, ''), chr(10)) = '' THEN 0 ELSE length(rtrim(text, chr(10))) - length(replace(rtrim(text, chr(10)), chr(10), '')) + 1 END::BIGINT AS lines FROM conversations")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.line_count(F.col("text")).alias("lines"))


@query("SELECT doc_id, length(rtrim(coalesce(text, ''), chr(10)))::BIGINT AS chars FROM documents")
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.char_count(F.col("text")).alias("chars"))


@query("""WITH e AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN repeat(chr(10), (turn % 2)::INT) ELSE text END AS old, text AS new FROM conversations)
    SELECT conv_id, turn, CASE WHEN role <> 'user' AND rtrim(old, chr(10)) = '' AND rtrim(new, chr(10)) <> '' THEN 'write' ELSE 'edit' END AS op FROM e""")
def edit_reclassify(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(F.col("turn") % 3 == 0, F.repeat(F.lit("\n"), (F.col("turn") % 2).cast("int"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.classify_edit(old, F.col("text"), F.col("role") == "user").alias("op"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS path, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/home/u/' ELSE '/srv' END AS folder FROM pages),
    q AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ltrim(path, '/') ELSE path END AS path, folder FROM p)
    SELECT page_id, CASE WHEN starts_with(path, '/') OR folder = '' THEN path ELSE rtrim(folder, '/') || '/' || path END AS path FROM q""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    path = F.when(F.col("page_id") % 2 == 0, F.ltrim(path, F.lit("/"))).otherwise(path)
    folder = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "/home/u/").otherwise("/srv")
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_path(path, folder).alias("path"))


NAMES_SQL = "SELECT p_partkey, lower(p_type) || '/' || replace(p_name, ' ', '-') || CASE p_partkey % 4 WHEN 0 THEN '-20240229' WHEN 1 THEN '-v2.1' WHEN 2 THEN '-v3-20231201' ELSE '-2024' END AS name FROM part"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    suffix = F.when(k == 0, "-20240229").when(k == 1, "-v2.1").when(k == 2, "-v3-20231201").otherwise("-2024")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), suffix).alias("name"))


@query(f"SELECT p_partkey, name, regexp_replace(regexp_replace(name, '^[^/]*/', ''), '(-[0-9]{{8}}|-v[0-9]+(\\.[0-9]+)*)+$', '') AS model FROM ({NAMES_SQL})")
def model_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", "name", models.normalize(F.col("name")).alias("model"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'claude-' || p_size || '-5' ELSE 'gpt-' || p_size || '.5' END AS model FROM part")
def copilot_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "claude-").otherwise("gpt-"), F.col("p_size").cast("string"), F.lit(".5"))
    return table(spark, sf_dir, "part").select("p_partkey", models.canonical_claude(name).alias("model"))


@query("SELECT page_id, CASE WHEN split_part(url, '/', 3) <> '' AND page_id % 3 <> 0 THEN 'https://' || split_part(url, '/', 3) || '/' || page_id ELSE '' END AS repo FROM pages")
def repo_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return table(spark, sf_dir, "pages").select("page_id", text.repo_url(host, F.when(F.col("page_id") % 3 != 0, F.col("page_id").cast("string"))).alias("repo"))


@query("""WITH n AS (SELECT o_orderkey, (round(o_totalprice * 100)::BIGINT - 20000000) * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 0 END + o_orderkey % 1000 AS n FROM orders),
    u AS (SELECT *, abs(n)::DOUBLE AS a FROM n),
    v AS (SELECT *, CASE WHEN a >= 0.9995e12 THEN a / 1e12 WHEN a >= 0.9995e9 THEN a / 1e9 WHEN a >= 0.9995e6 THEN a / 1e6 ELSE a / 1e3 END AS s,
        CASE WHEN a >= 0.9995e12 THEN 'T' WHEN a >= 0.9995e9 THEN 'B' WHEN a >= 0.9995e6 THEN 'M' ELSE 'K' END AS x FROM u)
    SELECT o_orderkey, n, CASE WHEN a < 1000 THEN n::VARCHAR ELSE CASE WHEN n < 0 THEN '-' ELSE '' END
        || CASE WHEN s < 9.995 THEN printf('%.2f', round(s, 2)) WHEN s < 99.95 THEN printf('%.1f', round(s, 1)) ELSE printf('%.0f', round(s)) END || x END AS shown FROM v""")
def format_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    scale = F.when(k == 0, 1).when(k == 1, 1000).when(k == 2, 1000000).otherwise(0).cast("bigint")
    n = (F.round(F.col("o_totalprice") * 100).cast("bigint") - 20000000) * scale + F.col("o_orderkey") % 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).withColumn("shown", formats.compact(F.col("n")))


@query("""WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT - 20000000 AS cents FROM orders)
    SELECT o_orderkey, CASE WHEN cents < 0 THEN '-' ELSE '' END || '$' || format('{:,}', abs(cents) // 100) || '.' || lpad((abs(cents) % 100)::VARCHAR, 2, '0') AS shown FROM c""")
def format_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    usd = (F.round(F.col("o_totalprice") * 100).cast("bigint") - 20000000) / 100
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.cost(usd).alias("shown"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""WITH v AS (SELECT event_id, ('{"k":' || CASE event_id % 4 WHEN 0 THEN (props->>'$.k') WHEN 1 THEN (props->>'$.k') || '.0' WHEN 2 THEN '"' || (props->>'$.k') || '"' ELSE 'null' END || '}')::JSON AS j FROM events)
    SELECT event_id, CASE WHEN json_type(j, '$.k') IN ('UBIGINT', 'BIGINT') THEN (j->>'$.k')::BIGINT END AS k FROM v""")
def json_strict_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers count; 1.0, "1" and null do not."""
    digits = F.try_variant_get(F.parse_json("props"), "$.k", "string")
    i = F.col("event_id") % 4
    shape = F.when(i == 0, digits).when(i == 1, F.concat(digits, F.lit(".0"))).when(i == 2, F.concat(F.lit('"'), digits, F.lit('"'))).otherwise("null")
    body = F.try_parse_json(F.concat(F.lit('{"k":'), shape, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", json.strict_int(body, "$.k").alias("k"))


@query("SELECT p_partkey, 'input_cost_per_token=' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ',tiered_pricing=' || (p_size * 2) ELSE '' END AS kept FROM part")
def cost_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price fields of an entry, in key order."""
    size = F.col("p_size").cast("string")
    entry = F.create_map(F.lit("max_tokens"), size, F.when(F.col("p_partkey") % 2 == 0, "tiered_pricing").otherwise("mode"), (F.col("p_size") * 2).cast("string"), F.lit("input_cost_per_token"), size)
    kept = json.sorted_map(json.cost_fields(entry))
    shown = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("kept"))


@query(f"WITH {REQUESTS} SELECT model, min(session_date) AS first_date, max(session_date) AS last_date, count(DISTINCT session_id) AS sessions FROM requests WHERE NOT contains(model, '<synthetic>') GROUP BY model")
def synthetic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).filter(~models.is_synthetic(F.col("model")))
    return rows.groupBy("model").agg(F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"), F.count_distinct("session_id").alias("sessions"))
