"""Usage and pricing queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.functions import times
from tokentide.functions import tokens as t
from tokentide.operators import pricing, usage
from tokentide.operators.windows import largest_remainder, share_of_total
from tokentide.plans.adapters import EVENT_LOG, MODEL_NAMES, PRICES, REQUESTS, event_log, model_names, price_keys, prices, requests
from tokentide.plans.registry import query
from tokentide.streaming import incremental

SUMS = ["input", "output", "reasoning", "cache_read", "web_search"]
SQL_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in SUMS)
TODAY = "2001-05-17"


def sums() -> list[Column]:
    return [F.sum(c).cast("bigint").alias(c) for c in SUMS]


# --- SQL of the price cascade ------------------------------------------------------------------

NORM = "regexp_replace(regexp_replace({}, '^[^/]*/', ''), '(-[0-9]{{8}}|-v[0-9]+(\\.[0-9]+)*)+$', '')"
GAP = "abs(strlen({}) - strlen({}))"
EXACT = "exact AS (SELECT model, model_key FROM models JOIN keys ON model = model_key)"
NORMALIZED = f"""normalized AS (
    SELECT model, arg_min(model_key, (rank, gap, model_key)) AS model_key FROM (
        SELECT model, model_key, CASE WHEN contains(model, '/') AND split_part(model, '/', 1) = split_part(model_key, '/', 1) AND contains(model_key, '/')
                AND regexp_replace(model_key, '^[^/]*/', '') = {NORM.format('model')} THEN 0
            WHEN NOT contains(model_key, '/') AND model_key = {NORM.format('model')} THEN 1 ELSE 2 END AS rank, {GAP.format('model', 'model_key')} AS gap
        FROM models JOIN keys ON {NORM.format('model')} = {NORM.format('model_key')}) GROUP BY model)"""
LOOSE = """loose AS (
    SELECT model, regexp_replace(lower(model), '^[^/]*/', '') AS a, CASE WHEN contains(model, '/') THEN split_part(lower(model), '/', 1) END AS pa FROM models
    WHERE strlen(regexp_replace(lower(model), '^[^/]*/', '')) >= 4 AND regexp_replace(lower(model), '^[^/]*/', '') NOT IN ('default','auto','custom','unknown','none')),
segments AS (SELECT model_key, regexp_replace(lower(model_key), '^[^/]*/', '') AS b, CASE WHEN contains(model_key, '/') THEN split_part(lower(model_key), '/', 1) END AS pb FROM keys)"""
SUBSTRING = f"""substrings AS (
    SELECT model, arg_min(model_key, (-least(strlen(a), strlen(b)), {GAP.format('a', 'b')}, CASE WHEN pa = pb THEN 0 WHEN pb IS NULL THEN 1 ELSE 2 END, model_key)) AS model_key
    FROM loose JOIN segments ON contains(a, b) OR contains(b, a) GROUP BY model)"""
FUZZY = """fuzzy AS (
    SELECT model, arg_min(model_key, (-s, gap, model_key)) AS model_key, max(s) AS s FROM (
        SELECT model, model_key, jaro_winkler_similarity(lower(model), lower(model_key)) AS s, abs(strlen(model) - strlen(model_key)) AS gap FROM loose, segments)
    WHERE s >= 0.7 GROUP BY model)"""



CASCADE = f"""{EXACT}, {NORMALIZED}, {LOOSE}, {SUBSTRING}, {FUZZY},
resolved AS (
    SELECT model, CASE WHEN e.model_key IS NOT NULL THEN 'exact' WHEN n.model_key IS NOT NULL THEN 'normalized' WHEN s.model_key IS NOT NULL THEN 'substring'
            WHEN f.model_key IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS stage,
        coalesce(e.model_key, n.model_key, s.model_key, f.model_key) AS model_key,
        CASE WHEN e.model_key IS NULL THEN coalesce(n.model_key, s.model_key, f.model_key) END AS matched_model
    FROM models LEFT JOIN exact e USING (model) LEFT JOIN normalized n USING (model) LEFT JOIN substrings s USING (model) LEFT JOIN fuzzy f USING (model))"""

# --- roll-ups and costs ------------------------------------------------------------------------


@query(f"WITH {REQUESTS} SELECT model, {SQL_SUMS}, (sum(input) + sum(output) + sum(reasoning) + sum(cache_read))::BIGINT AS total FROM requests GROUP BY model")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.roll_up(requests(spark, sf_dir), ["model"]).select("model", *SUMS, "total")


@query(f"WITH {REQUESTS} SELECT provider, model, {SQL_SUMS}, (sum(input) + sum(output) + sum(reasoning) + sum(cache_read))::BIGINT AS total FROM requests GROUP BY provider, model")
def usage_by_provider_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.roll_up(requests(spark, sf_dir), ["provider", "model"]).select("provider", "model", *SUMS, "total")


@query(f"WITH {REQUESTS} SELECT provider, model, {SQL_SUMS} FROM requests GROUP BY GROUPING SETS ((model), (provider, model))")
def usage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_model_and_provider(requests(spark, sf_dir)).select("provider", "model", *SUMS)


@query(f"WITH {REQUESTS} SELECT provider, {SQL_SUMS}, count(DISTINCT model) AS models FROM requests GROUP BY ROLLUP (provider)")
def usage_totals_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).rollup("provider").agg(*sums(), F.count_distinct("model").alias("models"))


TIERED = f"""{REQUESTS}, {PRICES},
tiered AS (
    SELECT provider, model, CASE WHEN context > bound THEN 1 ELSE 0 END AS tier_level, {SQL_SUMS}, sum(stored)::BIGINT AS stored
    FROM requests LEFT JOIN prices ON {NORM.format("model")} = model_key
    GROUP BY ALL)"""


@query(f"WITH {TIERED} SELECT provider, model, tier_level, input, output, reasoning, cache_read, stored FROM tiered")
def usage_tier_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    tiered = usage.classify(rows, pricing.tier_bounds(rows, prices(spark, sf_dir)))
    summed = usage.roll_up(tiered, ["provider", "model", "tier_level"])
    return summed.select("provider", "model", "tier_level", "input", "output", "reasoning", "cache_read", F.col("stored_cost").alias("stored"))


BILLED = f"""{TIERED}, models AS (SELECT DISTINCT model FROM requests), keys AS (SELECT model_key FROM prices), {CASCADE},
billed AS (
    SELECT provider, model, tier_level, {", ".join(SUMS)}, stored, model_key, stage, matched_model,
        coalesce(input * p_in * (1 + tier_level) + output * p_out * (1 + tier_level) + reasoning * CASE WHEN tier_level = 0 AND p_reason > 0 THEN p_reason ELSE p_out * (1 + tier_level) END
            + cache_read * p_cache * (1 + tier_level) + web_search * query_price, 0) AS nanos,
        coalesce(CASE WHEN p_cache > 0 THEN 0 ELSE cache_read * p_in * (1 + tier_level) END, 0) AS gauge_extra, coalesce(web_search * query_price, 0) AS search_nanos
    FROM tiered JOIN resolved USING (model) LEFT JOIN prices USING (model_key)),
policy AS (
    SELECT provider, model, sum(CASE
            WHEN provider IN ('opencode', 'hermes') THEN CASE WHEN stage = 'exact' THEN nanos ELSE stored END
            WHEN provider = 'cursor' THEN CASE WHEN stage = 'exact' THEN nanos ELSE 0 END
            WHEN provider = 'grok' THEN nanos + gauge_extra ELSE nanos END)::BIGINT AS cost_nanos,
        max(CASE WHEN provider NOT IN ('opencode', 'hermes', 'cursor') THEN matched_model END) AS matched_model, bool_or(stage = 'exact') AS by_key, {SQL_SUMS}
    FROM billed GROUP BY provider, model)"""


def priced(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The library's priced rows; money is whole nano-dollars."""
    return usage.usage(requests(spark, sf_dir) if rows is None else rows, prices(spark, sf_dir))


def nanos(column: str = "cost_usd") -> Column:
    return F.col(column).cast("bigint").alias("cost_nanos")


def whole_nanos(rows: DataFrame, column: str = "cost_nanos") -> DataFrame:
    """Summed money as BIGINT, as the SQL has it; as DECIMAL(38, 0) where a sum passes 64 bits, for which the SQL fails.

    The few summed rows are persisted, so that looking at them costs no second run.
    """
    rows = rows.persist()
    most = rows.agg(F.max(F.abs(column))).first()[0]
    return rows.withColumn(column, F.col(column).cast("bigint" if most is None or most < 2**63 else "decimal(38,0)"))


@query(f"WITH {BILLED} SELECT model, sum(cost_nanos)::BIGINT AS cost_nanos, {SQL_SUMS} FROM policy GROUP BY model")
def usage_priced_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: usage by model, priced by the tier of each request and the policy of its provider."""
    return whole_nanos(usage.summary(usage.merge_providers(priced(spark, sf_dir))).select("model", F.col("cost_usd").alias("cost_nanos"), *SUMS))


@query(f"WITH {BILLED} SELECT provider, model, cost_nanos, matched_model FROM policy")
def cost_source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("provider", "model", nanos(), "matched_model")


@query(f"WITH {BILLED} SELECT model, sum(nanos + gauge_extra)::BIGINT AS gauge_nanos, sum(nanos)::BIGINT AS plain_nanos FROM billed WHERE provider = 'grok' GROUP BY model")
def grok_gauge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Grok's gauges cost, and what the same tokens would under a provider that is billed as listed."""
    rows = requests(spark, sf_dir).filter("provider = 'grok'")
    both = priced(spark, sf_dir, rows.unionByName(rows.withColumn("provider", F.lit("copilot"))))
    of = lambda p: F.sum(F.when(F.col("provider") == p, F.col("cost_usd"))).cast("bigint")
    return both.groupBy("model").agg(of("grok").alias("gauge_nanos"), of("copilot").alias("plain_nanos"))


@query(f"WITH {BILLED} SELECT provider, model, cost_nanos, by_key AS by_tokens FROM policy WHERE provider IN ('opencode', 'hermes')")
def stored_cost_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).filter(F.col("provider").isin("opencode", "hermes"))
    return priced(spark, sf_dir, rows).select("provider", "model", nanos(), F.col("by_key").alias("by_tokens"))


@query(f"WITH {BILLED} SELECT model, sum(search_nanos)::BIGINT AS search_nanos, sum(web_search)::BIGINT AS searches FROM billed WHERE provider = 'claude' GROUP BY model")
def web_search_surcharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of Claude's requests without their tokens: that of their searches."""
    rows = requests(spark, sf_dir).filter("provider = 'claude'").withColumns({b: F.lit(0).cast("bigint") for b in t.BUCKETS})
    return priced(spark, sf_dir, rows).select("model", F.col("cost_usd").cast("bigint").alias("search_nanos"), F.col("web_search").alias("searches"))


@query(f"WITH {BILLED} SELECT regexp_replace(model, '^[^/]*/', '') AS model, sum(cost_nanos)::BIGINT AS cost_nanos, {SQL_SUMS} FROM policy GROUP BY 1")
def base_model_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_nanos(usage.merge_bases(priced(spark, sf_dir)).select("model", F.col("cost_usd").alias("cost_nanos"), *SUMS))


@query(f"""WITH {BILLED} SELECT model, sum(cost_nanos)::BIGINT AS cost_nanos,
    arg_min(matched_model, list_position(['claude','codex','copilot','gemini','deepseek','grok','opencode','cursor','hermes'], provider)) FILTER (WHERE matched_model IS NOT NULL) AS matched_model
    FROM policy GROUP BY model""")
def merged_row_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_nanos(usage.merge_providers(priced(spark, sf_dir)).select("model", F.col("cost_usd").alias("cost_nanos"), "matched_model"))


@query(f"WITH {BILLED} SELECT provider, sum(cost_nanos)::BIGINT AS cost_nanos, {SQL_SUMS} FROM policy GROUP BY ROLLUP (provider)")
def provider_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_nanos(usage.provider_totals(priced(spark, sf_dir)).select("provider", F.col("cost_usd").alias("cost_nanos"), *SUMS))


@query(f"WITH {REQUESTS} SELECT provider, count(DISTINCT session_date) AS days FROM requests WHERE input <> 0 OR output <> 0 OR cache_read <> 0 OR reasoning <> 0 OR web_search <> 0 OR stored <> 0 GROUP BY ROLLUP (provider)")
def active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.active_days(requests(spark, sf_dir))


def _cutoff(spark: SparkSession, sf_dir: str, time_range: str) -> DataFrame:
    rows = requests(spark, sf_dir).filter(times.within(F.col("session_date"), time_range, F.lit(TODAY).cast("date")))
    return rows.groupBy("provider").agg(F.count("*").alias("requests"), F.sum("input").cast("bigint").alias("input"), F.min("session_date").alias("first_date"))


def _cutoff_sql(date: str) -> str:
    return f"WITH {REQUESTS} SELECT provider, count(*) AS requests, sum(input)::BIGINT AS input, min(session_date) AS first_date FROM requests WHERE session_date >= {date} GROUP BY provider"


@query(_cutoff_sql(f"DATE '{TODAY}'"))
def daily_cutoff_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cutoff(spark, sf_dir, "daily")


@query(_cutoff_sql(f"date_trunc('week', DATE '{TODAY}')::DATE"))
def daily_cutoff_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cutoff(spark, sf_dir, "weekly")


@query(_cutoff_sql(f"date_trunc('month', DATE '{TODAY}')::DATE"))
def daily_cutoff_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cutoff(spark, sf_dir, "monthly")


# --- resolving names -------------------------------------------------------------------------

@query(f"WITH {MODEL_NAMES}, {EXACT} SELECT * FROM exact")
def price_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.exact_matches(model_names(spark, sf_dir), price_keys(spark, sf_dir))


@query(f"WITH {MODEL_NAMES}, {NORMALIZED} SELECT * FROM normalized")
def price_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.normalized_matches(model_names(spark, sf_dir), price_keys(spark, sf_dir))


@query(f"WITH {MODEL_NAMES}, {LOOSE}, {SUBSTRING} SELECT * FROM substrings")
def price_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.substring_matches(model_names(spark, sf_dir), price_keys(spark, sf_dir))


@query(f"WITH {MODEL_NAMES}, {LOOSE}, {FUZZY} SELECT model, model_key, round(s, 12) AS similarity FROM fuzzy")
def price_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.fuzzy_matches(model_names(spark, sf_dir), price_keys(spark, sf_dir)).withColumn("similarity", F.round("similarity", 12))


@query(f"WITH {MODEL_NAMES}, {CASCADE} SELECT model, stage, model_key, matched_model FROM resolved")
def price_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.resolve_models(model_names(spark, sf_dir), price_keys(spark, sf_dir))


# --- shares, top lists, sets ------------------------------------------------------------------


@query(f"WITH {REQUESTS}, s AS (SELECT provider, sum(input)::BIGINT AS input FROM requests GROUP BY provider) SELECT provider, input, round(input / (SELECT sum(input) FROM s), 9) AS share FROM s")
def share_of_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = requests(spark, sf_dir).groupBy("provider").agg(F.sum("input").cast("bigint").alias("input"))
    return share_of_total(totals, "input").withColumn("share", F.round("share", 9))


@query(f"""WITH {REQUESTS}, s AS (SELECT provider, model, sum(input)::BIGINT AS input FROM requests GROUP BY ALL),
    f AS (SELECT *, sum(input) OVER (PARTITION BY provider) AS t FROM s),
    g AS (SELECT provider, model, input, (input * 100 // t)::BIGINT AS whole, input * 100 - (input * 100 // t) * t AS frac FROM f),
    h AS (SELECT *, 100 - sum(whole) OVER (PARTITION BY provider) AS spare, row_number() OVER (PARTITION BY provider ORDER BY frac DESC, model) AS place FROM g)
    SELECT provider, model, input, (whole + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS percent FROM h""")
def largest_remainder_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = requests(spark, sf_dir).groupBy("provider", "model").agg(F.sum("input").cast("bigint").alias("input"))
    return largest_remainder(totals, ["provider"], "input", 100, "model", "percent")


@query(f"WITH {EVENT_LOG} SELECT event_id, ts, user_id FROM log ORDER BY ts DESC, event_id DESC LIMIT 64")
def topn_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 newest sources: the limit is the feature."""
    return event_log(spark, sf_dir).select("event_id", "ts", "user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(64)


@query(f"""WITH {REQUESTS}, b AS (SELECT provider, model, sum(input) AS x FROM requests WHERE session_date < DATE '{TODAY}' GROUP BY ALL),
    a AS (SELECT provider, model, sum(input) AS x FROM requests GROUP BY ALL)
    SELECT a.provider, a.model FROM a LEFT JOIN b USING (provider, model) WHERE b.x IS NULL OR b.x <> a.x""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tokentide.operators.pairing import changed_rows

    rows = requests(spark, sf_dir)
    before, after = (r.groupBy("provider", "model").agg(F.sum("input").alias("x")) for r in (rows.filter(F.col("session_date") < F.lit(TODAY).cast("date")), rows))
    return changed_rows(before, after, ["provider", "model"], ["x"])


@query(f"WITH {REQUESTS} SELECT provider, session_id, model, input FROM requests WHERE provider = 'claude' UNION ALL SELECT provider, session_id, model, input FROM requests WHERE provider = 'codex'")
def provider_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).select("provider", "session_id", "model", "input")
    return rows.filter("provider = 'claude'").unionByName(rows.filter("provider = 'codex'"))


@query(f"WITH {REQUESTS} SELECT count(*) AS days, min(d) AS first_day, max(d) AS last_day FROM (SELECT session_date AS d FROM requests WHERE provider = 'claude' UNION SELECT session_date FROM requests WHERE provider = 'hermes')")
def date_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir)
    days = rows.filter("provider = 'claude'").select("session_date").unionByName(rows.filter("provider = 'hermes'").select("session_date")).distinct()
    return days.agg(F.count("*").alias("days"), F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day"))


@query(f"""WITH {REQUESTS}, versions AS (SELECT session_id::VARCHAR AS path, max(session_date)::TIMESTAMP AS modified, count(*) AS length, session_date < DATE '{TODAY}' AS old FROM requests GROUP BY ALL)
    SELECT path, modified, length FROM versions WHERE NOT old OR old EXCEPT SELECT path, modified, length FROM versions WHERE old""")
def cache_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose version the refresh of an earlier day lacks."""
    old = (F.col("session_date") < F.lit(TODAY).cast("date")).alias("old")
    version = requests(spark, sf_dir).groupBy(F.col("session_id").cast("string").alias("path"), old)
    version = version.agg(F.max("session_date").cast("timestamp_ntz").alias("modified"), F.count("*").alias("length"))
    return incremental.pending(version, version.filter("old")).select("path", "modified", "length").distinct()


@query(f"WITH {PRICES}, ranges AS (SELECT model_key, unnest([0, bound, bound * 2, bound]) AS start FROM prices) SELECT model_key, list_sort(list_distinct(list(start - 1) FILTER (WHERE start > 0))) AS bounds FROM ranges GROUP BY model_key")
def threshold_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of price ranges, those that repeat once."""
    bound = F.col("bounds")[0]
    starts = F.array_distinct(F.array(F.lit(0).cast("bigint"), bound, bound * 2, bound))
    ranges = F.transform(starts, lambda x: F.struct(x.alias("min_tokens")))
    return prices(spark, sf_dir).select("model_key", t.range_bounds(ranges).alias("bounds"))
