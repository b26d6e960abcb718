"""The driver's tables as the library's relations, requests, prices and an event log, each with its SQL twin.

Money in registered queries is integer nano-dollars, so both engines sum it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.schemas import NAMES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per line item: the brand (with the type as prefix on even lines) is its model."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    names = F.array(*[F.lit(n) for n in NAMES])
    return items.select(
        F.element_at(names, (F.col("l_suppkey") % 9 + 1).cast("int")).alias("provider"),
        F.col("l_orderkey").alias("session_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lower("p_type"), F.lit("/"), brand)).otherwise(brand).alias("model"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("input"),
        (F.col("l_linenumber") * 100).cast("bigint").alias("output"),
        (hundredths("l_tax") * 10).alias("reasoning"),
        (hundredths("l_discount") * 4000).alias("cache_read"),
        F.lit(0).cast("bigint").alias("cc_5m"),
        F.lit(0).cast("bigint").alias("cc_1h"),
        (F.col("l_linenumber") % 3).cast("bigint").alias("web_search"),
        F.lit(0).cast("bigint").alias("tool_tokens"),
        F.lit(None).cast("bigint").alias("published_total"),
        (F.col("l_quantity").cast("bigint") * 1000 + hundredths("l_discount") * 4000).alias("request_context"),
        (hundredths("l_extendedprice") * 10_000_000).alias("stored_cost"),
        F.to_date("l_shipdate").alias("session_date"),
    )


REQUESTS = """requests AS (
    SELECT ['claude','codex','copilot','gemini','grok','deepseek','opencode','cursor','hermes'][l_suppkey % 9 + 1] AS provider, l_orderkey AS session_id,
        CASE WHEN l_linenumber % 2 = 0 THEN lower(p_type) || '/' ELSE '' END || lower(replace(p_brand, '#', '-')) AS model,
        l_quantity::BIGINT * 1000 AS input, l_linenumber::BIGINT * 100 AS output, round(l_tax * 100)::BIGINT * 10 AS reasoning,
        round(l_discount * 100)::BIGINT * 4000 AS cache_read, 0::BIGINT AS cc_5m, 0::BIGINT AS cc_1h, (l_linenumber % 3)::BIGINT AS web_search,
        l_quantity::BIGINT * 1000 + round(l_discount * 100)::BIGINT * 4000 AS context, round(l_extendedprice * 100)::BIGINT * 10000000 AS stored,
        l_shipdate::DATE AS session_date
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price row per brand of even number: base rates and one level above a boundary."""
    k = F.col("k")
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.min("p_size").cast("bigint").alias("z"))
    rows = rows.filter(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int") % 4 != 3)

    def rates(factor: int) -> Column:
        return F.struct(
            (k * 7 % 900 + 100).cast("bigint").__mul__(factor).alias("input"),
            ((k * 7 % 900 + 100) * 5 * factor).alias("output"),
            F.when(k % 2 == 0, (k * 7 % 900 + 100) * 3 * factor).otherwise(F.lit(0)).cast("bigint").alias("reasoning"),
            F.when(k % 3 == 0, F.lit(0)).otherwise(k % 50 + 10).cast("bigint").__mul__(factor).alias("cache_read"),
            F.lit(0).cast("bigint").alias("cc_5m"),
            F.lit(0).cast("bigint").alias("cc_1h"),
        )

    return rows.select(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("model_key"),
        rates(1).alias("base"),
        F.array(rates(2)).alias("levels"),
        F.lit(False).alias("ranged"),
        F.array(F.col("z") * 500 + 30000).alias("bounds"),
        (k % 10 * 1000).alias("web_search"),
    )


PRICES = """prices AS (
    SELECT lower(replace(p_brand, '#', '-')) AS model_key, k * 7 % 900 + 100 AS p_in, (k * 7 % 900 + 100) * 5 AS p_out,
        CASE WHEN k % 2 = 0 THEN (k * 7 % 900 + 100) * 3 ELSE 0 END AS p_reason, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 50 + 10 END AS p_cache,
        z * 500 + 30000 AS bound, k % 10 * 1000 AS query_price
    FROM (SELECT p_brand, min(p_partkey) AS k, min(p_size)::BIGINT AS z FROM part GROUP BY p_brand)
    WHERE regexp_extract(p_brand, '([0-9]+)$', 1)::INT % 4 <> 3)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log per user: a cumulative counter, and a model that only signups name."""
    from pyspark.sql.window import Window

    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amount = F.round(F.col("value") * 100).cast("bigint")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props", amount.alias("amount"))
    counter = F.sum("amount").over(so_far)
    model = F.when(F.col("event_type") == "signup", F.concat(F.lit("model-"), (F.col("event_id") % 5).cast("string")))
    return events.withColumn("counter", counter).withColumn("named_model", model)


EVENT_LOG = """log AS (
    SELECT event_id, ts, user_id, event_type, props, round(value * 100)::BIGINT AS amount,
        (sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS counter,
        CASE WHEN event_type = 'signup' THEN 'model-' || (event_id % 5) END AS named_model
    FROM events)"""


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to resolve: part names as they are, versioned, dated under a provider, extended and misspelt."""
    base = F.replace("p_name", F.lit(" "), F.lit("-"))
    shapes = [
        base,
        F.concat(base, F.lit("-v"), (F.col("p_size") % 3 + 1).cast("string")),
        F.concat(F.lit("acme/"), base, F.lit("-20240101")),
        F.concat(base, F.lit("-turbo")),
        F.concat(F.substring(base, 1, 3), F.lit("q"), F.substring(base, 4, 100)),
    ]
    pick = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        pick = F.when(F.col("p_partkey") % 5 == i, s).otherwise(pick)
    return table(spark, sf_dir, "part").select(pick.alias("model")).distinct()


def price_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.replace("p_name", F.lit(" "), F.lit("-"))
    rows = table(spark, sf_dir, "part").groupBy(base.alias("name")).agg(F.min("p_partkey").alias("k"))
    key = F.when(F.col("k") % 3 == 0, F.concat(F.lit("acme/"), F.col("name"))).otherwise(F.col("name"))
    return rows.filter("k % 4 <> 3").select(key.alias("model_key"))


MODEL_NAMES = """models AS (
    SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN b WHEN 1 THEN b || '-v' || (p_size % 3 + 1) WHEN 2 THEN 'acme/' || b || '-20240101'
        WHEN 3 THEN b || '-turbo' ELSE b[1:3] || 'q' || b[4:] END AS model
    FROM (SELECT *, replace(p_name, ' ', '-') AS b FROM part)),
keys AS (
    SELECT CASE WHEN k % 3 = 0 THEN 'acme/' ELSE '' END || name AS model_key
    FROM (SELECT replace(p_name, ' ', '-') AS name, min(p_partkey) AS k FROM part GROUP BY 1) WHERE k % 4 <> 3)"""
