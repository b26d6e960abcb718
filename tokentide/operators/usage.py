"""Usage: classify requests by context tier, roll up, price, and show.

The tier is a property of a request, so it is set before anything is summed. Sums keep it as a
group key, and prices meet the few summed rows, not the requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tokentide.functions import tokens as t
from tokentide.functions.models import is_synthetic, without_provider
from tokentide.operators.pricing import resolve_models, tier_bounds
from tokentide.schemas import MATCH_ORDER, PROVIDERS

SUMS = [*t.BUCKETS, "web_search", "tool_tokens"]


def classify(requests: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds ``tier_level``: how many of its model's boundaries the request's context exceeds."""
    return requests.join(bounds, "model", "left").withColumn("tier_level", t.tier_level(F.col("request_context"), F.col("bounds"))).drop("bounds")


def derived_total() -> Column:
    return sum((F.coalesce(F.col(b), F.lit(0)) for b in [*t.BUCKETS, "tool_tokens"]), F.lit(0).cast("bigint"))


def exact(rows: DataFrame, column: str) -> Column:
    """Integer money as decimals, whose sums and products do not end at 64 bits; other types as they are."""
    return F.col(column).cast("decimal(20,0)") if isinstance(rows.schema[column].dataType, IntegralType) else F.col(column)


def real(requests: DataFrame) -> DataFrame:
    """Claude and Codex name some models synthetic; those are no usage."""
    named = F.col("provider").isin("claude", "codex") & is_synthetic(F.col("model"))
    return requests.filter(~F.coalesce(named, F.lit(False)))


def roll_up(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the buckets by keys; ``total`` is the published total of Codex, else the larger of the
    summed published and the summed derived ones."""
    nested = F.col("provider") == "codex"
    sums = [F.sum(c).cast("bigint").alias(c) for c in SUMS]
    parts = real(requests).groupBy(*keys).agg(
        *sums,
        F.sum(exact(requests, "stored_cost")).alias("stored_cost"),
        F.sum(F.when(nested, F.coalesce("published_total", derived_total()))).alias("__codex"),
        F.sum(F.when(~nested, F.col("published_total"))).alias("__published"),
        F.sum(F.when(~nested, derived_total())).alias("__derived"),
    )
    total = F.coalesce("__codex", F.lit(0)) + F.coalesce(F.greatest("__published", "__derived"), F.lit(0))
    return parts.withColumn("total", total.cast("bigint")).drop("__codex", "__published", "__derived")


def by_model_and_provider(requests: DataFrame) -> DataFrame:
    """Both views in one pass: provider null is the view by model."""
    return real(requests).groupingSets([["model"], ["provider", "model"]], "provider", "model").agg(
        F.grouping("provider").alias("all_providers"), *[F.sum(c).cast("bigint").alias(c) for c in SUMS]
    )


def active_days(requests: DataFrame) -> DataFrame:
    """Distinct dates with activity, per provider and over all (provider null)."""
    return requests.filter(t.active()).rollup("provider").agg(F.count_distinct("session_date").alias("days"))


def price(summed: DataFrame, prices: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Cost of (provider, model): its tier slices billed at their levels, by the provider's policy.

    ``summed``: roll_up by provider, model, tier_level. ``resolved``: resolve_models of its models,
    if it is there already. ``by_key`` tells whether the model is a key of the price list. Money that
    comes as integers is billed and summed as decimals.
    """
    basis = F.create_map(*[F.lit(x) for p in PROVIDERS for x in (p[0], p[3])])
    resolved = resolve_models(summed.select("model"), prices) if resolved is None else resolved
    leveled = prices.select("model_key", t.level_prices(F.col("base"), F.col("levels"), F.col("ranged")).alias("prices"), F.col("web_search").alias("query_price"))
    found = summed.join(resolved, "model", "left").join(leveled, "model_key", "left")
    at = t.price_of(F.col("prices"), F.col("tier_level"))
    slices = {b: exact(found, b) for b in t.BUCKETS}
    searches = F.coalesce(exact(found, "web_search"), F.lit(0)) * F.coalesce("query_price", F.lit(0))
    billed = t.bill(at, slices) + searches
    gauged = billed + F.when(at["cache_read"] > 0, F.lit(0)).otherwise(slices["cache_read"] * at["input"])
    cost_basis = basis[F.col("provider")]
    keyed = F.coalesce(F.col("stage") == "exact", F.lit(False))
    amount = t.cost_by_policy(cost_basis, F.when(keyed, billed), billed, F.lit(0), gauged)
    stored = (cost_basis == "stored") & ~keyed
    by_name = cost_basis.isin("lookup", "gauge")
    cost = F.when(stored, F.coalesce("stored_cost", F.lit(0))).otherwise(amount).alias("cost_usd")
    rows = found.select("provider", "model", *SUMS, "total", cost, F.when(by_name, F.col("matched_model")).alias("matched_model"), keyed.alias("by_key"))
    return rows.groupBy("provider", "model").agg(*[F.sum(c).alias(c) for c in [*SUMS, "total", "cost_usd"]], F.max("matched_model").alias("matched_model"), F.bool_or("by_key").alias("by_key"))


def merge_providers(priced: DataFrame) -> DataFrame:
    """One row per model: sums over providers; the matched model is the first provider's that has one."""
    rank = F.array_position(F.array(*[F.lit(p) for p in MATCH_ORDER]), F.col("provider"))
    first = F.min_by("matched_model", F.when(F.col("matched_model").isNotNull(), rank)).alias("matched_model")
    return priced.groupBy("model").agg(*[F.sum(c).alias(c) for c in [*SUMS, "total", "cost_usd"]], first)


def merge_bases(priced: DataFrame) -> DataFrame:
    """Models that differ only by provider prefix as one row, with the costs already found."""
    return priced.groupBy(without_provider(F.col("model")).alias("model")).agg(*[F.sum(c).alias(c) for c in [*SUMS, "total", "cost_usd"]])


def provider_totals(priced: DataFrame) -> DataFrame:
    """Sums of priced rows per provider and over all (provider null)."""
    return priced.rollup("provider").agg(*[F.sum(c).alias(c) for c in [*SUMS, "total", "cost_usd"]])


def summary(priced: DataFrame, hide_zero: bool = False) -> DataFrame:
    rows = priced.filter((F.col("total") != 0) | (F.col("cost_usd") != 0)) if hide_zero else priced
    return rows.orderBy("cost_usd", "model")


def usage(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced rows by provider and model, from requests to cost.

    Prices and boundaries are looked up by distinct name. The names, few next to the requests, and
    the price list are persisted, as several joins read them; what is lost is found again.
    """
    names, prices = requests.select("model").distinct().persist(), prices.persist()
    tiered = classify(requests, tier_bounds(names, prices))
    return price(roll_up(tiered, ["provider", "model", "tier_level"]), prices, resolve_models(names, prices))
