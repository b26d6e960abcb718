"""Token buckets, context tiers and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The disjoint buckets of a request, in export order.
BUCKETS = ["input", "output", "reasoning", "cache_read", "cc_5m", "cc_1h"]

MAX_LEVELS = 16


def active() -> Column:
    """A request with any bucket, total, web search or stored cost that is not zero."""
    return F.expr(" OR ".join(f"coalesce({c}, 0) <> 0" for c in [*BUCKETS, "published_total", "tool_tokens", "web_search", "stored_cost"]))


def split_cache_writes(scalar: Column, five: Column, hour: Column) -> tuple[Column, Column]:
    """(5 minute, 1 hour) cache writes: the total is the scalar or the split's sum, whichever is larger."""
    five, hour = F.coalesce(five, F.lit(0)), F.coalesce(hour, F.lit(0))
    total = F.greatest(F.coalesce(scalar, F.lit(0)), five + hour)
    return total - hour, hour


def tier_level(context: Column, bounds: Column) -> Column:
    """How many boundaries the request's context exceeds; none without boundaries."""
    return F.coalesce(F.size(F.filter(bounds, lambda b: context > b)), F.lit(0)).cast("int")


def ascending_bounds(bounds: Column, most: int = MAX_LEVELS) -> Column:
    """The leading run of boundaries that are not negative and strictly ascend, or null if it is empty."""
    start = F.struct(F.lit(False).alias("stop"), F.expr("cast(array() as array<bigint>)").alias("kept"))

    def step(s: Column, b: Column) -> Column:
        last = F.coalesce(F.try_element_at(s["kept"], F.lit(-1)), F.lit(-1).cast("long"))
        stop = s["stop"] | F.coalesce(b <= last, F.lit(True)) | (F.size(s["kept"]) >= most)
        return F.struct(stop.alias("stop"), F.when(stop, s["kept"]).otherwise(F.concat(s["kept"], F.array(b.cast("long")))).alias("kept"))

    run = F.aggregate(bounds, start, step, lambda s: s["kept"])
    return F.when(F.size(run) > 0, run)


def range_bounds(ranges: Column) -> Column:
    """Boundaries of range rows: one below the first token of every row but the first."""
    starts = F.array_sort(F.transform(ranges, lambda r: r["min_tokens"]))
    return ascending_bounds(F.transform(F.filter(starts, lambda _, i: i > 0), lambda m: m - 1))


def level_prices(base: Column, levels: Column, ranged: Column) -> Column:
    """Effective prices of each level, base first: a price that a level lacks is that of the level below.

    ``base`` and the items of ``levels`` are structs of input, output, reasoning, cache_read, cc_5m
    and cc_1h. Threshold levels bill reasoning as output and take no 1 hour price from below;
    ranged ones inherit both.
    """

    def inherit(below: Column, row: Column) -> Column:
        def price(name: str) -> Column:
            return F.when(row[name] > 0, row[name]).otherwise(below[name]).alias(name)

        reasoning = F.when(~ranged, row["reasoning"] * 0).when(row["reasoning"] > 0, row["reasoning"]).otherwise(below["reasoning"])
        hour = F.when(ranged, below["cc_1h"]).otherwise(row["cc_1h"])
        five = F.when(ranged, below["cc_5m"]).when(row["cc_5m"] > 0, row["cc_5m"]).otherwise(below["cc_5m"])
        return F.struct(price("input"), price("output"), reasoning.alias("reasoning"), price("cache_read"), five.alias("cc_5m"), hour.alias("cc_1h"))

    return F.aggregate(levels, F.array(base), lambda acc, row: F.concat(acc, F.array(inherit(F.element_at(acc, -1), row))))


def price_of(prices: Column, level: Column) -> Column:
    """The level's prices; a level past the last published one bills at that."""
    return F.element_at(prices, F.least(level + 1, F.size(prices)))


def bill(price: Column, tokens: dict[str, Column]) -> Column:
    """Sum of bucket x price; reasoning without a price bills as output, 1 hour writes as 5 minute ones."""
    rate = {b: price[b] for b in BUCKETS}
    rate["reasoning"] = F.when(price["reasoning"] > 0, price["reasoning"]).otherwise(price["output"])
    rate["cc_1h"] = F.when(price["cc_1h"] > 0, price["cc_1h"]).otherwise(price["cc_5m"])
    terms = [F.coalesce(tokens[b], F.lit(0)) * rate[b] for b in BUCKETS]
    return sum(terms[1:], terms[0])


def cost_by_policy(basis: Column, exact: Column, matched: Column, stored: Column, gauge: Column) -> Column:
    """Cost by how a provider is priced: 'stored' takes its own cost unless the key is exact,
    'estimate' nothing, 'gauge' the matched price with cache reads as input, others the matched price."""
    nothing = F.lit(0).cast("bigint")
    return (
        F.when(basis == "stored", F.coalesce(exact, stored, nothing))
        .when(basis == "estimate", F.coalesce(exact, nothing))
        .when(basis == "gauge", F.coalesce(gauge, nothing))
        .otherwise(F.coalesce(matched, nothing))
    )
