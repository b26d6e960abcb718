"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each source's target repetition rate is (its weight's share x the wanted size) / its rows. A
document's number of copies inverts the Poisson distribution of that mean at a uniform value
hashed from (seed, id), so a re-run or a retried task draws the same corpus.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentide.llm.scratch import written


def _hex(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 as a double in [0, 1)."""
    return F.conv(F.substring(_hex(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _log_factorial(k: Column) -> Column:
    """ln k!, by Stirling's series ten places on, where it is exact to a double."""
    n = k + F.lit(10.0)
    series = n * F.ln(n) - n + 0.5 * F.ln(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)
    return series - F.ln(reduce(Column.__mul__, [k + F.lit(float(j)) for j in range(1, 11)]))


def _log_probability(k: Column, rate: Column) -> Column:
    """Of k copies. From 30 on, k ln(rate / k) + k - rate is taken whole, as its parts are large and nearly cancel."""
    tail = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)
    large = k * F.log1p((rate - k) / k) + (k - rate) - 0.5 * F.ln(2 * math.pi * k) - tail
    return F.when(k >= 30, large).otherwise(k * F.ln(rate) - rate - _log_factorial(k))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """``rates`` (__source, rate) with ``least`` and ``cdf``: the cumulative probabilities of ``least``, ``least`` + 1, ... copies,
    from twelve deviations below the rate to as many above, beyond which a double tells them from neither 0 nor 1.

    Each source's numbers of copies are rows, so a table of a large rate costs their sum, not its square.
    """
    rate = F.col("rate")
    reach = 12 * F.sqrt(rate) + 40
    ks = rates.withColumn("least", F.greatest(F.floor(rate - reach), F.lit(0)).cast("long")).withColumn("k", F.explode(F.sequence(F.col("least"), F.ceil(rate + reach).cast("long"))))
    k = F.col("k").cast("double")
    p = F.when(rate > 0, F.exp(_log_probability(k, rate))).otherwise((F.col("k") == 0).cast("double"))
    upto = F.sum("p").over(Window.partitionBy("__source").orderBy("k"))
    table = ks.withColumn("p", p).withColumn("upto", upto).groupBy("__source", "rate", "least")
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "upto"))), lambda x: x["upto"]).alias("cdf"))


def copies_of(draw: Column, least: str = "least", cdf: str = "cdf") -> Column:
    """The number of copies at a uniform draw: how many of ``cdf`` it has reached, found by halves, and ``least``."""
    size = F.size(cdf)
    state = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        reached = (s["low"] < s["high"]) & (F.get(F.col(cdf), middle) <= draw)
        return F.struct(F.when(reached, middle + 1).otherwise(s["low"]).alias("low"), F.when(reached | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    return F.col(least) + F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int")), state, halve, lambda s: s["low"])


def source_rates(docs: DataFrame, weights: DataFrame | None, source_col: str, size: float) -> DataFrame:
    """One row per source: ``rate``, and ``least`` and ``cdf`` of its number of copies.

    ``size`` is the wanted corpus as a multiple of the input rows.
    """
    counts = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("__n"))
    if weights is None:
        weighed = counts.withColumn("__weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("__of")).agg(F.max(F.col("weight").cast("double")).alias("__weight"))
        weighed = counts.join(given, counts["__source"].eqNullSafe(given["__of"]), "left").drop("__of").fillna(0.0, ["__weight"])
    weighed = written(weighed, "source-weights")
    total = weighed.agg(F.sum("__n").alias("n"), F.sum("__weight").alias("w")).first()
    per_weight = float(size) * total["n"] / total["w"] if total["w"] else 0.0
    rates = weighed.select("__source", (F.col("__weight") * F.lit(per_weight) / F.col("__n")).alias("rate"))
    return poisson_tables(rates)


#: Beyond this many numbers in all tables the rates are joined by shuffle, over salted copies.
BROADCAST_ENTRIES = 2_000_000
SALTS = 64


def with_rates(docs: DataFrame, rates: DataFrame, id_col: str, source_col: str, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Join the rates on, with ``__least`` and ``__cdf``. A source may hold a third of all rows, so rows are never dealt by source alone."""
    rates = written(rates.withColumnsRenamed({"least": "__least", "cdf": "__cdf"}), "source-rates")
    if (rates.agg(F.sum(F.size("__cdf") + 4)).first()[0] or 0) <= broadcast_entries:
        return docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("__source")), "left").drop("__source")
    salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = docs.withColumn("__slot", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
    same = rows[source_col].eqNullSafe(salted["__source"]) & (rows["__slot"] == salted["__salt"])
    return rows.join(salted, same, "left").drop("__source", "__salt", "__slot")


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """Copies of ``docs`` whose sources have the target shares, in a hashed global order.

    ``weights`` (source, weight) gives target shares up to a factor; sources it lacks get none,
    and None means equal shares. Added columns: ``rate`` (mean copies), ``copy`` (from 0) and
    ``shuffle_key``, a hash by whose ranges the rows are dealt to partitions and by which they are
    sorted in each, so that the partitions in order are the whole in order.

    Cases: a null source is a source of its own. A null id draws one value for all such rows.
    Rows repeating an id draw the same number of copies and have equal keys; their order is not
    set. No rows give no rows. Text of any length is untouched, nulls included. Weights that are
    null, or all zero, count as zero and give no copies. Columns that bear the added names are
    replaced; names that begin with two underscores are reserved.
    """
    rates = source_rates(docs, weights, source_col, size)
    rows = (
        with_rates(docs.drop("rate", "copy", "shuffle_key"), rates, id_col, source_col)
        .withColumn("__copies", copies_of(hashed_uniform(seed, F.col(id_col)), "__least", "__cdf"))
        .filter(F.col("__copies") > 0)
        .drop("__cdf", "__least")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("__copies") - 1).cast("int"))))
        .drop("__copies")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("shuffle_key", _hex(seed + 1, F.col(id_col), F.col("copy")))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * parts).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("shuffle_key")
