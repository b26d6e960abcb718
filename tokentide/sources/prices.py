"""Price lists: a JSON document of model -> rates, as the PRICES relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.functions import tokens
from tokentide.functions.json import cost_fields

#: Rate -> the field that holds it. Fixed values.
FIELDS = {
    "input": "input_cost_per_token",
    "output": "output_cost_per_token",
    "reasoning": "output_cost_per_reasoning_token",
    "cache_read": "cache_read_input_token_cost",
    "cc_5m": "cache_creation_input_token_cost",
    "cc_1h": "cache_creation_input_token_cost_above_1hr",
}
#: Sizes of a web search, the first that is priced counts. Fixed values.
SEARCH_SIZES = ["medium", "low", "high"]


def _rate(entry: Column, field: str) -> Column:
    """A finite rate that is not negative, else null."""
    x = F.try_variant_get(entry, f"$.{field}", "double")
    return F.when((x >= 0) & (x < float("inf")), x)


def _rates(entry: Column) -> Column:
    return F.struct(*[F.coalesce(_rate(entry, field), F.lit(0.0)).alias(name) for name, field in FIELDS.items()])


def parse_prices(entries: DataFrame) -> DataFrame:
    """``entries`` (model_key, v variant) -> PRICES; models without any positive rate are left out.

    Keys ``<field>_above_<N>k_tokens`` make a level above N thousand tokens; fields that a level lacks take
    the base's. ``tiered_pricing`` rows replace them: their first is the base and each later one starts
    where its range does.
    """
    v = F.col("v")
    fields = F.map_keys(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")))
    ks = F.transform(fields, lambda k: F.nullif(F.regexp_extract(k, r"_above_([0-9]+)k_tokens$", 1), F.lit("")))
    thresholds = F.array_sort(F.array_distinct(F.transform(F.filter(ks, lambda k: k.isNotNull()), lambda k: k.cast("long"))))
    ranges = F.filter(F.coalesce(F.try_variant_get(v, "$.tiered_pricing", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda r: F.try_variant_get(r, "$.range[0]", "double").isNotNull())
    ranges = F.array_sort(F.transform(ranges, lambda r: F.struct(F.try_variant_get(r, "$.range[0]", "double").cast("long").alias("min_tokens"), _rates(r).alias("rates"))))
    rows = entries.select("model_key", "v", _rates(v).alias("base"), thresholds.alias("ks"), ranges.alias("rs"))
    rows = rows.withColumn("level", F.explode_outer("ks"))
    # the level's fields are named by its threshold, so each is looked up by a path built from the row
    at = lambda name, field: F.expr(f"try_variant_get(v, concat('$.{field}_above_', level, 'k_tokens'), 'double')")
    own = F.struct(*[F.coalesce(at(n, f), F.lit(0.0) if n in ("reasoning", "cc_1h") else F.col("base")[n]).alias(n) for n, f in FIELDS.items()])
    search = F.coalesce(*[F.try_variant_get(F.col("v"), f"$.search_context_cost_per_query.search_context_size_{s}", "double") for s in SEARCH_SIZES], F.lit(0.0))
    leveled = rows.select("model_key", "base", "rs", search.alias("web_search"), "level", F.when(F.col("level").isNotNull(), F.struct("level", own.alias("rates"))).alias("l"))
    keyed = leveled.groupBy("model_key").agg(F.first("base").alias("base"), F.first("rs").alias("rs"), F.first("web_search").alias("web_search"), F.array_sort(F.collect_list("l")).alias("ls"))
    ranged = F.size("rs") > 0
    levels = F.when(ranged, F.transform(F.slice("rs", 2, tokens.MAX_LEVELS), lambda r: r["rates"])).otherwise(F.transform("ls", lambda x: x["rates"]))
    bounds = F.when(ranged, tokens.range_bounds(F.col("rs"))).otherwise(tokens.ascending_bounds(F.transform("ls", lambda x: x["level"] * 1000)))
    base = F.when(ranged, F.col("rs")[0]["rates"]).otherwise(F.col("base"))
    out = keyed.select("model_key", base.alias("base"), levels.alias("levels"), ranged.alias("ranged"), bounds.alias("bounds"), "web_search")
    some = " OR ".join([*[f"base.{n} > 0" for n in FIELDS], "web_search > 0", "size(levels) > 0"])
    return out.filter(some)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(model_key, v) of a JSON file. A few thousand entries at most, so one row holds the document."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("model_key", "v"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The price list in a JSON file."""
    return parse_prices(_entries(spark, path))


def save_prices(spark: SparkSession, path: str, folder: str, day: str) -> None:
    """Keep the cost fields of the price list at ``path`` as ``folder``/day=<day>, and no other day's.

    Days are written whole before older ones go, so a reader finds a list at any time.
    """
    entries = _entries(spark, path)
    costs = F.to_json(cost_fields(F.try_variant_get("v", "$", "map<string,variant>")))
    entries.select("model_key", costs.alias("costs")).filter("costs <> '{}'").write.mode("overwrite").parquet(f"{folder}/day={day}")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for kept in files.listStatus(root):
        if kept.getPath().getName() != f"day={day}":
            files.delete(kept.getPath(), True)


def saved_prices(spark: SparkSession, folder: str) -> DataFrame:
    """PRICES of the list that save_prices kept."""
    kept = spark.read.parquet(folder)
    return parse_prices(kept.select("model_key", F.try_parse_json("costs").alias("v")))
