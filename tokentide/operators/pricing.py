"""Resolving model names against a price list.

Distinct models are resolved once: by one equi join of normalized names, which finds exact keys
too, and, for the names that it leaves, by comparing each with every price key. No equi join can
express that, so keys are dealt to blocks and every name is sent to every block once: the pairs
are those of the few names left and the keys, whatever the size of the usage, and blocks are
joined and spread as any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.functions import models as m
from tokentide.functions.similarity import jaro_winkler_similarity

THRESHOLD = 0.7
#: Blocks of price keys.
BLOCKS = 16


def _best(candidates: DataFrame, order: list[Column], extra: list[str] = ()) -> DataFrame:
    """The candidate of each model that is first by ``order``."""
    named = [F.struct("model_key", *extra).alias("found"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("rank")]
    return candidates.select("model", *named).groupBy("model").agg(F.min_by("found", "rank").alias("found")).select("model", "found.*")


def length_gap(a: Column, b: Column) -> Column:
    return F.abs(F.octet_length(a) - F.octet_length(b))


def exact_matches(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, model_key) for verbatim keys."""
    return models.join(prices.select("model_key"), F.col("model") == F.col("model_key")).select("model", "model_key")


def _equal(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, model_key) of equal normalized names, as candidates."""
    left = models.select("model", m.normalize(F.col("model")).alias("norm"))
    return left.join(prices.select("model_key", m.normalize(F.col("model_key")).alias("norm")), "norm")


def _normalized_order() -> list[Column]:
    """Same provider and base first, then bare base, then others; then the nearest length, then the key."""
    mine, theirs = m.provider_prefix(F.col("model")), m.provider_prefix(F.col("model_key"))
    same = mine.isNotNull() & mine.eqNullSafe(theirs) & (m.without_provider(F.col("model_key")) == F.col("norm"))
    bare = theirs.isNull() & (F.col("model_key") == F.col("norm"))
    return [F.when(same, 0).when(bare, 1).otherwise(2), length_gap(F.col("model"), F.col("model_key")), F.col("model_key")]


def normalized_matches(models: DataFrame, prices: DataFrame) -> DataFrame:
    """The best key of equal normalized name."""
    return _best(_equal(models, prices), _normalized_order())


def _pairs(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Every distinctive name with every price key, block by block: lower-cased names, their segments and prefixes."""
    named = models.filter(m.loosely_matchable(F.col("model"))).select("model", F.lower("model").alias("x"))
    left = named.select("*", m.without_provider(F.col("x")).alias("a"), m.provider_prefix(F.col("x")).alias("pa"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    keys = prices.select("model_key", F.lower("model_key").alias("y"), F.pmod(F.hash("model_key"), F.lit(BLOCKS)).alias("block"))
    return left.join(keys.select("*", m.without_provider(F.col("y")).alias("b"), m.provider_prefix(F.col("y")).alias("pb")), "block")


def _contained() -> Column:
    return (F.col("b") != "") & (F.contains("a", "b") | F.contains("b", "a"))


def _substring_order() -> list[Column]:
    """Largest overlap first, then nearest length, same provider, bare key, key order."""
    provider = F.when(F.col("pa").isNotNull() & (F.col("pa") == F.col("pb")), 0).when(F.col("pb").isNull(), 1).otherwise(2)
    return [-F.least(F.octet_length("a"), F.octet_length("b")), length_gap(F.col("a"), F.col("b")), provider, F.col("model_key")]


def substring_matches(models: DataFrame, prices: DataFrame) -> DataFrame:
    """The best key that contains the model's segment or is contained in it."""
    return _best(_pairs(models, prices).filter(_contained()), _substring_order())


def fuzzy_matches(models: DataFrame, prices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Keys of Jaro-Winkler similarity of at least ``threshold`` on lower-cased names: the most similar
    first, then the nearest length, then the key. Adds ``similarity``."""
    met = _pairs(models, prices).withColumn("similarity", jaro_winkler_similarity("x", "y")).filter(F.col("similarity") >= threshold)
    return _best(met, [-F.col("similarity"), length_gap(F.col("x"), F.col("y")), F.col("model_key")], ["similarity"])


def resolve_models(models: DataFrame, prices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(model, stage, model_key, matched_model) of every distinct model, by the first stage that finds a key:
    'exact', 'normalized', 'substring', 'fuzzy' or 'none'. ``matched_model`` is null for exact keys and without a key."""
    names, prices = models.select("model").distinct().persist(), prices.select("model_key").persist()
    exact = F.col("model") == F.col("model_key")
    equal = _equal(names, prices).withColumn("stage", F.when(exact, "exact").otherwise("normalized"))
    found = names.join(_best(equal, [(~exact).cast("int"), *_normalized_order()], ["stage"]), "model", "left")
    rest = found.filter("model_key IS NULL").select("model")

    met = _pairs(rest, prices).withColumn("similarity", jaro_winkler_similarity("x", "y"))
    inside = _contained()
    met = met.filter(inside | (F.col("similarity") >= threshold)).withColumn("stage", F.when(inside, "substring").otherwise("fuzzy"))
    near = [-F.col("similarity"), length_gap(F.col("x"), F.col("y")).cast("double"), F.lit(0.0)]
    order = [F.when(inside, a.cast("double")).otherwise(b) for a, b in zip(_substring_order(), near)]
    loose = rest.join(_best(met, [(~inside).cast("int"), *order, F.col("model_key")], ["stage"]), "model", "left").select("model", "model_key", "stage")
    out = found.filter("model_key IS NOT NULL").select("model", "model_key", "stage").unionByName(loose)
    matched = F.when(F.col("stage") != "exact", F.col("model_key")).alias("matched_model")
    return out.select("model", F.coalesce("stage", F.lit("none")).alias("stage"), "model_key", matched)


def tier_bounds(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, bounds): by lower-cased name, else by normalized name; keys that collide take the smallest list."""
    listed = prices.filter("bounds is not null").select(F.lower("model_key").alias("k"), "bounds")
    by_name = listed.groupBy("k").agg(F.min("bounds").alias("own"))
    by_norm = listed.groupBy(m.normalize(F.col("k")).alias("norm")).agg(F.min("bounds").alias("near"))
    named = models.select("model").distinct().withColumn("k", F.lower("model")).withColumn("norm", m.normalize(F.lower("model")))
    return named.join(by_name, "k", "left").join(by_norm, "norm", "left").select("model", F.coalesce("own", "near").alias("bounds"))
