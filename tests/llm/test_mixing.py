import math
from math import exp
from statistics import NormalDist

from pyspark.sql import functions as F

from tokentide.llm.keyed import join_keyed
from tokentide.llm.mixing import copies_of, mix, poisson_tables


def poisson(rate, u):
    """The number of copies at u, by the plain recurrence in logarithms."""
    k, log, total = 0, -rate, exp(-rate)
    while total <= u and k < 10 * rate + 100:
        k += 1
        log += math.log(rate / k)
        total += exp(log)
    return k


def test_tables_invert_the_poisson_distribution_at_any_rate(spark):
    rates = [0.0, 0.3, 4.0, 2000.0, 1e6]
    table = poisson_tables(spark.createDataFrame([(str(r), r) for r in rates], "__source string, rate double"))
    draws = [1e-9, 0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1 - 1e-9]
    got = table.withColumn("u", F.explode(F.array(*map(F.lit, draws)))).select("rate", "u", copies_of(F.col("u")).alias("n"), F.size("cdf").alias("size")).collect()
    assert len(got) == len(rates) * len(draws)
    for r in got:
        if r["rate"] == 0:
            assert r["n"] == 0
        elif r["rate"] < 1e6 and 0 < r["u"]:  # a draw of zero takes the least number that the table knows
            assert abs(r["n"] - poisson(r["rate"], r["u"])) <= (1 if r["rate"] >= 2000 else 0)
        elif 0.001 <= r["u"] <= 0.999:  # the normal distribution that a large rate nears, with its first correction
            z = NormalDist().inv_cdf(r["u"])
            assert abs(r["n"] - (1e6 + 1e3 * z + (z * z - 1) / 6)) <= 1.5
        elif r["u"]:
            assert abs(r["n"] - 1e6) < 7000
        assert r["size"] <= 30 * math.sqrt(r["rate"]) + 100


def test_a_rare_source_in_a_large_corpus_is_drawn_at_once(spark):
    docs = spark.range(100_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "rare").otherwise("common").alias("source"), F.lit("t" * 10).alias("text"))
    got = {r["source"]: r["count"] for r in mix(docs).groupBy("source").count().collect()}
    assert abs(got["rare"] - 50_000) < 2000 and abs(got["common"] - 50_000) < 2000


def test_very_long_text_is_kept(spark):
    docs = spark.createDataFrame([(i, "s", "x" * 2_000_000) for i in range(6)], "doc_id bigint, source string, text string")
    assert {r["n"] for r in mix(docs).select(F.length("text").alias("n")).collect()} == {2_000_000}


def test_shares_meet_targets_and_runs_agree(spark):
    docs = spark.range(12000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("source"), F.lit("t").alias("text"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    got = mix(docs, weights)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 9000) < 450
    keys = [r["shuffle_key"] for r in got.select("shuffle_key").collect()]
    assert keys == sorted(keys)
    assert sorted(keys) == sorted(r["shuffle_key"] for r in mix(docs.repartition(7), weights).collect())
    copies = got.groupBy("doc_id").agg(F.collect_set("copy").alias("c"), F.count("*").alias("n"))
    assert copies.filter((F.size("c") != F.col("n")) | (F.array_max("c") != F.col("n") - 1)).count() == 0


def test_nulls_missing_weights_and_clashing_columns(spark):
    rows = [(None, None, None, 1), (1, "a", "t", 2), (1, "a", "t", 2), (2, None, "", 3)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, rate int")
    got = mix(docs)
    assert got.columns[:3] == ["doc_id", "source", "text"] and got.filter("source is null").count() in range(0, 400)
    one = spark.createDataFrame([("a", 1.0), ("a", None), ("zzz", 5.0)], "source string, weight double")
    assert {r["source"] for r in mix(docs, one, size=3.0).collect()} <= {"a"}
    assert mix(docs.limit(0)).count() == 0
    assert mix(docs, one.filter("weight is null")).count() == 0


def test_salted_join_equals_broadcast_join(spark):
    rows = spark.createDataFrame([(i, "k" if i % 3 else None) for i in range(500)], "id bigint, key string")
    table = spark.createDataFrame([("k", 1), (None, 2), ("other", 3)], "of string, v int")
    small, salted = (join_keyed(rows, table, {"key": "of"}, "id", most=m) for m in (10, 0))
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in salted.collect()}
    assert small.count() == salted.count() == 500


def test_columns_that_are_not_added_stay(spark):
    docs = spark.createDataFrame([(i, "a", "x", i) for i in range(50)], "doc_id bigint, source string, least string, cdf int")
    got = mix(docs)
    assert got.columns == ["doc_id", "source", "least", "cdf", "rate", "copy", "shuffle_key"]
    assert {(r["least"], r["cdf"] - r["doc_id"]) for r in got.collect()} == {("x", 0)}
