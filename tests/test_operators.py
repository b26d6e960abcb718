import pytest
from pyspark.sql import functions as F

from tokentide.functions import formats, tokens
from tokentide.operators import export, usage
from tokentide.plans import usage_queries
from tokentide.schemas import OPERATIONS, PRICES, REQUEST_USAGE, SESSIONS
from tokentide.streaming.incremental import refresh


def request(provider, model, **given):
    row = dict.fromkeys("provider path session_id session_date ts_ms model is_advisor input output reasoning cache_read cc_5m cc_1h web_search tool_tokens published_total request_context stored_cost".split())
    row |= dict.fromkeys(["input", "output", "reasoning", "cache_read", "cc_5m", "cc_1h", "web_search", "tool_tokens"], 0)
    return tuple((row | {"provider": provider, "model": model} | given).values())


@pytest.fixture(scope="module")
def prices(spark):
    def rates(x):
        return (x, x, 0.0, x, x, 0.0)

    return spark.createDataFrame([("m", rates(1e-6), [rates(4e-6)], False, [272000], 0.0), ("100", rates(0.01), [], False, None, 0.0)], PRICES)


def test_tier_belongs_to_the_request(spark, prices):
    """Two requests that straddle a boundary together, but not each, stay on the base rate."""
    rows = [request("codex", "m", input=x, request_context=x) for x in (200_000, 1_000)] + [request("codex", "m", input=300_000, request_context=300_000)]
    got = usage.usage(spark.createDataFrame(rows, REQUEST_USAGE), prices).collect()
    assert [(r.model, round(r.cost_usd, 9)) for r in got] == [("m", 0.201 + 1.2)]


def test_stored_cost_counts_where_the_key_is_not_exact(spark, prices):
    rows = [request("hermes", "x/m", input=5, stored_cost=7.0), request("hermes", "m", input=1_000_000, stored_cost=9.0), request("cursor", "zzz", cache_read=5)]
    got = usage.usage(spark.createDataFrame(rows, REQUEST_USAGE), prices)
    assert {(r.provider, r.model): round(r.cost_usd, 9) for r in got.collect()} == {("hermes", "x/m"): 7.0, ("hermes", "m"): 1.0, ("cursor", "zzz"): 0.0}
    assert {r.value for r in export.usage_text(got).collect()} == {"x/m: $7.000000", "m: $1.000000", "zzz: $0.000000"}
    assert '"cost_usd":7.0,"model":"x/m"' in "".join(r.value for r in export.usage_json(got).collect())
    merged = {r.model: round(r.cost_usd, 9) for r in usage.merge_bases(got).collect()}
    assert merged == {"m": 8.0, "zzz": 0.0}


def test_bounds_keep_the_ascending_run(spark):
    row = spark.range(1).select(tokens.ascending_bounds(F.expr("array(5L, 9L, 9L, 20L)")).alias("a"), tokens.ascending_bounds(F.expr("array(-1L)")).alias("b")).first()
    assert (row.a, row.b) == ([5, 9], None)


def test_formats(spark):
    rows = spark.createDataFrame([(999, 0.005), (999_950, -1234.5), (1_500, 0.0)], "n bigint, usd double").select(formats.compact(F.col("n")), formats.cost(F.col("usd"))).collect()
    assert [tuple(r) for r in rows] == [("999", "$0.01"), ("1.00M", "-$1,234.50"), ("1.50K", "$0.00")]


def test_compact_numbers_round_as_doubles(spark):
    """1.005 is a little less than it looks; the SQL of format_compact gives the same."""
    rows = spark.createDataFrame([(1_005,), (-9_915,), (9_745_000_000,), (12_350,), (1_015,), (1_005_000,)], "n bigint").select(formats.compact(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["1.00K", "-9.91K", "9.74B", "12.4K", "1.01K", "1.00M"]


def test_refresh_reads_only_what_changed(spark, tmp_path):
    read = []

    def reader(files):
        read.append(sorted(r.path for r in files.select("path").collect()))
        return files.select("path", F.length("value").cast("long").alias("input"))

    def files(**texts):
        rows = [(p, "2024-01-01", when, len(t), t) for p, (when, t) in texts.items()]
        return spark.createDataFrame(rows, "path string, session_date string, modified string, length bigint, value string").withColumn("modified", F.to_timestamp("modified"))

    state, old, new = str(tmp_path), "2024-01-01 00:00:00", "2024-01-01 00:00:01"
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(refresh(spark, files(a=(old, "x"), b=(old, "yy")), reader, state)) == [("a", 1), ("b", 2)]
    assert rows(refresh(spark, files(a=(old, "x"), b=(new, "zz"), c=(old, "zzz")), reader, state)) == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(refresh(spark, files(c=(new, "z")), reader, state, complete=False)) == [("a", 1), ("b", 2), ("c", 1)]
    assert rows(refresh(spark, files(c=(new, "z")), reader, state)) == [("c", 1)]
    assert read == [["a", "b"], ["b", "c"], ["c"], []]


def test_active_days(spark):
    days = [("codex", "2024-01-01", {"input": 1}), ("codex", "2024-01-02", {}), ("claude", "2024-01-01", {"stored_cost": 0.5}), ("claude", "2024-01-03", {"web_search": 1})]
    import datetime

    rows = spark.createDataFrame([request(p, "m", session_date=datetime.date.fromisoformat(d), **given) for p, d, given in days], REQUEST_USAGE)
    assert {r.provider: r.days for r in usage.active_days(rows).collect()} == {"codex": 1, "claude": 2, None: 2}


def test_synthetic_models_are_no_usage_of_claude_and_codex(spark):
    rows = [request("claude", "<synthetic>", input=1), request("gemini", "<synthetic>", input=2), request("hermes", None, input=4)]
    got = usage.roll_up(spark.createDataFrame(rows, REQUEST_USAGE), ["provider", "model"]).collect()
    assert {(r.provider, r.model): r.input for r in got} == {("gemini", "<synthetic>"): 2, ("hermes", None): 4}


def test_running_sums_of_a_stream(spark, tmp_path):
    from tokentide.streaming.incremental import usage_stream

    for k, rows in enumerate(([("codex", 1), ("claude", 5)], [("codex", 2)])):
        spark.createDataFrame(rows, "provider string, input bigint").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("provider string, input bigint").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sums = usage_stream(stream, ["provider"], ["input"]).writeStream.outputMode("complete").format("memory").queryName("running_sums").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    run = sums.start()
    assert run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("running_sums").collect()} == {("codex", 3), ("claude", 5)}


def test_dataset_has_logs_by_path_and_stores_by_date(spark):
    import datetime

    sources = [("opencode", "/a.db#1", 3), ("opencode", "/a.db#2", 1), ("claude", "/b", 1), ("claude", "/a", 2), ("cursor", "/c#2", 2), ("cursor", "/c#1", 2)]
    sessions = spark.createDataFrame([(p, path, "s", datetime.date(2024, 1, d), 0, "", "") for p, path, d in sources], SESSIONS)
    rows = export.analysis_dataset(spark.createDataFrame([], OPERATIONS), sessions, spark.createDataFrame([], REQUEST_USAGE)).collect()
    assert [r["path"] for r in rows] == ["/a", "/b", "/a.db#2", "/a.db#1", "/c#1", "/c#2"]


@pytest.fixture(scope="module")
def much_money(spark, tmp_path_factory):
    """Two requests whose costs, 5 * 10^18 nano-dollars each, pass 64 bits together."""
    folder = tmp_path_factory.mktemp("money")
    spark.createDataFrame([(1, "Brand#12", "STEEL", 1)], "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    rows = [(i, 1, supplier, 2, 1.0, 5e9, 0.0, 0.0, "2001-01-01") for i, supplier in enumerate((6, 8))]
    columns = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string"
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name, keys", [("provider_totals", {"opencode", "hermes", None}), ("base_model_merge", {"brand-12"}), ("merged_row_cost", {"steel/brand-12"}), ("usage_priced_tiers", {"steel/brand-12"})])
def test_money_passes_64_bits(spark, small, much_money, name, keys):
    query = getattr(usage_queries, name)
    costs = {r[0]: int(r.cost_nanos) for r in query(spark, much_money).collect()}
    assert set(costs) == keys and max(costs.values()) == 10**19
    assert dict(query(spark, small).dtypes)["cost_nanos"] == "bigint"
