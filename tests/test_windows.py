import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources import put
from tokentide.operators import windows
from tokentide.sources import logs, usage_logs


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def split_rows(spark):
    """Sources of very different lengths, cut at random places, and some places without rows."""
    rng = random.Random(4)
    rows = []
    for source in ["a", "b", None, "long", "one"]:
        n = {"long": 2000, "one": 1}.get(source, 60)
        part = 0
        for i in range(n):
            part += rng.random() < 0.2 and rng.randint(1, 3)
            some = lambda x: x if rng.random() < 0.3 else None
            rows.append((source, i, part, some(rng.choice(["m", "n", ""])), some(rng.randrange(50)), some(rng.randrange(50)), rng.randrange(2)))
    return spark.createDataFrame(rows, "path string, line_no bigint, part bigint, named string, used bigint, total bigint, step bigint").repartition(7).cache()


AT = (["path"], ["line_no"])
FORMS = {
    "carry_forward": lambda r, **s: (windows.carry_forward(r, "named", *AT, "model", **s), "model"),
    "counter_deltas": lambda r, **s: (windows.counter_deltas(r, ["used", "total"], "total", *AT, **s), "used_delta", "total_delta"),
    "running_max": lambda r, **s: (windows.running_max(r, "used", *AT, "peak", **s), "peak"),
    "supersede_runs": lambda r, **s: (windows.supersede_runs(r, ["path"], ["step"], ["line_no"], **s), "step"),
}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_splits_change_nothing(split_rows, form):
    whole, *columns = FORMS[form](split_rows)
    apart, *_ = FORMS[form](split_rows, split="part")
    assert whole.columns == apart.columns
    got = rows_of(apart, "path", "line_no", *columns)
    assert got == rows_of(whole, "path", "line_no", *columns) and len(got) > 100


def test_no_task_holds_a_whole_source(split_rows):
    """Every exchange of rows is by source and part; by the source alone only summaries are dealt."""
    plan = windows.carry_forward(split_rows, "named", *AT, "model", "part")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path#" in plan and plan.count("part#") > 0
    largest = split_rows.groupBy("path", "part").count().agg(F.max("count")).first()[0]
    assert largest < 100 < 2000


def test_lines_are_numbered_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = [{"type": "x", "n": i, "fill": "y" * (i % 700)} for i in range(400)]
        put(tmp_path, "d/a.jsonl", ["", *lines])
        put(tmp_path, "d/b.jsonl", [{"n": 0}])
        rows = logs.read_lines(spark, str(tmp_path / "d"), "*.jsonl")
        got = rows.select(F.substring_index("path", "/", -1).alias("f"), "line_no", F.try_variant_get("v", "$.n", "bigint").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert sorted((r.f, r.line_no, r.n) for r in got) == [("a.jsonl", i + 1, i) for i in range(400)] + [("b.jsonl", 0, 0)]


def test_long_logs_are_read_in_parts(spark, tmp_path, monkeypatch):
    rng, total, log = random.Random(2), 0, []
    for i in range(300):
        if rng.random() < 0.05:
            log.append({"type": "turn_context", "payload": {"model": f"m{i % 3}"}})
        total = rng.randrange(40) if rng.random() < 0.03 else total + rng.randrange(9)
        usage = {"input_tokens": total, "total_tokens": total} if rng.random() < 0.9 else {"total_tokens": total}
        log.append({"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage}}})
    put(tmp_path, "s.jsonl", log)
    found = []
    for lines in (1 << 16, 7):
        monkeypatch.setattr(usage_logs, "PART_LINES", lines)
        rows = usage_logs.read_usage(spark, {"codex": str(tmp_path)})
        found.append(rows_of(rows, "model", "input", "published_total", "request_context"))
    assert found[0] == found[1] and len(found[0]) > 100
