import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tokentide.operators.pairing import pair_calls
from tokentide.streaming.pending import pair_stream

EVENTS = "path string, id string, at bigint, is_call boolean, body string"


@pytest.fixture
def log():
    rng = random.Random(6)
    rows = [("a" if rng.random() < 0.7 else "b", f"k{rng.randrange(6)}", at, rng.random() < 0.5, rng.choice([None, f"body {at}"])) for at in range(300)]
    return [dict(zip(("path", "id", "at", "is_call", "body"), r)) for r in rows]


def put_batches(folder, log, size):
    folder.mkdir()
    for n, at in enumerate(range(0, len(log), size)):
        (folder / f"{n:04}.json").write_text("\n".join(json.dumps(r) for r in random.Random(n).sample(log[at : at + size], len(log[at : at + size]))))
        time.sleep(0.01)  # files are read in the order of their times


def streamed(spark, tmp_path, name, **options):
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = pair_stream(events, ["path", "id"], **options).writeStream.format("memory").queryName(name).outputMode("append")
    return out.option("checkpointLocation", str(tmp_path / f"state-{name}"))


def test_a_stream_in_micro_batches_gives_what_the_batch_gives(spark, tmp_path, log):
    put_batches(tmp_path / "in", log, 60)
    streamed(spark, tmp_path, "pairs").trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.table("pairs").select("path", "id", "call_at", "call", "result_at", "result").collect()}
    rows = spark.createDataFrame([tuple(r.values()) for r in log], EVENTS)
    both = pair_calls(rows.filter("is_call"), rows.filter("NOT is_call"), ["path", "id"], "at")
    want = {tuple(r) for r in both.select("path", "id", "call.at", "call.body", F.col("result.at"), F.col("result.body")).collect()}
    assert got == want and len(got) > 50


def test_calls_that_never_end_are_let_go(spark, tmp_path):
    put_batches(tmp_path / "in", [{"path": "a", "id": "k", "at": 1, "is_call": True, "body": "lost"}], 1)
    query = streamed(spark, tmp_path, "lost", wait_ms=500).trigger(processingTime="300 milliseconds").start()
    try:
        for n in range(60):
            (tmp_path / "in" / f"tick{n}.json").write_text(json.dumps({"path": "b", "id": f"t{n}", "at": n, "is_call": False, "body": None}))
            time.sleep(0.5)
            if spark.table("lost").count():
                break
    finally:
        query.stop()
    assert [tuple(r) for r in spark.table("lost").collect()] == [("a", "k", 1, "lost", None, None)]
