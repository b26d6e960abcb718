import json
import random

import pytest

from tests.test_sources import put
from tokentide.operators.pairing import take_calls
from tokentide.sources import operations


def folded(events):
    """(result's place, call's place) of (place, key or None, named keys or None), in order, of one source."""
    pending, met = {}, set()
    for place, key, named in sorted(events, key=lambda e: (e[0], e[1] is not None)):
        if key is not None:
            pending[key] = place
        else:
            taken = next((k for k in named or () if k in pending), None)
            if taken is not None:
                met.add((place, pending.pop(taken)))
    return met


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_equal_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    logs = {}
    for source in ["a", "b", None, "long"]:
        n = 3000 if source == "long" else rng.randint(0, 80)
        places = rng.sample(range(5 * n + 1), n)
        logs[source] = [(p, rng.randrange(9), None) if rng.random() < 0.5 else (p, None, rng.choice([None, [], *[[rng.randrange(9) for _ in range(rng.randint(1, 4))]] * 4])) for p in places]
    calls = [(s, "x", p, k) for s, log in logs.items() for p, k, _ in log if k is not None] + [("a", "x", 3, None)]
    results = [(s, "x", p, named) for s, log in logs.items() for p, k, named in log if k is None]
    c = spark.createDataFrame(calls, "path string, other string, line_no bigint, seq int").repartition(3)
    r = spark.createDataFrame(results, "path string, other string, line_no bigint, named array<int>").repartition(5)
    got = {(x["path"], x["line_no"], x["call"]["line_no"]) for x in take_calls(c, r, ["path", "other"], ["line_no"], "seq", "named").collect()}
    assert got == {(s, *m) for s, log in logs.items() for m in folded(log)}


def test_no_events(spark):
    c = spark.createDataFrame([], "path string, line_no bigint, seq int")
    r = spark.createDataFrame([], "path string, line_no bigint, named array<int>")
    assert take_calls(c, r, ["path"], ["line_no"], "seq", "named").collect() == []


def test_a_result_leaves_the_calls_that_it_does_not_take(spark, tmp_path):
    def call(seq, command):
        return {"type": "tool/call", "seq": seq, "time": seq, "data": {"name": "bash", "arguments": json.dumps({"command": command})}}

    def result(seq, *named):
        return {"type": "tool/result", "seq": seq, "time": seq, "sourceEventSeqs": list(named), "data": {}}

    head = {"type": "session", "version": 0, "id": "s", "cwd": "/w", "createdAt": 1}
    log = [head, call(3, "first"), call(5, "second"), result(6, 3, 5), result(7, "x", 5), result(8, 3, 5)]
    put(tmp_path / "sessions", "p/s/session.jsonl", log)
    ops, _ = operations.read_operations(spark, {"deepseek": str(tmp_path / "sessions")})
    assert sorted(r["command"] for r in ops.collect()) == ["first", "second"]
