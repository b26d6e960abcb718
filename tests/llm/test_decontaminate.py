import re

import pytest
from pyspark.sql import functions as F

from tokentide.llm.decontaminate import find_contamination, remove_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, n_words string, items string"
ITEMS = "item_id bigint, text string, extra int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    out = {}
    for i, (_, text) in enumerate(docs):
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            v = words(body)
            if item is None or not v:
                continue
            size = min(n, len(v))
            grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in grams:
                    hit |= set(range(p, p + size))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
CASES = [
    (1, None),
    (2, ""),
    (3, LONG),
    (4, "x " * 400 + LONG.upper() + ", tail"),
    (5, "Été: répété! naïve-ish 3rd"),
    (6, LONG.replace(" ", ";;\n")),
    (6, LONG),
    (7, "word " * 50 + "short item here " + "word " * 5),
    (None, LONG),
    (8, "alpha " * 3000),
]
BENCH = [(1, LONG), (1, LONG), (2, "short item here"), (3, None), (4, ""), (None, "x x x"), (5, "répété naïve"), (10, "alpha alpha alpha")]


@pytest.mark.parametrize("n,shard_bytes", [(13, 1 << 20), (13, 40), (3, 1 << 20), (3, 60)])
def test_equals_brute_force_for_any_number_of_shards(spark, n, shard_bytes):
    docs = spark.createDataFrame([(i, t, "mine", "c") for i, t in CASES], DOCS).withColumn("row", F.monotonically_increasing_id())
    bench = spark.createDataFrame([(i, t, 0) for i, t in BENCH], ITEMS)
    got = sorted(find_contamination(docs.coalesce(1), bench, n=n, shard_bytes=shard_bytes).collect(), key=lambda r: r["row"])
    want = brute(CASES, BENCH, n)
    assert [(r["n_words"], r["n_hit"], r["hit_items"], r["contaminated"]) for r in got] == [want[i] for i in range(len(CASES))]
    assert got[0]["items"] == "c"


def test_spans_are_cut_and_other_documents_stay(spark):
    docs = spark.createDataFrame([(1, f"Önly {LONG}! end"), (2, "clean text"), (3, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, LONG)], "item_id bigint, text string")
    found = find_contamination(docs, bench)
    cut = {r["doc_id"]: r["text"] for r in remove_contamination(found, "spans").collect()}
    assert cut == {1: "Önly  ! end", 2: "clean text", 3: None}
    kept = remove_contamination(found)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert find_contamination(none, bench).count() == 0
    docs = spark.createDataFrame([(1, LONG)], "doc_id bigint, text string")
    assert find_contamination(docs, bench).first()["n_hit"] == 0


@pytest.mark.parametrize("bench", [[(1, "one two three"), (None, "four five six"), (None, "seven")], [(None, "four five six")]])
def test_null_item_ids_count_as_in_the_sql(spark, tmp_path, bench):
    import duckdb

    from tokentide.llm.queries import ORACLES, op1_decontamination

    docs = [(1, "zero four five six"), (2, "one two three four five six seven"), (3, "clean"), (4, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = sorted(db.execute(ORACLES["op1_decontamination"]).fetchall())
    got = sorted(tuple(r) for r in op1_decontamination(spark, str(tmp_path)).collect())
    assert got == want and got[0][2] == 3
