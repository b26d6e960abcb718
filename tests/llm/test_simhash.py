import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tokentide.llm import simhash


def plain_print(text, size=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < size else [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, limit=3):
    prints = [plain_print(t) for _, t in rows]
    near = {i: {j for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= limit} for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], f"{prints[i]:016x}", min(ids) if ids else None))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [word() for _ in range(300)]
    rows = []
    for i in range(60):  # chains of small edits of one text, and unrelated ones
        if i % 2:
            base = [*base]
            base[rng.randrange(300)] = word().upper()
        rows.append((100 - i, " ".join(base if i % 2 else [word() for _ in range(40)])))
    rows += [(7, None), (8, ""), (9, " \n\t"), (1, "one two"), (2, "ONE\ttwo"), (2, "ONE\ttwo"), (3, "naïve Été"), (None, "one two"), (None, "unseen elsewhere"), (4, "w " * 70_000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, fingerprint string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert len({c for i, _, c in got if i is not None and i > 40}) < 60  # some chains did link


def test_links_are_complete_for_every_number_of_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 40, np.uint64)
    values = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 5), replace=False)
            values.add(c ^ sum(1 << int(b) for b in flips))
    values = sorted(values)
    want = {tuple(sorted(np.array([a, b], np.uint64).view(np.int64).tolist())) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3}
    frame = spark.createDataFrame([(v,) for v in np.array(values, np.uint64).view(np.int64).tolist()], "fingerprint bigint")
    for parts in (1, 2, 3, 4):
        monkeypatch.setattr(simhash, "choose_parts", lambda rows, both, limit, parts=parts: simhash.group_bits(rows, both, parts))
        if parts > 1:  # one part probes whole balls; a few values are enough for it
            assert {tuple(r) for r in simhash.links(frame).collect()} == want
        else:
            few = frame.limit(12)
            mine = {r[0] for r in few.collect()}
            got = {tuple(r) for r in simhash.links(few).collect()}
            assert got == {p for p in want if set(p) <= mine}


def test_thresholds_sum_to_the_general_pigeonhole_bound():
    crowd = np.array([[1, 1, 1.0], [1e9, 1, 1], [1e9, 1e9, 1]])
    plan = simhash.allocate(crowd, [21, 21, 22], np.full(3, 0.1), 3)
    assert (plan.sum(1) == 3 - 3 + 1).all() and plan[1, 0] == -1 and plan[2].tolist() == [-1, -1, 3]
    assert simhash.allocate(np.ones((1, 4)), [16] * 4, np.zeros(4), 3).tolist() == [[0, 0, 0, 0]]


def test_bits_are_grouped_once_and_correlated_ones_together():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (2000, 64))
    bits[:, 40] = bits[:, 3]
    groups = simhash.group_bits(2000, bits.T.astype(float) @ bits, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and any({3, 40} <= set(g) for g in groups)


def test_keep_one(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (2, "A b c d"), (2, "A b c d"), (None, "a b c d"), (9, "other words entirely here")], "doc_id bigint, text string")
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 9]
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none, simhash.near_duplicates(none)).count() == 0


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs.withColumn("id", F.lit("clash"))).collect())
    assert got == sorted(brute(rows))
