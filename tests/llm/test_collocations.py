import random
import re
from collections import Counter, defaultdict

import pytest

from tokentide.llm import collocations as module
from tokentide.llm.collocations import collocations, count_phrases

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def counted(rows, max_n):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, max_n + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts


def plainly(rows, max_n=4, min_count=30, most=2000):
    out = []
    for lang, f in counted(rows, max_n).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        longest = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i : i + size]] = max(longest[p[i : i + size]], a)
        scored = []
        for p, a in found.items():
            if longest[p] and 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def texts(rng, n, words):
    rows = []
    for _ in range(n):
        said = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.4:
            said[len(said) // 2 : len(said) // 2] = ["New", "York", "city", "hall"][: rng.randint(2, 4)]
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b"]) for w in said)))
    return rows


WORDS = ["a", "A", "b", "ab", "ß", "漢字", "the", "the", "the", "\x00", "\x01", "a\x01", "\x02b", "\x1f", "é-x"]


@pytest.mark.parametrize("min_count, most, few", [(30, 2000, False), (2, 17, True), (1, 10_000, True)])
def test_rows_equal_brute_force(spark, monkeypatch, min_count, most, few):
    rows = texts(random.Random(min_count), 300, WORDS) + [("en", None), (None, ""), ("xx", " \t.\n"), ("fr", "one two"), ("en", "the the the the " * 5000), ("en", "x" * 100_000 + " y")]
    rows += [("en", "very common passage of words here")] * 80
    if few:  # many flushes, so many parts of one suffix
        monkeypatch.setattr(module, "MOST_WORDS", 200)
        monkeypatch.setattr(module, "_ROWS", 7)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, rank int").repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, min_count=min_count, most=most).collect())
    assert got == plainly(rows, min_count=min_count, most=most)


def test_counts_of_hot_prefixes_cut_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rng = random.Random(9)
        rows = [("en", " ".join("hot pair " + rng.choice("abcdefghij") + rng.choice("klmnopq") for _ in range(100))) for _ in range(40)]
        docs = spark.createDataFrame(rows, "lang string, text string")
        got = {(r["lang"], r["phrase"]): r["f"] for r in count_phrases(docs, 4, 20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    f = counted(rows, 4)["en"]
    assert got == {("en", " ".join(p)): c for p, c in f.items() if c >= 20} | {("en", None): 40 * 300}


def test_exact_scores_and_no_rows(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    big = 7_000_000_000_000_000_001
    spark.createDataFrame([(big, big, big + 2)], "a bigint, l bigint, r bigint").createOrReplaceTempView("big")
    row = spark.sql("SELECT (CAST(2000000 AS decimal(38,0)) * a) DIV (CAST(l AS decimal(20,0)) + r) AS s FROM big").first()
    assert row["s"] == 2_000_000 * big // (2 * big + 2)
