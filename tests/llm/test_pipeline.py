"""The pipeline's rows against plain Python over the same small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from tests.llm.test_simhash import plain_print
from tokentide.llm import queries
from tokentide.llm.ranking import CUT, learn


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def without_common_lines(docs):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    last = {k: max(ids) for k, ids in held.items() if len(ids) >= 5}
    return {i: "\n".join(x for x in (text or "").split("\n") if last.get(key(x), i) == i) for i, text in docs.items()}


def one_of_each_group(docs):
    prints = {i: plain_print(t) for i, t in docs.items()}
    group = {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {i: docs[i] for i in ids if root(i) == i}


def uncontaminated(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t or ""))
    windows = {tuple(w[i : i + 13]) for w in map(words, items) for i in range(max(1, len(w) - 12)) if w}
    kept = {}
    for i, text in docs.items():
        w, hit = words(text), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
        if not (hit and 20 * len(hit) >= len(w)):
            kept[i] = text
    return kept


def mixed(docs, source):
    n = Counter(source[i] for i in docs)
    out = []
    for i, text in docs.items():
        rate = len(docs) / len(n) / n[source[i]]
        draw = int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
        term, total, copies = math.exp(-rate), math.exp(-rate), 0
        while draw >= total and copies < 200:
            copies += 1
            term *= rate / copies
            total += term
        out += [(i, c, text) for c in range(copies)]
    return out


def test_run_is_what_plain_python_makes(spark, small):
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text, source FROM '{small}/documents.parquet'").fetchall()
    items = [r[0] for r in con.execute(f"SELECT text FROM '{small}/benchmark.parquet'").fetchall()]
    source = {r[0]: r[2] for r in rows}
    model = learn(queries.table(spark, small, "documents"), queries.learnt_labels(spark, small))
    good = {i: t for i, t, _ in rows if model.score(t.encode() if t is not None else None) >= CUT}
    assert 0 < len(good) < len(rows)
    expected = mixed(uncontaminated(one_of_each_group(without_common_lines(good)), items), source)
    got = corpus_pipeline.run(spark, small)
    assert [r.shuffle_key for r in got.select("shuffle_key").collect()] == sorted(r.shuffle_key for r in got.select("shuffle_key").collect())
    assert sorted((r.doc_id, r.copy, r.text) for r in got.collect()) == sorted(expected)


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = queries.table(spark, small, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), small).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), small).count() == 0


def test_stages_take_odd_rows(spark, small):
    prose = queries.table(spark, small, "documents").filter("length(text) > 400").first()["text"]
    line = "One line that is well over forty characters, in every document."
    rows = [(i, f"{prose} {i}\n{line}", "en", "a" if i % 3 else None) for i in range(8)]
    rows += [(None, prose, None, None), (None, None, None, None), (50, None, "en", "b"), (51, "", "en", "b"), (52, prose, "en", "b"), (52, prose, "en", "b"), (52, "another text of this id", "en", "b"), (53, "word " * 200_000, None, "b")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_words string, n_lines string, rate string, extra int"
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "s", "w", "l", "r", 7) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, small)
        kept = left.collect()
        assert set(docs.columns) <= set(left.columns) and {r.extra for r in kept} <= {7}
        ids = [r.doc_id for r in kept]
        if name == "line_dedup":
            assert len(kept) == len(rows) and sum(line in r.text for r in kept) == 1 and all(r.n_chars == len(r.text) for r in kept)
        elif name == "near_dedup":
            assert ids.count(None) == 2 and ids.count(52) <= 1
        elif name == "decontaminate":
            assert len(kept) == len(rows)
        elif name == "quality":
            assert ids.count(52) in (0, 1, 2, 3)
    assert sum(r.text == rows[-1][1] for r in corpus_pipeline.mixing(spark, docs, small).collect()) >= 0
