import random
from collections import defaultdict

import pytest

from tests.llm.test_paragraphs import brute_lines
from tokentide.llm import passages
from tokentide.llm.text import lowered_words


def brute(rows, least):
    """Every window of every text in a plain table."""
    held = defaultdict(set)
    texts = [(i, lowered_words(t.encode())) for i, t in rows if i is not None and t is not None]
    for i, words in texts:
        for p in range(len(words) - least + 1):
            held[tuple(words[p : p + least])].add((i, p))
    state = defaultdict(int)
    for places in held.values():
        if len({i for i, _ in places}) > 1:
            for i, p in places:
                for q in range(p, p + least):
                    state[i, q] = max(state[i, q], 1 if (i, p) == min(places) else 2)
    out = set()
    for (i, q), s in state.items():
        if state.get((i, q - 1)) != s:
            end = q
            while state.get((i, end)) == s:
                end += 1
            out.add((i, q, end - q, s == 2))
    return out


def found(docs, **options):
    """Passages, and lines."""
    got = [tuple(r) for r in passages.repeated_passages(docs, **options).collect()]
    assert len(set(got)) == len(got)
    return {(i, *rest) for i, line, *rest in got if line is None}, {r for r in got if r[1] is not None}


def rows_with_passages(seed=5):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    some = lambda n: rng.choices(words, k=n)
    shared = [some(n) for n in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(60):
        text = some(rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            passage = [*rng.choice(shared)]
            if rng.random() < 0.3:
                passage[rng.randrange(len(passage))] = "EDIT%d" % rng.randrange(3)
            text += [w.upper() if rng.random() < 0.1 else w for w in passage] + some(rng.randint(0, 90))
        wide = rng.choice([6, 9, 1000])  # lines too short to be paragraphs, or one long line
        rows.append((i, "\n".join(" ".join(text[k : k + wide]) for k in range(0, len(text), wide))))
    rows += [(70, None), (71, ""), (None, " ".join(shared[4])), (72, "x " * 400), (73, "x " * 300), (74, rows[3][1]), (75, f"{rows[4][1]} {rows[4][1]}")]
    return rows


@pytest.mark.parametrize("least", [50, 20])
def test_equals_brute_force(spark, least):
    rows = rows_with_passages()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, start int")
    want = brute(rows, least)
    assert {r[3] for r in want} == {True, False}
    assert found(docs, least=least, recall=0.99999, block=3) == (want, brute_lines(rows, least))


def test_documents(spark, small):
    """Passages as brute force has them; of near lines nothing that it lacks and 99 in 100 of what it has."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    passed, lines = found(docs)
    want, near = brute(rows, 50), brute_lines(rows, 50)
    assert want and passed == want
    assert lines <= near and len(lines) >= 0.99 * len(near)
    assert {r[0] for r in near} | {r[0] for r in want} == {r[0] for r in lines} | {r[0] for r in passed}


def test_passages_inside_lines_over_wrapped_lines_and_edited(spark, tmp_path):
    from tokentide.llm.queries import op4_paragraph_minhash

    passage = [f"word{i}" for i in range(60)]
    edited = passage[:30] + ["other"] + passage[31:]
    longer = " ".join([f"left{i}" for i in range(80)] + passage + [f"right{i}" for i in range(80)])
    wrapped = "\n".join(" ".join(passage[k : k + 6]) for k in range(0, 60, 6))
    clean = " ".join(f"clean{i}" for i in range(300)) + "\n" + " ".join(passage[:49])  # a word short
    rows = [(1, longer), (2, wrapped), (3, clean), (4, "first\n" + " ".join(edited)), (5, " ".join(passage).upper()), (6, None), (7, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in op4_paragraph_minhash(spark, str(tmp_path)).collect()}
    assert got == {(1, None, 80, 60, False), (2, None, 0, 60, True), (5, None, 0, 60, True), (4, 1, 1, 60, False), (5, 0, 0, 60, True)}


def test_removal(spark):
    passage = " ".join(f"word{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"a\n{passage}"), (2, f"  {passage}\nb  c"), (3, "d"), (4, None), (None, passage)], "doc_id bigint, text string")
    kept = {r["doc_id"]: r["text"] for r in passages.remove_passages(docs, passages.repeated_passages(docs)).collect()}
    assert kept == {1: f"a\n{passage}", 2: "\nb  c", 3: "d", 4: None, None: passage}


def test_no_rows_and_bad_parameters(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert passages.repeated_passages(docs).count() == 0
    with pytest.raises(ValueError):
        passages.repeated_passages(docs, least=10)
