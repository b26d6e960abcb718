import math
from collections import Counter

import pytest

from tokentide.llm import backoff


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return lower.encode().split() + [backoff.END]


def model(rows, order, discount=backoff.DISCOUNT):
    """(p(context, word), counts of tokens, tokens): interpolated absolute discounting by its recursive definition, without states."""
    train = [tokens(t) for _, t, learn in rows if learn]
    one = Counter(w for ts in train for w in ts)
    n, v = sum(one.values()), len(one)
    grams = Counter()
    for ts in train:
        padded = ["<s>", *ts]
        for k in range(2, order + 1):
            grams.update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
    count = {("<s>",): len(train), **{(w,): c for w, c in one.items()}, **grams}
    grams = {g: c for g, c in grams.items() if c >= 2}
    follow = {}
    for g in grams:
        follow.setdefault(g[:-1], []).append(g)

    def p(context, w):
        while context and context not in follow:
            context = context[1:]
        if not context:
            return (one[w] + 1) / (n + v + 1)
        free = 1 - sum(grams[g] - discount for g in follow[context]) / count[context]
        return max(grams.get((*context, w), 0) - discount, 0) / count[context] + free * p(context[1:], w)

    return p, one, n, follow


def brute(rows, order):
    p, one, n, _ = model(rows, order)
    out = []
    for i, t, learn in rows:
        ts = tokens(t)
        padded = ["<s>", *ts]
        score = sum(math.log10(p(tuple(padded[max(0, k - order + 1) : k]), padded[k])) for k in range(1, len(padded)))
        out.append((i, bool(learn), len(ts), sum(one[w] > 0 for w in ts), n, sum(math.log10(p((), w)) for w in ts), score))
    return out


ROWS = [(i, f"the cat sat on the mat number {i % 3} and the dog sat on the Rug", i % 4 != 2) for i in range(24)]
ROWS += [(50, None, True), (51, "", False), (52, " \n", True), (53, "été ÉTÉ été", True), (54, "unseen words only", False), (None, "the cat", True), (5, "the cat", None), (5, "the cat", None), (60, "the dog " * 4000, False)]


@pytest.mark.parametrize("order,block_bytes", [(1, 1 << 20), (2, 300), (3, 1 << 20), (4, 1000)])
def test_equals_recursive_definition(spark, order, block_bytes):
    docs = spark.createDataFrame([(*r, 1.5) for r in ROWS], "doc_id bigint, text string, learn boolean, score double")
    got = backoff.score_texts(docs, "learn", order=order, block_bytes=block_bytes)
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(brute(ROWS, order), key=lambda r: (str(r[0]), r[2]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_after_every_context_sum_to_one():
    p, one, _, follow = model(ROWS, 3)
    assert len(follow) > 10
    for context in follow:
        assert sum(p(context, w) for w in [*one, b"never seen"]) == pytest.approx(1)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 3 <> 0 AS learn")
    want = {r[0]: r for r in brute([tuple(r) for r in docs.collect()], 3)}
    got = backoff.score_texts(docs, "learn", block_bytes=100_000).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[:5] == want[r[0]][:5] and tuple(r)[5:] == pytest.approx(want[r[0]][5:], rel=1e-9)


def test_held_out_texts_score_better_than_unigrams(spark, small):
    from tokentide.llm.queries import op6_backoff_automaton

    rows = op6_backoff_automaton(spark, small).filter("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_nothing_to_learn_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", False)], "doc_id bigint, text string, learn boolean")
    assert tuple(backoff.score_texts(docs, "learn").first()) == (1, False, 3, 0, 0, 0.0, 0.0)
    assert backoff.score_texts(docs.limit(0), "learn").count() == 0


def test_ngrams_of_rare_words_are_kept_at_any_size(spark):
    filler = [(i, " ".join(f"f{(i * 31 + k) % 50}" for k in range(3000)), True) for i in range(100)]
    rows = [*filler, (200, "rare pair here", True), (201, "rare pair here", True), (202, "rare pair here", False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, learn boolean")
    got = {r["doc_id"]: r for r in backoff.score_texts(docs, "learn").filter("doc_id >= 200").collect()}
    want = {r[0]: r for r in brute(rows, 3) if r[0] >= 200}
    for i, w in want.items():
        assert got[i]["score"] == pytest.approx(w[6], rel=1e-9)
    assert got[202]["score"] > got[202]["base_score"] + 10
