import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tokentide.llm.queries import VOCABULARY
from tokentide.llm.wordpiece import PieceAutomaton, byte_level_pieces, count_pieces, read_ranked_vocabulary


def greedy(word, initial, continuing):
    """Pieces by longest match, or None."""
    at, n = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


PIECE = st.text("abc", min_size=1, max_size=5).map(str.encode)


@settings(max_examples=300, deadline=None)
@given(st.sets(PIECE, max_size=8), st.sets(PIECE, max_size=8), st.lists(st.text("abcd", max_size=14).map(str.encode), max_size=8))
def test_walk_equals_greedy_longest_match(initial, continuing, words):
    automaton = PieceAutomaton(initial, continuing)
    for w in words:
        if w:
            assert automaton.count(w) == greedy(w, initial, continuing)


def test_public_vocabulary(spark):
    initial, continuing = byte_level_pieces(read_ranked_vocabulary(VOCABULARY))
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("etaoinshrdluéß漢-!9", k=rng.randint(1, 14))) for _ in range(30))) for i in range(20)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "a" * 20_000), (None, "hello world"), (0, "hello"), (0, "hello")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, n_words string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_pieces"]) for r in count_pieces(docs, initial, continuing, b" ").collect()), key=str)
    a, b = set(initial), set(continuing)
    want = [(i, len((t or "").encode().split()), sum(greedy(b" " + w, a, b) for w in (t or "").encode().split())) for i, t in rows if i != 103]
    assert [g for g in got if g[0] != 103] == sorted(want, key=str)
    assert next(g for g in got if g[0] == 103)[1] == 1


def test_empty_vocabulary_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "two words")], "doc_id bigint, text string")
    assert count_pieces(docs, [], []).first()["n_pieces"] == 2
    assert count_pieces(docs.limit(0), [b"a"], []).count() == 0
