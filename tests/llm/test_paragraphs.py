import random
from collections import defaultdict

import numpy as np
import pytest

from tokentide.llm import paragraphs
from tokentide.llm.text import LOWER_ASCII
from tokentide.llm.wordhash import fixed_binary


def components_of(n, pairs):
    groups = {i: {i} for i in range(n)}
    for a, b in pairs:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    return {i: frozenset(g) for i, g in groups.items()}


def brute_lines(rows, least, similarity=0.8, size=5):
    """(id, line, start, n_words, removed) of long lines, all pairs compared."""
    paras = []
    for i, t in rows:
        start = 0
        for n, line in enumerate(t.encode().translate(LOWER_ASCII).split(b"\n") if t and i is not None else ()):
            words = line.split()
            if len(words) >= least:
                paras.append(((i, start), n, len(words), b" ".join(words)))
            start += len(words)
    texts = sorted({p[3] for p in paras})
    sets = [paragraphs.shingles(t, size) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    group = components_of(len(texts), pairs)
    clusters = defaultdict(set)
    for place, n, k, t in paras:
        clusters[group[texts.index(t)]].add((place, n, k))
    return {(p[0], n, p[1], k, p != min(c)[0]) for c in clusters.values() if len({p[0] for p, *_ in c}) > 1 for p, n, k in c}


@pytest.mark.parametrize("block", [1000, 3])
def test_clusters_equal_brute_force(spark, block):
    """Near copies of a few passages: the leader is near some, the others are joined by chains."""
    rng = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for _ in range(4):
        line = rng.choices(words, k=60)
        for _ in range(25):  # a random walk by single edits: the ends of the walk are far apart
            line = [*line]
            line[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(line))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    lines = paragraphs.cut_paragraphs(docs, 50, *paragraphs.tune_bands(0.8, 0.99999), 5).filter("line IS NOT NULL")
    got = {bytes(r["digest"]): bytes(r["cluster"]) for r in paragraphs.clusters(docs, lines, block=block).collect()}
    sets = [paragraphs.shingles(t.encode(), 5) for t in texts]
    pairs = [(a, b) for a in range(100) for b in range(a) if paragraphs.near(sets[a], sets[b], 0.8)]
    assert len(pairs) > 50
    want = components_of(100, pairs)
    cutter = paragraphs.Cutter(50)
    digest = [fixed_binary(cutter.digests(cutter.words.of(t.encode().split()), np.array([0]), np.array([60]))).to_pylist()[0] for t in texts]
    assert any(len(g) > 3 for g in want.values())
    for a in range(100):
        for b in range(a):
            assert (got.get(digest[a], digest[a]) == got.get(digest[b], digest[b])) == (b in want[a])


def test_equal_windows_have_equal_signatures():
    rng = random.Random(2)
    words = [b"w%d" % i for i in range(200)]
    passage = rng.choices(words, k=50)
    cutter, chosen = paragraphs.Cutter(50), set()
    for _ in range(40):
        left, right = (rng.choices(words, k=rng.randrange(60)) for _ in "lr")
        texts = [left + passage + right, [b"too", b"short"], []]
        hashes = cutter.words.of([w for t in texts for w in t])
        rows = zip(*cutter.blocks(hashes, np.array([len(t) for t in texts])))
        chosen |= {piece for owner, start, n, piece, _ in rows if start <= len(left) < start + n}
    assert len(chosen) == 1


def test_connect_yields_a_forest_with_the_components_of_all_pairs():
    rng = random.Random(3)
    sets = [set(rng.sample(range(14), 9)) for _ in range(60)]
    near = lambda a, b: len(a & b) >= 0.6 * len(a | b)
    forest = paragraphs.connect([(i, s, f"own {i}") for i, s in enumerate(sets)], [], 0.6)
    assert all(near(sets[a], sets[b]) for a, b in forest)
    want = components_of(60, [(a, b) for a in range(60) for b in range(a) if near(sets[a], sets[b])])
    assert components_of(60, forest) == want and len(forest) == 60 - len(set(want.values()))
    known = [(i, s, f"part {i % 5}" if i < 40 else f"own {i}") for i, s in enumerate(sets)]
    chain = [(i, i + 5) for i in range(35)]
    links = chain + paragraphs.connect(known[40:], known[:40], 0.6)
    pairs = [(a, b) for a in range(60) for b in range(a) if (a >= 40 or b >= 40) and near(sets[a], sets[b])]
    assert components_of(60, links) == components_of(60, chain + pairs)


def test_tuned_bands():
    for similarity, recall in ((0.8, 0.99), (0.8, 0.9999), (0.5, 0.95)):
        bands, rows = paragraphs.tune_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall
    assert paragraphs.tune_bands(0.8)[1] >= 2
