import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokentide.llm import topk
from tokentide.llm.topk import Cell, levels_of, segment_statistics, top_k


def plainly(rows, asks, k=5, scale=256):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            whole.append((i, tuple(math.floor(scale * x) for x in v)))
    out = []
    for i, v in {r for r in whole if asks(r[0])}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(rng, n, size=32):
    middles = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("size", [1, 4, 7, 16, 64, 70])
def test_bounds_hold_and_grow_tighter(size):
    rng = np.random.default_rng(size)
    a, b = np.floor(rng.normal(0, 90, (40, size))), np.floor(rng.normal(5, 60, (50, size)))
    exact, last = a @ b.T, None
    for n in levels_of(size):
        bound = segment_statistics(a, n) @ segment_statistics(b, n).T
        assert (bound + 1e-6 >= exact).all()
        assert last is None or size % n or (bound <= last + 1e-6).all()
        last = bound


def test_far_pairs_are_not_multiplied_out():
    rows = clustered(random.Random(1), 3000)
    vectors = np.floor(np.array([v for _, v in rows]) * 256)
    cell = Cell(np.arange(3000)[::50], vectors[::50], 5)
    for at in range(0, 3000, 500):
        cell.offer(np.arange(at, at + 500), vectors[at : at + 500])
    assert cell.products < 0.6 * cell.pairs
    assert sorted((int(cell.ids[i]), j, s) for i, j, s in cell.answers()) == sorted((q, j, s) for q, _, j, s in plainly(rows, lambda i: i % 50 == 0))


def test_rows_equal_brute_force_in_many_cells(spark):
    rng = random.Random(2)
    rows = clustered(rng, 400)
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # one hot vector: ties to the smaller id
    rows += [(2000 + i, [rng.choice([0.0, -0.001, 1.0]) for _ in range(3)]) for i in range(40)]
    rows += [(3000, None), (3050, [1.0, None]), (3100, [float("nan")]), (3150, [float("inf")]), (3200, [1e307]), (3250, []), (3251, []), (3300, [4.0])]
    rows += [(None, rows[0][1]), (50, rows[50][1]), (50, rows[51][1]), (51, rows[51][1]), (-50, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rank string")
    want = plainly(rows, lambda i: i % 50 == 0)
    for cell_rows in (7, topk.CELL_ROWS):
        assert rows_of(top_k(df, F.col("vec_id") % 50 == 0, cell_rows=cell_rows)) == sorted(want)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(1 << 29)) for _ in range(4)]) for i in range(120)] + [(200, [1e20, 1e20, 1e20, 1e20])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = [(q, r, j, min(s, (1 << 63) - 1)) for q, r, j, s in plainly(rows, lambda i: i % 50 == 0, scale=1)]
    got = rows_of(top_k(df, F.col("vec_id") % 50 == 0, scale=1))
    assert [g for g in got if g[0] != 200] == sorted(w for w in want if w[0] != 200)
    assert [g[3] for g in got if g[0] == 200] == [w[3] for w in want if w[0] == 200]


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "vec_id int, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0]), (1, None)], "vec_id int, embedding array<float>")
    assert top_k(alone, F.col("vec_id") % 50 == 0).count() == 0
