"""Quality classifier by Bradley-Terry pairwise ranking.

Every pair of a good and a bad document is a preference. The probability that i is preferred to j
is the logistic of score(i) - score(j), and score is linear in text features: surface rates, hashed
words and pairs of words, and hashed trigrams of bytes. The weights minimise the mean logistic loss
of the feature differences of all pairs plus a ridge. The cut between good and bad is the quantile
of the training scores that parts the labels best.

All labelled rows are learnt from. The loss of a pair is a smooth function of two scores, so what
all pairs sum to is found from sums by cells of scores (see ``cells``), as exactly as from the
pairs themselves. Tasks sum over rows, tasks by name over tasks, and only sums meet the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from numpy.polynomial.chebyshev import chebvander
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.scratch import discard, released, written
from tokentide.llm.stats import text_counts
from tokentide.llm.text import LOWER_ASCII, lowered_words, map_texts
from tokentide.llm.wordhash import FACTORS, WordHashes, mix

#: Up to so many labels are broadcast to the documents; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
#: The score at the cut.
CUT = 0.7
#: Surface rates; cells for words and pairs of words; cells for trigrams of bytes.
SURFACE, WORD_CELLS, BYTE_CELLS = 10, 256, 256
FEATURES = SURFACE + WORD_CELLS + BYTE_CELLS

_hashes = WordHashes()


def surface(text: bytes | None) -> list[float]:
    """Rates of the text's counts, damped by a few words so that short texts do not jump."""
    words, chars, symbols, dup_lines, repeats, marks, upper, digits, distinct, echoes, lines = text_counts(text)
    n = words + 5.0
    return [
        log1p(words),
        log1p(20 * symbols / n),
        log1p(20 * marks / n),
        (upper + 1.0) / (chars + 20.0),
        digits / (chars + 20.0),
        (chars + 25.0) / n,
        repeats / n,
        echoes / n,
        log1p(distinct) / log1p(words) if words else 0.0,
        dup_lines / (lines + 2.0),
    ]


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Damped counts of hashes by cell, of length one; nothing gives zeros."""
    counts = np.log1p(np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells))
    length = np.sqrt((counts * counts).sum())
    return counts / length if length else counts


def features(text: bytes | None) -> np.ndarray:
    words = _hashes.of(lowered_words(text))
    pairs = mix(words[:-1] * np.uint64(FACTORS[0]) + words[1:])
    letters = np.frombuffer((text or b"").translate(LOWER_ASCII), np.uint8).astype(np.uint64)
    trigrams = mix((letters[:-2] << np.uint64(16)) + (letters[1:-1] << np.uint64(8)) + letters[2:])
    return np.concatenate([surface(text), _cells(np.concatenate([mix(words), pairs]), WORD_CELLS), _cells(trigrams, BYTE_CELLS)])


@dataclass(frozen=True)
class Ranker:
    """score = logistic(weights . (x - mean) / spread - cut), set so that the cut scores CUT. ``quantile``: the share of training scores below the cut."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    quantile: float

    def raw(self, x: np.ndarray) -> float:
        return float(self.weights @ ((x - self.mean) / self.spread))

    def score(self, text: bytes | None) -> float:
        z = self.raw(features(text)) - self.cut + log(CUT / (1 - CUT))
        return 1 / (1 + exp(-z)) if z > -700 else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int | None = None) -> DataFrame:
    """(__good, x): features, as the bytes of doubles, of the labelled documents, or of the first ``most`` by a hash of the id. An id with two labels
    takes the smaller; of rows that repeat an id the text with the smallest hash counts."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__good"))
    chosen = known if most is None else known.orderBy(F.xxhash64("__id"), "__id").limit(most)
    chosen = F.broadcast(chosen) if (known.count() if most is None else most) <= BROADCAST_LABELS else chosen
    texts = docs.select(docs[id_col].alias("__of"), docs[text_col].cast("string").alias("text")).join(chosen, F.col("__of") == F.col("__id"))
    one = texts.groupBy("__id").agg(F.first("__good").alias("__good"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return map_texts(one, lambda text: (features(text).astype(float).tobytes(),), "x binary", "text", ["__good"])


#: Good rows that meet all bad ones at a time.
BLOCK = 256


def _losses(scores: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For every pair the probability that the second is preferred."""
    return 1 / (1 + np.exp(np.clip(scores[:, None] - others[None, :], -500, 500)))


def _newton(size: int, terms: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps from nothing; ``terms`` gives the mean pull and curve of the pairs at given weights, without the ridge."""
    w = np.zeros(size)
    for _ in range(rounds):
        pull, curve = terms(w)
        step = np.linalg.solve(curve + ridge * np.eye(size), ridge * w - pull)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_weights(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of least mean logistic loss of all differences of a good and a bad row, plus a ridge, of rows in memory.

    The pairs' slopes and curves are sums over rows of sums over their partners, so the
    differences themselves are never made, and BLOCK good rows meet all bad ones at a time.
    """
    size, n = good.shape[1], len(good) * len(bad)

    def terms(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pull, curve, cross = np.zeros(size), np.zeros((size, size)), np.zeros((size, size))
        lost, bent = np.zeros(len(bad)), np.zeros(len(bad))
        others = bad @ w
        for at in range(0, len(good), BLOCK):
            some = good[at : at + BLOCK]
            p = _losses(some @ w, others)
            pull += p.sum(1) @ some
            lost += p.sum(0)
            p *= 1 - p
            curve += (some.T * p.sum(1)) @ some
            bent += p.sum(0)
            cross += some.T @ (p @ bad)
        return (pull - lost @ bad) / n, (curve + (bad.T * bent) @ bad - cross - cross.T) / n

    return _newton(size, terms, ridge, rounds)


#: Width of a cell of scores, and its nodes: the logistic function and its slope, whose poles are pi away from the line,
#: are met by the polynomials through so many nodes to 12 digits.
WIDTH, NODES = 4.0, 24
_PLACES = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_BASIS = chebvander(_PLACES, NODES - 1).T * (np.where(np.arange(NODES) == 0, 1, 2) / NODES)[:, None]


def cells(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, weights): a smooth function at a score is the sum of its values at the cell's nodes by these weights."""
    cell = np.floor(scores / WIDTH)
    return cell.astype(np.int64), chebvander(2 * (scores / WIDTH - cell) - 1, NODES - 1) @ _BASIS


def _nodes(of_cells: list[int]) -> np.ndarray:
    return (WIDTH * (np.array(of_cells, float)[:, None] + (_PLACES + 1) / 2)).ravel()


#: Rows at a time in a task, and on average at least where its sums are large; numbers in a row of a shuffle of sums.
CHUNK, PIECE = 2_048, 1 << 15
#: Places of a symmetric matrix that tell the rest.
_UPPER = np.triu_indices(FEATURES)
_SUMS = "name string, piece int, x binary"


def _add(total: dict, more: dict) -> None:
    for key, x in more.items():
        total[key] = total[key] + x if key in total else x


def _sent(total: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (name, piece), x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([piece], pa.int32()), pa.array([x.tobytes()])], names=["name", "piece", "x"])


def summed(rows: DataFrame, parts: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all rows (__good, x) of the arrays, by name and flat, that ``parts`` makes of the features and labels of some."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                x = np.frombuffer(b"".join(some.column(1).to_pylist()), float).reshape(-1, FEATURES)
                _add(total, parts(x, np.array(some.column(0).to_pylist()) == 1))
        for name, x in total.items():
            flat = np.asarray(x, float).ravel()
            yield from _sent({(name, k): flat[at : at + PIECE] for k, at in enumerate(range(0, len(flat), PIECE))})

    def of_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, piece, x in zip(*[c.to_pylist() for c in batch.columns]):
                _add(total, {(name, piece): np.frombuffer(x, float)})
        yield from _sent(total)

    got = rows.mapInArrow(of_rows, _SUMS).repartition("name", "piece").mapInArrow(of_tasks, _SUMS).collect()
    out: dict[str, list[np.ndarray]] = {}
    for r in sorted(got, key=lambda r: (r["name"], r["piece"])):
        out.setdefault(r["name"], []).append(np.frombuffer(r["x"], float))
    return {name: np.concatenate(x) for name, x in out.items()}


def fit_rows(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, good: int, bad: int) -> np.ndarray:
    """``fit_weights`` of a table of (__good, x), standardised, that holds so many good and bad rows.

    A round is two passes. The first sums how good and bad scores lie in cells, from which the driver finds, at the nodes,
    how much all partners pull a score; the second sums rows by their pull, and by cells for the products of partners.
    A task's sums of the second take megabytes whatever it reads, so tasks are no more than chunks of rows: what is
    shuffled follows the rows and not the pieces that their table lies in.
    """
    pairs, rows = good * bad, rows.coalesce(-(-(good + bad) // CHUNK))

    def by_cell(z: np.ndarray, w: np.ndarray, good: np.ndarray) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
        cell, weights = cells(z @ w)
        for side in (True, False):
            for c in np.unique(cell[good == side]):
                at = (good == side) & (cell == c)
                yield side, int(c), at, weights[at]

    def terms(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = summed(rows, lambda x, good: {f"{side:d} {c}": weights.sum(0) for side, c, _, weights in by_cell((x - mean) / spread, w, good)})
        held = {side: sorted(int(k.split()[1]) for k in where if k[0] == f"{side:d}") for side in (True, False)}
        mass = {side: np.concatenate([where[f"{side:d} {c}"] for c in held[side]]) for side in held}
        p = _losses(_nodes(held[True]), _nodes(held[False]))
        slopes = p * (1 - p)
        pulls = {True: (p @ mass[False], slopes @ mass[False]), False: (mass[True] @ p, mass[True] @ slopes)}
        at_nodes = {(side, c): [v.reshape(-1, NODES)[k] for v in pulls[side]] for side in held for k, c in enumerate(held[side])}

        def parts(x: np.ndarray, good: np.ndarray) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = {}
            z = (x - mean) / spread
            bent = np.zeros(len(z))
            for side, c, at, weights in by_cell(z, w, good):
                some = z[at]
                pull, slope = at_nodes[side, c]
                bent[at] = weights @ slope
                _add(out, {"pull": (1 if side else -1) * ((weights @ pull) @ some), f"{side:d} {c}": weights.T @ some})
            return out | {"curve": ((z.T * bent) @ z)[_UPPER]}

        got = summed(rows, parts)
        firsts, seconds = (np.concatenate([got[f"{side:d} {c}"].reshape(NODES, -1) for c in held[side]]) for side in (True, False))
        cross = firsts.T @ (slopes @ seconds)
        curve = np.zeros((FEATURES, FEATURES))
        curve[_UPPER] = got["curve"]
        return got["pull"] / pairs, (curve + np.triu(curve, 1).T - cross - cross.T) / pairs

    return _newton(FEATURES, terms)


def best_cut(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(cut, quantile): of the quantiles of the scores, halfway between neighbours, the one that misplaces fewest labels; of equals the lowest."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    wrong = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([[np.sum(~g)], np.sum(~g) - np.cumsum(~g)])
    k = int(np.argmin(wrong))
    if k == 0:
        return float(s[0]) - 1, 0.0
    return (float((s[k - 1] + s[k]) / 2) if k < len(s) else float(s[-1]) + 1), k / len(s)


def cut_rows(scores: DataFrame) -> tuple[float, float]:
    """``best_cut`` of a table of (z, __good): ranges of scores are sorted and counted each for itself, from counts of the ranges before."""
    counts = scores.groupBy("z").agg(F.sum("__good").alias("g"), F.sum(1 - F.col("__good")).alias("b"))
    ranged = written(counts.repartitionByRange("z").withColumn("part", F.spark_partition_id()), "op8-scores")
    parts = sorted(ranged.groupBy("part").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.sum("g").alias("g"), F.sum("b").alias("b")).collect(), key=lambda r: r["low"])
    before, g, b, last = [], 0, 0, None
    for r in parts:
        before.append((r["part"], g, b, last))
        g, b, last = g + r["g"], b + r["b"], r["high"]
    start = F.broadcast(scores.sparkSession.createDataFrame(before, "part int, g0 bigint, b0 bigint, z0 double"))
    so_far = Window.partitionBy("part").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.col(f"{c}0") + F.coalesce(F.sum(c).over(so_far), F.lit(0))
    cuts = ranged.join(start, "part").select("z", below("g").alias("gs"), below("b").alias("bs"), F.coalesce(F.last("z").over(so_far), "z0").alias("prior"))
    best = cuts.agg(F.min_by(F.struct("*"), F.struct(F.col("gs") + b - F.col("bs"), "z")).alias("r")).first()["r"]
    discard(ranged)
    if best["gs"] + b - best["bs"] > g:
        return last + 1, 1.0
    return (best["z"] - 1 if best["prior"] is None else (best["prior"] + best["z"]) / 2), (best["gs"] + best["bs"]) / (g + b)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int | None = None
) -> Ranker:
    """Learn from all documents that ``labels`` marks 1 (good) or 0 (bad), or from at most ``most`` if that is asked for.

    Only texts are looked at. Features are written to the shared folder and summed in tasks.
    Labels that are null or neither 0 nor 1, null ids and labels without a document are left out.
    Without a label of either kind, every document scores CUT.
    """
    with released(docs.sparkSession):
        rows = written(labelled_sample(docs, labels, id_col, text_col, label_col, most), "op8-features")
        try:
            sums = summed(rows, lambda x, good: {"count": np.array([good.sum(), (~good).sum()]), "x": x.sum(0), "xx": (x * x).sum(0)})
            good, bad = map(int, sums.get("count", (0, 0)))
            if not good or not bad:
                return Ranker(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.0)
            mean = sums["x"] / (good + bad)
            spread = np.maximum(np.sqrt(np.maximum(sums["xx"] / (good + bad) - mean * mean, 0)), 1e-6)
            for part in (slice(SURFACE, SURFACE + WORD_CELLS), slice(SURFACE + WORD_CELLS, FEATURES)):  # one scale for all cells of a kind
                spread[part] = np.sqrt((spread[part] ** 2).sum())
            w = fit_rows(rows, mean, spread, good, bad)

            def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    z = [float(w @ ((np.frombuffer(x, float) - mean) / spread)) for x in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.float64())], names=["__good", "z"])

            return Ranker(mean, spread, w, *cut_rows(rows.mapInArrow(scored, "__good int, z double")))
        finally:
            discard(rows)


def score_documents(docs: DataFrame, model: Ranker, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) of each whole text; good ones score at least CUT.

    Cases: null, empty and blank texts are scored from zero counts. Texts of any length are read
    whole. Equal texts score alike. No rows give no rows. A column ``score`` is replaced.
    """
    return map_texts(docs, lambda text: (model.score(text),), "score double", text_col, keep)
