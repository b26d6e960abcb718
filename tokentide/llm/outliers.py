"""Quality rules by robust multivariate outliers.

Each text's counts become a vector of transformed statistics. For every (language, source) the
minimum covariance determinant is sought by concentration steps (Rousseeuw and Van Driessen, 1999)
over all its rows: measure every row's Mahalanobis distance, keep the closest share, re-estimate
mean and covariance from them, until the determinant falls no more. The steps start from the
classical estimate and from three robust ones (after Hubert et al., "A deterministic algorithm for
robust location and scatter", 2012). Texts far from their group's estimate are rejected.

A group of few rows says little of its own covariance, so its estimate is mixed with that of its
language, and that one with the estimate of all rows: weight n / (n + PRIOR_ROWS) goes to the own
one. There is no size at which the rule changes.

A step is one aggregation: rows are counted and their products summed by (group, distance bin),
with partial sums before the shuffle, and the closest bins that hold the wanted share are added
up. Quantiles are read from counted bins, exactly. No group is ever gathered in one task.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentide.llm.keyed import join_keyed
from tokentide.llm.scratch import discard, written
from tokentide.llm.stats import COUNTS, text_counts
from tokentide.llm.text import map_texts

#: The transformed statistics, in order, and the least spread that each is given. The floors keep
#: estimates regular where most texts have none of a thing.
STATISTICS = {"chars": 0.03, "symbols": 0.05, "marks": 0.05, "upper": 0.01, "distinct": 0.03, "repeats": 0.05}
P = len(STATISTICS)

#: Share of a group's rows that the estimate rests on; bins for each doubling of a squared distance.
SUPPORT = 0.75
BINS = 16
#: A fall of the logarithm of a determinant that counts; more steps than these are an error.
FALL = 1e-3
MOST_STEPS = 200
#: Bins for each unit of a statistic whose quantiles are wanted.
QUANTILE_BINS = 1000
#: Words of the group's typical text that are mixed into each rate, so that short texts do not jump.
DAMPING = 40.0
#: Rows that a group's own estimate must have to weigh as much as the one that it is mixed with.
PRIOR_ROWS = 50.0
#: Share of clean Gaussian rows that the cut would reject.
TAIL = 1e-3


def chi2_cdf(x: float, degrees: int) -> float:
    """For even degrees of freedom."""
    return 1 - exp(-x / 2) * sum((x / 2) ** k / factorial(k) for k in range(degrees // 2))


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, degrees) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """Factor that makes the covariance of the closest ``share`` of Gaussian rows that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _rates(c) -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "chars": F.try_divide(c("word_chars"), words),
        "symbols": F.try_divide(c("n_symbols"), words),
        "marks": F.try_divide(c("n_marks"), words),
        "upper": F.try_divide(c("n_upper"), c("word_chars")),
        "distinct": F.when(words > 1, F.ln(c("n_distinct")) / F.ln(words)),
        "repeats": F.try_divide(c("n_repeat_words") + c("n_echoes"), words),
    }


def _group_names(lang_col: str, source_col: str) -> dict[str, Column]:
    lang, source = (F.coalesce(c, F.lit("\0")) for c in (lang_col, source_col))
    return {"group": F.to_json(F.array(lang, source)), "wider": F.to_json(F.array(lang)), "widest": F.lit("[]")}


def quantiles(rows: DataFrame, keys: list[str], columns: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, columns): an array of the quantiles of each column, from counts of all values in bins of equal width."""
    long = rows.select(*keys, F.posexplode(F.array(*columns)).alias("i", "x")).filter("x IS NOT NULL")
    bins = long.groupBy(*keys, "i", F.floor(F.col("x") * QUANTILE_BINS).alias("bin")).agg(F.count("*").alias("k"))
    group = Window.partitionBy(*keys, "i")
    placed = bins.withColumn("upto", F.sum("k").over(group.orderBy("bin"))).withColumn("n", F.sum("k").over(group))
    at = F.array(*[(F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("bin"))) + 0.5) / QUANTILE_BINS for share in shares])
    found = placed.groupBy(*keys, "i").agg(F.max("n").alias("n"), at.alias("q"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(c) for i, c in enumerate(columns)])


def _vectors(counted: DataFrame, typical: DataFrame) -> DataFrame:
    """Damped and transformed rates: logarithms of rates that are never negative, the others as they are."""
    rates = join_keyed(counted, typical, {"wider": "t_group"}, "__row")
    words = F.col("n_words").cast("double")
    out = []
    for s, rate in _rates(F.col).items():
        damped = (F.coalesce(rate, F.col(f"t_{s}")) * words + F.col(f"t_{s}") * DAMPING) / (words + DAMPING)
        shown = {"chars": F.ln(F.greatest(damped, F.lit(1e-3))), "symbols": F.log1p(damped), "marks": F.log1p(damped)}.get(s, damped)
        out.append(shown.alias(f"x_{s}"))
    return rates.select(*[c for c in rates.columns if not c.startswith("t_")], *out)


X = [f"x_{s}" for s in STATISTICS]
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def squared_distance(centre: Column, precision: Column) -> Column:
    """Of the row's vector; ``precision`` is the upper triangle of the inverse covariance."""
    d = [F.col(x) - centre[i] for i, x in enumerate(X)]
    terms = [(1 if i == j else 2) * precision[k] * d[i] * d[j] for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


_ESTIMATE = "group string, start int, centre array<double>, precision array<double>, logdet double, n bigint"


def _estimate(bins: pd.DataFrame, share: float) -> pd.DataFrame:
    """Mean and covariance of the closest bins that hold ``share`` of the group's rows."""
    bins = bins.sort_values("bin", kind="stable")
    total = int(bins["n"].sum())
    last = int(np.searchsorted(bins["n"].cumsum().to_numpy(), share * total))
    near = bins.iloc[: last + 1]
    n = near["n"].sum()
    mean = near[[f"s{i}" for i in range(P)]].to_numpy().sum(0) / n
    products = near[[f"s{i}_{j}" for i, j in _PAIRS]].to_numpy().sum(0) / n
    cov = np.empty((P, P))
    for value, (i, j) in zip(products, _PAIRS):
        cov[i, j] = cov[j, i] = value - mean[i] * mean[j]
    held = n / total
    if 0 < held < 1:
        cov *= consistency(held)
    cov += np.diag(np.square(list(STATISTICS.values())))
    inverse = np.linalg.inv(cov)
    row = (bins["group"].iloc[0], int(bins["start"].iloc[0]), mean.tolist(), [inverse[i, j] for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1]), total)
    return pd.DataFrame([row], columns=["group", "start", "centre", "precision", "logdet", "n"])


def _step(vectors: DataFrame, estimates: DataFrame | None, share: float, within: float | None = None) -> DataFrame:
    """Estimates from the closest share of each group; with ``within``, from rows within that squared distance.

    Without earlier estimates all rows count (the classical estimate).
    """
    if estimates is None:
        placed = vectors.withColumn("start", F.lit(0)).withColumn("bin", F.lit(0))
    else:
        named = estimates.select(F.col("group").alias("e_group"), "start", "centre", "precision")
        starts = named.groupBy("e_group").agg(F.collect_list(F.struct("start", "centre", "precision")).alias("e"))
        met = join_keyed(vectors, starts, {"group": "e_group"}, "__row").withColumn("e", F.explode("e"))
        distance = squared_distance(F.col("e.centre"), F.col("e.precision"))
        placed = met.withColumn("start", F.col("e.start")).withColumn("d", distance)
        placed = placed.withColumn("bin", F.floor(F.log2(F.greatest("d", F.lit(1e-6))) * BINS).cast("int"))
        if within is not None:
            placed = placed.filter(F.col("d") <= within).withColumn("bin", F.lit(0))
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"s{i}_{j}") for i, j in _PAIRS]
    bins = placed.groupBy("group", "start", "bin").agg(F.count("*").alias("n"), *sums)
    return bins.groupBy("group", "start").applyInPandas(lambda b: _estimate(b, share), _ESTIMATE)


def _robust_starts(vectors: DataFrame) -> DataFrame:
    """Medians with three spreads: quartile ranges as if independent, and those with the correlations of the hyperbolic
    tangents, and of the directions, of the standardised rows."""
    table = written(quantiles(vectors, ["group"], X, [0.25, 0.5, 0.75]), "quartiles")
    spread = [F.sqrt(F.pow((F.col(x)[2] - F.col(x)[0]) / 1.349, 2) + floor**2) for x, floor in zip(X, STATISTICS.values())]
    robust = table.select(F.col("group").alias("r_group"), F.col("n").alias("r_n"), F.array(*[F.col(x)[1] for x in X]).alias("middle"), F.array(*spread).alias("spread"))
    z = [(F.col(x) - F.col("middle")[i]) / F.col("spread")[i] for i, x in enumerate(X)]
    met = join_keyed(vectors, robust, {"group": "r_group"}, "__row").withColumn("z", F.array(*z))
    length = F.sqrt(sum((F.col("z")[i] * F.col("z")[i] for i in range(1, P)), F.col("z")[0] * F.col("z")[0]))
    each = met.withColumn("turned", F.explode(F.array(F.struct(F.lit(2).alias("start"), F.transform("z", F.tanh).alias("t")), F.struct(F.lit(3).alias("start"), F.transform("z", lambda v: F.coalesce(F.try_divide(v, length), F.lit(0.0))).alias("t")))))
    t = F.col("turned.t")
    sums = [F.sum(t[i] * t[j]).alias(f"s{i}_{j}") for i, j in _PAIRS]
    products = each.groupBy("group", F.col("turned.start").alias("start")).agg(F.first("middle").alias("middle"), F.first("spread").alias("spread"), F.first("r_n").alias("n"), *sums)

    def turned(batches):
        for rows in batches:
            yield pd.DataFrame([_correlated(r) for r in rows.to_dict("records")], columns=["group", "start", "centre", "precision", "logdet", "n"])

    plain = [(1 / F.pow(F.col("spread")[i], 2) if i == j else F.lit(0.0)) for i, j in _PAIRS]
    nothing = F.lit(None).cast("double").alias("logdet")
    first = robust.select(F.col("r_group").alias("group"), F.lit(1).alias("start"), F.col("middle").alias("centre"), F.array(*plain).alias("precision"), nothing, F.col("r_n").alias("n"))
    return first.unionByName(products.mapInPandas(turned, _ESTIMATE))


def _matrix(triangle) -> np.ndarray:
    out = np.empty((P, P))
    for value, (i, j) in zip(triangle, _PAIRS):
        out[i, j] = out[j, i] = value
    return out


def _correlated(row: dict) -> tuple:
    products = _matrix([row[f"s{i}_{j}"] for i, j in _PAIRS])
    size = np.sqrt(np.maximum(np.diag(products), 1e-12))
    likeness = products / np.outer(size, size)
    spread = np.asarray(row["spread"], float)
    cov = np.outer(spread, spread) * (0.98 * likeness + 0.02 * np.eye(P))
    inverse = np.linalg.inv(cov)
    return row["group"], row["start"], list(row["middle"]), [inverse[i, j] for i, j in _PAIRS], None, row["n"]


def covariance_estimates(vectors: DataFrame, share: float = SUPPORT) -> DataFrame:
    """(group, centre, precision, n, settled): the reweighted minimum-covariance-determinant estimate of each ``group`` of ``vectors``.

    Each start takes steps until its determinant no longer falls; of one that still falls after MOST_STEPS the last estimate
    counts, and its group is not ``settled``.
    """
    classical = _step(vectors, None, 1.0).withColumn("logdet", F.lit(None).cast("double"))
    now = written(classical.unionByName(_robust_starts(vectors)).withColumn("fell", F.lit(True)), "mcd")
    for _ in range(MOST_STEPS):
        moving = now.filter("fell").drop("fell")  # a start that no longer falls stays as it is
        some = vectors.join(moving.select("group").distinct(), "group", "left_semi")
        better = _step(some, moving, share).select("group", "start", *[F.col(c).alias(f"new_{c}") for c in ("centre", "precision", "logdet")])
        fell = F.coalesce(F.col("new_logdet") < F.col("logdet") - FALL, F.col("new_logdet").isNotNull() & F.col("logdet").isNull())
        met = now.join(better, ["group", "start"], "left").withColumn("fell", F.coalesce(fell, F.lit(False)))
        chosen = [F.when(F.col("fell"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "precision", "logdet")]
        last, now = now, written(met.select("group", "start", *chosen, "n", "fell"), "mcd")
        discard(last)
        if now.filter("fell").isEmpty():
            break
    lowest = F.min_by(F.struct("start", "centre", "precision", "logdet", "n"), F.struct("logdet", "start")).alias("e")
    best = now.groupBy("group").agg(lowest, (~F.max("fell")).alias("settled")).select("group", "e.*", "settled")
    best = written(best, "mcd-best")
    near = chi2_quantile(0.975, P)
    final = _step(vectors, best, 1.0, within=near)
    whole = best.select("group", "centre", "precision", "n", "settled").join(final.select("group", F.col("centre").alias("c"), F.col("precision").alias("p")), "group", "left")
    return written(whole.select("group", F.coalesce("c", "centre").alias("centre"), F.coalesce("p", "precision").alias("precision"), "n", "settled"), "mcd-final")


def _mix(own: tuple, prior: tuple, prior_rows: float) -> tuple:
    """(centre, covariance, rows) of two such, the own one by its rows: the moments of a mixture."""
    w = own[2] / (own[2] + prior_rows)
    gap = own[0] - prior[0]
    return w * own[0] + (1 - w) * prior[0], w * own[1] + (1 - w) * prior[1] + w * (1 - w) * np.outer(gap, gap), own[2]


def mixed_estimates(names: DataFrame, estimates: DataFrame, prior_rows: float = PRIOR_ROWS) -> DataFrame:
    """(group, centre, precision) of ``names`` (group, wider, widest), each mixed with the estimates of its wider groups."""
    for k, c in enumerate(("group", "wider", "widest")):
        names = names.join(estimates.select(F.col("group").alias(c), *[F.col(x).alias(f"{x}{k}") for x in ("centre", "precision", "n")]), c)

    def mix(batches):
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                own, wider, widest = ((np.asarray(r[f"centre{k}"], float), np.linalg.inv(_matrix(r[f"precision{k}"])), float(r[f"n{k}"])) for k in range(3))
                centre, cov, _ = _mix(own, _mix(wider, widest, prior_rows), prior_rows)
                inverse = np.linalg.inv(cov)
                out.append((r["group"], centre.tolist(), [inverse[i, j] for i, j in _PAIRS]))
            yield pd.DataFrame(out, columns=["group", "centre", "precision"])

    return names.mapInPandas(mix, "group string, centre array<double>, precision array<double>")


def judge_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_words: int = 10,
    repeat_percent: int = 20,
    prior_rows: float = PRIOR_ROWS,
    tail: float = TAIL,
) -> DataFrame:
    """One row per row of ``docs``: the id, the counts of ``stats.COUNTS``, ``base_failed``, the
    squared Mahalanobis ``distance`` of its statistics from its group's robust estimate, and ``kept``.

    ``base_failed``: fewer than ``least_words`` words, or over ``repeat_percent`` per cent of the
    words inside five-word windows that the text repeats. The others are kept unless the distance
    passes the 1 - ``tail`` quantile of chi-square. Estimates rest on all texts that have words.

    Cases: null, empty and blank texts have no words and no distance and fail the base rule. A null language or
    source is a value of its own. Texts of any length are counted whole. Rows that repeat count each. Spreads never fall below the floors of STATISTICS, so a group of
    equal texts keeps them all. No rows give no rows; extra columns are ignored.
    """
    rows = docs.select(docs[id_col].alias("__row"), docs[lang_col].alias("__lang"), docs[source_col].alias("__source"), docs[text_col].alias("__body"))
    ddl = ", ".join(f"{c} bigint" for c in COUNTS)
    counted = map_texts(rows, text_counts, ddl, "__body", ["__row", "__lang", "__source"])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    counted = written(counted.withColumn("base_failed", failed), "text-counts")
    worded = counted.filter("n_words > 0").withColumns(_group_names("__lang", "__source"))
    rates = worded.select("wider", *[F.ln(F.coalesce(rate, F.lit(0.0)) + 1e-3).alias(f"t_{s}") for s, rate in _rates(F.col).items()])
    middle = quantiles(rates, ["wider"], [f"t_{s}" for s in STATISTICS], [0.5])
    typical = middle.select(F.col("wider").alias("t_group"), *[F.greatest(F.exp(F.col(f"t_{s}")[0]) - 1e-3, F.lit(0.0)).alias(f"t_{s}") for s in STATISTICS])
    vectors = written(_vectors(worded, typical), "vectors")
    levels = vectors.select("__row", F.explode(F.array("group", "wider", "widest")).alias("group"), *X)
    names = vectors.select("group", "wider", "widest").distinct()
    estimates = mixed_estimates(names, covariance_estimates(levels), prior_rows).withColumnRenamed("group", "m_group")
    measured = join_keyed(vectors, estimates, {"group": "m_group"}, "__row").withColumn("distance", F.round(squared_distance(F.col("centre"), F.col("precision")), 6))
    measured = measured.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - tail, P)))
    columns = [F.col("__row").alias(id_col), *COUNTS, "base_failed", "distance", "kept"]
    rest = counted.filter("n_words = 0").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return measured.select(columns).unionByName(rest.select(columns))
