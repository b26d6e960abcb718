"""Order-dependent operators. Every one partitions by a source key, so sources are independent.

Where a source may be larger than a task should hold, the operators take ``split``, a column that
never falls in the order: each split is then read by itself, what it hands on is summed up in one
row, those rows are combined in order by an operation that is associative (the last value that is
not null, the largest, the sum), and each split starts from what the ones before it hand on. Only
the rows of summaries of a source meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def scanned(rows: DataFrame, last: dict[str, Column], keys: list[str], order: list[str], split: str | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with structs (now, before) of each name: of ``last`` the latest value that is not null, of ``most`` the largest,
    up to each row and up to the one before it.

    With ``split`` the rows are scanned by splits, else by sources; the results are the same. A null split comes before all others.
    """
    most = most or {}
    folds = {n: (x, lambda c: F.last(c, ignorenulls=True)) for n, x in last.items()} | {n: (x, F.max) for n, x in most.items()}
    inner = keys if split is None else [*keys, split]
    earlier = ordered(inner, order).rowsBetween(Window.unboundedPreceding, -1)
    pairs = {n: F.struct(fold(x).over(so_far(inner, order)).alias("now"), fold(x).over(earlier).alias("before")) for n, (x, fold) in folds.items()}
    if split is None:
        return rows.withColumns(pairs)
    place = F.struct(*order)
    ends = [F.max_by(x, F.when(x.isNotNull(), place)).alias(n) for n, x in last.items()] + [F.max(x).alias(n) for n, x in most.items()]
    before = Window.partitionBy(*keys).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    summaries = rows.groupBy(*inner).agg(*ends)
    handed = summaries.select(*[F.col(c).alias(f"__in_{c}") for c in inner], *[fold(F.col(n)).over(before).alias(f"__from_{n}") for n, (_, fold) in folds.items()])
    met = rows.withColumns(pairs).join(handed, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__in_{c}")) for c in inner]))

    def started(n: str) -> Column:
        given = F.col(f"__from_{n}")
        both = {f: F.greatest(F.col(n)[f], given) if n in most else F.coalesce(F.col(n)[f], given) for f in ("now", "before")}
        return F.struct(*[x.alias(f) for f, x in both.items()])

    return met.withColumns({n: started(n) for n in folds}).drop(*[f"__in_{c}" for c in inner], *[f"__from_{n}" for n in folds])


def carry_forward(rows: DataFrame, column: str, keys: list[str], order: list[str], name: str, split: str | None = None) -> DataFrame:
    """``name``: the latest value of ``column``, not null nor empty, up to each row."""
    return scanned(rows, {name: nonempty(F.col(column))}, keys, order, split).withColumn(name, F.col(name)["now"])


def counter_deltas(rows: DataFrame, counters: list[str], total: str, keys: list[str], order: list[str], split: str | None = None) -> DataFrame:
    """Cumulative snapshots to increments, ``<counter>_delta``.

    A counter that a snapshot omits keeps its value, and its delta is 0. If the total falls, the
    source has restarted and the snapshot itself is the increment. No delta is negative.
    """
    names = list(dict.fromkeys([*counters, total]))
    rows = scanned(rows, {f"__{c}": F.col(c) for c in names}, keys, order, split)
    rows = rows.withColumns({f"__{w}_{c}": F.coalesce(F.col(f"__{c}")[f], F.lit(0)) for c in names for w, f in (("now", "now"), ("was", "before"))})
    restart = F.col(f"__now_{total}") < F.col(f"__was_{total}")
    for c in counters:
        step = F.when(restart, F.col(f"__now_{c}")).otherwise(F.greatest(F.col(f"__now_{c}") - F.col(f"__was_{c}"), F.lit(0)))
        rows = rows.withColumn(f"{c}_delta", F.when(F.col(c).isNull(), F.lit(0)).otherwise(step))
    return rows.drop(*[f"__{c}" for c in names], *[f"__{w}_{c}" for w in ("now", "was") for c in names])


def last_revision(rows: DataFrame, keys: list[str], id_col: str, order: list[str], inherited: list[str]) -> DataFrame:
    """One row per (keys, id): the last revision, at the place (``first_seen``) of the first.

    A null in an ``inherited`` column takes the last value before it.
    """
    every = [*keys, id_col]
    for c in inherited:
        rows = rows.withColumn(c, F.last(c, ignorenulls=True).over(so_far(every, order)))
    rows = rows.withColumn("first_seen", F.first(F.struct(*order)).over(so_far(every, order)))
    back = Window.partitionBy(*every).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__r", F.row_number().over(back)).filter("__r = 1").drop("__r")


def supersede_runs(rows: DataFrame, keys: list[str], step: list[str], order: list[str], split: str | None = None) -> DataFrame:
    """Of consecutive rows with the same ``step`` only the last stays (gaps and islands)."""
    now = F.struct(*step)
    inner = keys if split is None else [*keys, split]
    following = F.lead(now).over(ordered(inner, order))
    if split is not None:  # the last row of a split is followed by the first of the next
        firsts = rows.groupBy(*inner).agg(F.min_by(now, F.struct(*order)).alias("__first"))
        after = firsts.select(*[F.col(c).alias(f"__in_{c}") for c in inner], F.lead("__first").over(ordered(keys, [split])).alias("__after"))
        met = rows.withColumn("__inside", following).join(after, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__in_{c}")) for c in inner]))
        rows, following = met.drop(*[f"__in_{c}" for c in inner]), F.coalesce("__inside", "__after")
        kept = rows.filter(following.isNull() | ~following.eqNullSafe(now))
        return kept.drop("__inside", "__after")
    return rows.withColumn("__next", following).filter(F.col("__next").isNull() | ~F.col("__next").eqNullSafe(now)).drop("__next")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: one count for an event that arrives by several routes."""
    return rows.withColumn("__r", F.row_number().over(ordered(keys, order))).filter("__r = 1").drop("__r")


def running_max(rows: DataFrame, column: str, keys: list[str], order: list[str], name: str, split: str | None = None) -> DataFrame:
    return scanned(rows, {}, keys, order, split, {name: F.col(column)}).withColumn(name, F.col(name)["now"])


def numbered(rows: DataFrame, keys: list[str], split: str, order: list[str], name: str) -> DataFrame:
    """``name``: the place of each row in its source, from 0: its place in its split, after the sizes of the splits before."""
    inner = [*keys, split]
    own = rows.withColumn("__own", F.row_number().over(ordered(inner, order)) - 1)
    sizes = own.groupBy(*inner).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(ordered(keys, [split]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(c).alias(f"__in_{c}") for c in inner], before.alias("__before"))
    met = own.join(sizes, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__in_{c}")) for c in inner]))
    return met.withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__own", "__before", *[f"__in_{c}" for c in inner])


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; of equals the smallest."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("n"), F.col(value))).alias("x")).select(key, f"x.{value}", "x.n")


def largest_remainder(rows: DataFrame, keys: list[str], weight: str, seats: int, tie: str, name: str = "seats") -> DataFrame:
    """``seats`` dealt out in proportion to ``weight``: whole parts, then one each by largest fraction.

    Integer arithmetic, so equal fractions are ties and go by ``tie``. A group without weight gets none.
    """
    group = Window.partitionBy(*keys)
    total = F.sum(weight).over(group)
    share = F.col(weight) * seats
    rows = rows.withColumn("__t", total).withColumn(name, F.when(F.col("__t") > 0, F.expr(f"({weight} * {seats}) div __t")).otherwise(F.lit(0)))
    rows = rows.withColumn("__frac", F.when(F.col("__t") > 0, share - F.col(name) * F.col("__t")).otherwise(F.lit(0)))
    left = F.when(F.col("__t") > 0, F.lit(seats) - F.sum(name).over(group)).otherwise(F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__frac").desc(), tie))
    rows = rows.withColumn("__left", left).withColumn("__place", place)
    return rows.withColumn(name, (F.col(name) + (F.col("__place") <= F.col("__left")).cast("int")).cast("long")).drop("__t", "__frac", "__left", "__place")


def share_of_total(rows: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Value over the sum of all, from 0 to 1. The sum is one aggregate row, broadcast: no single-partition window."""
    total = rows.agg(F.sum(value).alias("__total"))
    return rows.join(F.broadcast(total)).withColumn(name, F.coalesce(F.try_divide(F.col(value).cast("double"), "__total"), F.lit(0.0))).withColumn(
        name, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0))
    ).drop("__total")
