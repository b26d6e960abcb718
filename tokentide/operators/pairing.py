"""Correlating calls with results, and other keyed matches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_calls(calls: DataFrame, results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each result with the latest call of its key before it; a call is used once, by its first result.

    Both sides are unioned and read once in order instead of joined by inequality, so a key with
    many repeats costs a sort, not a product. Columns: keys, ``call`` and ``result`` (structs).
    """
    c = calls.select(*keys, F.col(order).alias("__at"), F.struct(*calls.columns).alias("call"), F.lit(None).alias("result"))
    r = results.select(*keys, F.col(order).alias("__at"), F.lit(None).alias("call"), F.struct(*results.columns).alias("result"))
    # at one place a result comes before a call: a call must precede its result
    both = c.unionByName(r).withColumn("__rank", F.col("call").isNotNull().cast("int"))
    w = Window.partitionBy(*keys).orderBy("__at", "__rank")
    # the row before a result is the pending call, or an earlier result that has used it up
    return both.withColumn("call", F.when(F.col("result").isNotNull(), F.lag("call").over(w))).filter("result is not null and call is not null").select(*keys, "call", "result")


def take_calls(calls: DataFrame, results: DataFrame, keys: list[str], order: list[str], call_key: str, result_keys: str) -> DataFrame:
    """Each result, which names several calls in the array ``result_keys``, with the first of them that is pending.

    A call is pending from where it stands until a result takes it; one that repeats a pending
    call's key replaces it. A result takes one call and leaves the others that it names pending, so
    what a later result finds depends on all before it: the events of a source are folded in order,
    as narrow rows of places and keys. A task keeps its current source's pending keys, nothing else.

    ``order`` are whole numbers; at one place a result comes before a call. Returns ``keys``, the
    result's ``order`` columns and ``call``, the struct of the call's. Null keys name nothing, nor
    does a null array.
    """
    at = [f"__at{i}" for i in range(len(order))]
    place = [F.col(c).cast("long").alias(a) for c, a in zip(order, at)]
    made = calls.filter(F.col(call_key).isNotNull()).select(*keys, *place, F.lit(1).alias("__kind"), F.array(F.col(call_key).cast("long")).alias("__keys"))
    named = results.select(*keys, *place, F.lit(0).alias("__kind"), F.col(result_keys).cast("array<bigint>").alias("__keys"))
    source = F.struct(*keys)
    events = made.unionByName(named).select(*at, "__kind", "__keys", source.alias("__source"))
    dealt = events.repartition("__source").sortWithinPartitions("__source", *at, "__kind")
    n = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, pending = None, {}
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(n))))
            taken, rows = [], []
            for i, (place, kind, named, of) in enumerate(zip(places, batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist())):
                if of != source:
                    source, pending = of, {}
                if kind:
                    pending[named[0]] = place
                elif (key := next((k for k in named or () if k in pending), None)) is not None:
                    rows.append(i)
                    taken.append(pending.pop(key))
            if rows:
                found = batch.take(pa.array(rows, pa.int64()))
                columns = [pa.array(c, pa.int64()) for c in zip(*taken)]
                yield pa.RecordBatch.from_arrays([*found.columns[:n], found.column(n + 2), *columns], names=[*at, "__source", *[f"__call{i}" for i in range(n)]])

    kinds = ", ".join(f"{a} bigint" for a in at)
    whole = f"{kinds}, __source {dealt.schema['__source'].dataType.simpleString()}, " + ", ".join(f"__call{i} bigint" for i in range(n))
    call = F.struct(*[F.col(f"__call{i}").alias(c) for i, c in enumerate(order)]).alias("call")
    return dealt.mapInArrow(run, whole).select(*[F.col(f"__source.{k}").alias(k) for k in keys], *[F.col(a).alias(c) for a, c in zip(at, order)], call)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def owned(parts: DataFrame, owners: DataFrame, keys: list[str]) -> DataFrame:
    """Parts whose owner was collected."""
    return parts.join(owners.select(*keys).distinct(), keys, "left_semi")


def residuals(totals: DataFrame, parts: DataFrame, key: str, columns: list[str], capped: dict[str, str] | None = None, noise: float = 0.0) -> DataFrame:
    """What the sums of ``parts`` leave of each total, never negative.

    ``capped``: column -> column whose residual it may not exceed. Residuals below ``noise`` are 0.
    """
    sums = parts.groupBy(key).agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    joined = totals.join(sums, key, "left")
    rest = {c: F.greatest(F.coalesce(c, F.lit(0)) - F.coalesce(f"__{c}", F.lit(0)), F.lit(0)) for c in columns}
    rest = {c: F.when(x < noise, F.lit(0)).otherwise(x) if noise else x for c, x in rest.items()}
    for c, cap in (capped or {}).items():
        rest[c] = F.least(rest[c], rest[cap])
    return joined.select(key, *[x.alias(c) for c, x in rest.items()])


def drop_seen_names(files: DataFrame, name: str = "file_name", root_rank: str = "root_rank") -> DataFrame:
    """Files of later roots go if an earlier root has the name; names may repeat within one root."""
    first = F.min(root_rank).over(Window.partitionBy(name))
    return files.withColumn("__first", first).filter(F.col(root_rank) == F.col("__first")).drop("__first")


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before`` (keys only), by hashes of the values."""
    a = before.select(*keys, F.xxhash64(*values).alias("__was"))
    b = after.select(*keys, F.xxhash64(*values).alias("__is"))
    return b.join(a, keys, "left").filter(F.col("__was").isNull() | (F.col("__was") != F.col("__is"))).select(*keys)
