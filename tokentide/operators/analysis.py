"""File operations: per session, per model, per provider."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.functions.models import is_synthetic

OPS = ["read", "write", "edit", "run", "todo"]
COUNTERS = ["read_lines", "write_lines", "edit_lines", *[f"{op}_calls" for op in OPS]]


def session_totals(operations: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, characters and calls by kind, distinct files and last activity of each session."""
    made = []
    for op in ("read", "write", "edit"):
        mine = F.col("op") == op
        made += [F.sum(F.when(mine, F.col("line_count")).otherwise(0)).alias(f"{op}_lines"), F.sum(F.when(mine, F.col("char_count")).otherwise(0)).alias(f"{op}_chars")]
    made += [F.count_if((F.col("op") == op) & F.coalesce(F.col("counts_call"), F.lit(True))).alias(f"{op}_calls") for op in OPS]
    files = F.count_distinct(F.when(F.col("op").isin("read", "write", "edit"), F.col("file_path"))).alias("unique_files")
    return operations.groupBy(*keys).agg(*made, files, F.max("ts_ms").alias("last_ts"))


def fan_out(sessions: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Every model of a session gets all of the session's counters; synthetic and advisor-only models none."""
    used = models.filter(~is_synthetic(F.col("model")))
    if "is_advisor" in used.columns:
        used = used.filter(~F.coalesce("is_advisor", F.lit(False)))
    return sessions.join(used.select(*keys, "model").distinct(), keys)


def by_model(fanned: DataFrame, keys: list[str] = ("model",)) -> DataFrame:
    return fanned.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])


def by_provider(fanned: DataFrame) -> DataFrame:
    """Sums per provider and over all (provider null); providers without file operations are left out."""
    return fanned.filter(F.col("provider") != "hermes").rollup("provider").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])


def active_dates(sessions: DataFrame) -> DataFrame:
    """Distinct dates on which a session was emitted, counters or not."""
    return sessions.rollup("provider").agg(F.count_distinct("session_date").alias("days"))


def any_counter():
    return F.expr(" OR ".join(f"{c} <> 0" for c in COUNTERS))
