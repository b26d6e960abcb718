"""Model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that never take a price from a merely similar one. Fixed values.
PLACEHOLDERS = ["default", "auto", "custom", "unknown", "none"]


def without_provider(model: Column) -> Column:
    """What follows the first slash, or the whole name."""
    return F.regexp_replace(model, r"^[^/]*/", "")


def provider_prefix(model: Column) -> Column:
    """What precedes the first slash; null if there is no slash or nothing before it."""
    return F.when(F.contains(model, F.lit("/")), F.nullif(F.substring_index(model, "/", 1), F.lit("")))


def normalize(model: Column) -> Column:
    """Without provider prefix and without date (-dddddddd) and version (-v1.2) suffixes."""
    return F.regexp_replace(without_provider(model), r"(-[0-9]{8}|-v[0-9]+(\.[0-9]+)*)+$", "")


def loosely_matchable(model: Column) -> Column:
    segment = without_provider(F.lower(model))
    return (F.octet_length(segment) >= 4) & ~segment.isin(PLACEHOLDERS)


def canonical_claude(model: Column) -> Column:
    """Dots become dashes in names that begin with 'claude-'."""
    return F.when(model.startswith("claude-"), F.replace(model, F.lit("."), F.lit("-"))).otherwise(model)


def qualified(provider: Column, model: Column) -> Column:
    """'provider/model', unless the model carries the prefix already or there is no provider."""
    prefix = F.concat(provider, F.lit("/"))
    return F.when(F.coalesce(provider, F.lit("")) == "", model).when(model.startswith(prefix), model).otherwise(F.concat(prefix, model))


def is_synthetic(model: Column) -> Column:
    return F.contains(model, F.lit("<synthetic>"))
