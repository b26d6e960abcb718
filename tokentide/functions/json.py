"""JSON fields whose type matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_type(v: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def strict_int(v: Column, path: str) -> Column:
    """The integer at ``path``; null for fractions (1.0 too), strings and anything else."""
    return F.when(variant_type(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def strict_string(v: Column, path: str) -> Column:
    return F.when(variant_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number_as_int(v: Column, path: str) -> Column:
    """Any JSON number, truncated; null for the rest."""
    kind = variant_type(v, path)
    number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(v, path, "double").cast("decimal(38,9)").cast("long"))


def is_object(v: Column, path: str = "$") -> Column:
    return F.coalesce(variant_type(v, path).startswith("OBJECT"), F.lit(False))


def is_array(v: Column, path: str = "$") -> Column:
    return F.coalesce(variant_type(v, path).startswith("ARRAY"), F.lit(False))


def first_string(v: Column, fields: list[str]) -> Column:
    """The first of ``fields`` that is there decides, a JSON null too; null if it is no string."""
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        out = F.when(has(v, f"$.{f}"), strict_string(v, f"$.{f}")).otherwise(out)
    return out


def cost_fields(m: Column) -> Column:
    """The entries of a map that hold prices."""
    return F.map_filter(m, lambda k, _: F.contains(k, F.lit("cost")) | (k == "tiered_pricing"))


def sorted_map(m: Column) -> Column:
    """A map whose entries are in key order, for output."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def has(v: Column, path: str) -> Column:
    """Whether the path is there, a JSON null included."""
    return F.try_variant_get(v, path, "variant").isNotNull()


def usable_counts(v: Column, fields: list[str], nested: dict[str, list[str]] | None = None, empty: bool = True) -> Column:
    """An object whose ``fields`` are integers where they are there, at least one of which is.

    ``nested``: the same for objects inside; one without fields counts as one that is there. An
    object without any field passes if ``empty``.
    """
    seen, bad = [], []
    for f in fields:
        seen.append(has(v, f"$.{f}"))
        bad.append(has(v, f"$.{f}") & ~F.coalesce(variant_type(v, f"$.{f}") == "BIGINT", F.lit(False)))
    for name, inner in (nested or {}).items():
        there, fine = has(v, f"$.{name}"), is_object(v, f"$.{name}")
        seen.append(fine & (variant_type(v, f"$.{name}") == "OBJECT<>"))
        bad.append(there & ~fine)
        for f in inner:
            seen.append(has(v, f"$.{name}.{f}"))
            bad.append(has(v, f"$.{name}.{f}") & ~F.coalesce(variant_type(v, f"$.{name}.{f}") == "BIGINT", F.lit(False)))
    nothing = (variant_type(v) == "OBJECT<>") if empty else F.lit(False)
    return is_object(v) & (nothing | (_any(seen) & ~_any(bad)))


def _any(tests: list[Column]) -> Column:
    """One array test instead of a long chain of ORs, which Catalyst would unfold."""
    return F.array_contains(F.array(*[F.coalesce(t, F.lit(False)) for t in tests]), True)


def items(v: Column, path: str) -> Column:
    """The items of the array at ``path`` as variants; none where there is no array."""
    return F.when(is_array(v, path), F.try_variant_get(v, path, "array<variant>")).otherwise(F.expr("cast(array() as array<variant>)"))


def entries(v: Column, path: str) -> Column:
    """The fields of the object at ``path`` as a map of variants; none where there is no object."""
    return F.when(is_object(v, path), F.try_variant_get(v, path, "map<string,variant>")).otherwise(F.expr("cast(map() as map<string,variant>)"))
