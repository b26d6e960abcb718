"""Joining rows to a table with one row per key when a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.scratch import written

#: A table of more rows is not broadcast but joined by shuffle, over salted copies.
BROADCAST_ROWS = 20_000
SALTS = 64


def join_keyed(rows: DataFrame, table: DataFrame, on: dict[str, str], spread: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` left-joined to ``table`` on columns of rows = columns of table, nulls equal; table's key columns are dropped.

    ``table`` is written and counted first. Up to ``most`` rows it is broadcast; a larger one is
    copied to SALTS slots and each row meets the slot that the hash of its column ``spread`` names.
    """
    table = written(table, "keyed")
    if table.count() <= most:
        same = [rows[a].eqNullSafe(table[b]) for a, b in on.items()]
        return rows.join(F.broadcast(table), same, "left").drop(*[table[b] for b in on.values()])
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    slotted = rows.withColumn("__slot", F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS)).cast("int"))
    same = [slotted[a].eqNullSafe(salted[b]) for a, b in on.items()] + [slotted["__slot"] == salted["__salt"]]
    return slotted.join(salted, same, "left").drop(*[salted[b] for b in on.values()], "__salt", "__slot")
