"""Display formats of numbers, money and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]


def number(n: Column) -> Column:
    """Thousands separated by commas."""
    return F.format_number(n, 0)


def _fixed(x: Column, digits: int) -> Column:
    """So many decimals, rounded as doubles are: round(x, digits) would round the shortest decimal form, 1.005 to 1.01, though 1.005 * 100 is below 100.5."""
    return F.format_string(f"%.{digits}f", F.round(x * 10**digits) / 10**digits)


def compact(n: Column) -> Column:
    """Three significant figures with K, M, B or T; below 1000 as it is. 999,950 is 1.00M."""
    size = F.abs(n.cast("double"))
    out = n.cast("string")
    for i, (unit, suffix) in reversed(list(enumerate(_UNITS))):
        scaled = size / unit
        # what rounds to a thousand of the unit below is one of this unit
        reached = size >= (unit if suffix == "K" else unit * 0.9995)
        shown = F.when(scaled < 9.995, _fixed(scaled, 2)).when(scaled < 99.95, _fixed(scaled, 1)).otherwise(_fixed(scaled, 0))
        out = F.when(reached, F.concat(F.when(n < 0, "-").otherwise(""), shown, F.lit(suffix))).otherwise(out)
    return out


def cost(usd: Column) -> Column:
    """'$1,234.56'; a negative amount that rounds to zero cents has no sign."""
    cents = F.floor(F.abs(usd) * 100 + 0.5).cast("long")
    sign = F.when((usd < 0) & (cents != 0), "-").otherwise("")
    return F.concat(sign, F.lit("$"), number(F.floor(cents / 100)), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def cost_compact(usd: Column) -> Column:
    short = F.concat(F.when(usd < 0, "-").otherwise(""), F.lit("$"), compact(F.round(F.abs(usd)).cast("long")))
    return F.when(F.abs(usd) < 1000, cost(usd)).otherwise(short)


def duration_until(reset: Column, now: Column) -> Column:
    """The two largest units until an instant in seconds; 'now' under a minute."""
    left = F.greatest(reset - now, F.lit(0)).cast("long")
    days, hours, minutes = F.floor(left / 86400), F.floor(left % 86400 / 3600), F.floor(left % 3600 / 60)
    return (
        F.when(days > 0, F.format_string("%dd%dh", days, hours))
        .when(hours > 0, F.format_string("%dh%dm", hours, minutes))
        .when(minutes > 0, F.format_string("%dm", minutes))
        .otherwise("now")
    )
