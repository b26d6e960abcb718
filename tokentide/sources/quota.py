"""Quota snapshots of accounts, from the JSON bodies that providers answer with (no HTTP here).

Every mapper takes rows of ``body`` (JSON text) and ``now`` (epoch seconds) and adds the snapshot's
columns; other columns pass through. A window is a struct of used_percent and resets_at (epoch
seconds, null if unknown). A body that is no JSON object gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokentide.functions import json, times
from tokentide.operators.windows import nonempty

WINDOW = "struct<used_percent:double,resets_at:bigint>"
#: Lengths of the two windows of an account, in seconds. Fixed values.
FIVE_HOURS, SEVEN_DAYS = 18_000, 604_800
#: What says that a limit is hit, and names of billing periods. Fixed values.
_REACHED = ["reached", "exceeded", "blocked"]
_PERIODS = {"USAGE_PERIOD_TYPE_WEEKLY": "week", "USAGE_PERIOD_TYPE_MONTHLY": "month"}


def _v(path: str) -> Column:
    return F.try_variant_get("v", path, "variant")


def _number(v: Column, path: str) -> Column:
    """A JSON number as a double."""
    kind = json.variant_type(v, path)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def _flag(v: Column, path: str) -> Column:
    return F.when(json.variant_type(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def _seconds(text: Column) -> Column:
    ms = times.iso_ms(text)
    return F.when(ms > 0, F.floor(ms / 1000).cast("long"))


def window(used: Column, resets: Column) -> Column:
    return F.struct(used.cast("double").alias("used_percent"), resets.cast("long").alias("resets_at"))


def is_live(w: Column, now: Column) -> Column:
    """A window whose reset is known and still to come."""
    return F.coalesce(w["resets_at"] > now, F.lit(False))


def slots(windows: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(five hours, seven days) of the primary and the secondary (window or null, seconds or null): by length, or where none is
    told by position; windows of other lengths are dropped, and the later of two for one slot counts."""
    out = []
    for length, position in ((FIVE_HOURS, 0), (SEVEN_DAYS, 1)):
        fits = [F.when(F.coalesce(s == length, F.lit(k == position)), w) for k, (w, s) in enumerate(windows)]
        out.append(F.coalesce(*reversed(fits)))
    return out[0], out[1]


def money(minor: Column, exponent: Column, currency: Column) -> Column:
    """'$1.25', or '1.25 EUR'."""
    amount = F.format_string("%.2f", minor / F.pow(F.lit(10.0), F.greatest(exponent, F.lit(0))))
    return F.when(F.coalesce(currency, F.lit("USD")) == "USD", F.concat(F.lit("$"), amount)).otherwise(F.concat(amount, F.lit(" "), currency))


def _mapped(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.withColumn("v", F.try_parse_json("body")).withColumn("v", F.when(json.is_object(F.col("v")), F.col("v"))).withColumns(columns).drop("v")


def claude(rows: DataFrame) -> DataFrame:
    """five_hour, seven_day, scoped_weekly with its label, balance, spend_used, limit_reached."""
    v = F.col("v")

    def whole(path: str) -> Column:
        return F.when(json.is_object(v, path), window(F.coalesce(_number(v, f"{path}.utilization"), F.lit(0.0)), _seconds(json.strict_string(v, f"{path}.resets_at"))))

    def cash(path: str) -> Column:
        exponent = F.coalesce(json.strict_int(v, f"{path}.exponent"), F.lit(0))
        return F.when(json.is_object(v, path), money(F.coalesce(json.strict_int(v, f"{path}.amount_minor"), F.lit(0)), exponent, json.strict_string(v, f"{path}.currency")))

    limits = json.items(v, "$.limits")
    percent = lambda x: F.coalesce(_number(x, "$.percent"), F.lit(0.0))
    scoped = F.transform(
        F.filter(limits, lambda x: F.coalesce(json.strict_string(x, "$.kind") == "weekly_scoped", F.lit(False))),
        lambda x: F.struct(
            F.coalesce(_flag(x, "$.is_active"), F.lit(False)).alias("active"), percent(x).alias("percent"), _seconds(json.strict_string(x, "$.resets_at")).alias("resets"), nonempty(json.strict_string(x, "$.scope.model.display_name")).alias("label")
        ),
    )
    best = F.try_element_at(F.array_sort(scoped, lambda a, b: F.when(a["active"] != b["active"], F.when(a["active"], -1).otherwise(1)).when(a["percent"] > b["percent"], -1).when(a["percent"] < b["percent"], 1).otherwise(0)), F.lit(1))
    hit = F.exists(limits, lambda x: (percent(x) >= 100) | F.coalesce(json.strict_string(x, "$.severity").isin(_REACHED), F.lit(False)))
    full = [F.coalesce(_number(v, f"$.{w}.utilization") >= 100, F.lit(False)) for w in ("five_hour", "seven_day")]
    return _mapped(rows, {
        "five_hour": whole("$.five_hour"), "seven_day": whole("$.seven_day"), "scoped_weekly": F.when(best["label"].isNotNull(), window(best["percent"], best["resets"])), "scoped_label": best["label"],
        "balance": cash("$.spend.balance"), "spend_used": cash("$.spend.used"), "limit_reached": full[0] | full[1] | hit,
    })


def codex(rows: DataFrame) -> DataFrame:
    """plan_type, five_hour, seven_day, the credits, spend_limit, and limit_reached (null if nothing tells)."""
    v = F.col("v")

    def one(name: str) -> tuple[Column, Column]:
        path = f"$.rate_limit.{name}"
        resets = F.coalesce(json.strict_int(v, f"{path}.reset_at"), F.col("now") + json.strict_int(v, f"{path}.reset_after_seconds"))
        return F.when(json.is_object(v, path), window(F.coalesce(_number(v, f"{path}.used_percent"), F.lit(0.0)), resets)), json.strict_int(v, f"{path}.limit_window_seconds")

    five, seven = slots([one("primary_window"), one("secondary_window")])
    balance = F.coalesce(json.strict_string(v, "$.credits.balance"), F.when(_number(v, "$.credits.balance").isNotNull(), F.to_json(_v("$.credits.balance"))))
    told = [_flag(v, p) for p in ("$.rate_limit.limit_reached", "$.credits.overage_limit_reached", "$.spend_control.reached")]
    approx = F.transform(json.items(v, "$.credits.approx_local_messages"), lambda x: json.strict_int(x, "$"))
    low, high = F.try_element_at(approx, F.lit(1)), F.coalesce(F.try_element_at(approx, F.lit(2)), F.try_element_at(approx, F.lit(1)))
    return _mapped(rows, {
        "plan_type": json.strict_string(v, "$.plan_type"), "five_hour": five, "seven_day": seven, "credits_balance": balance, "has_credits": _flag(v, "$.credits.has_credits"),
        "unlimited": _flag(v, "$.credits.unlimited"), "reset_credits_available": json.strict_int(v, "$.rate_limit_reset_credits.available_count"), "spend_limit": _number(v, "$.spend_control.individual_limit"),
        "approx_messages": F.when(high > 0, F.array(low, high)), "limit_reached": F.when(F.coalesce(*told).isNotNull(), F.coalesce(F.array_contains(F.array(*told), True), F.lit(False))),
    })


def reset_credits(rows: DataFrame) -> DataFrame:
    """available_count, never negative, and expirations of the credits that are available, unknown ones last."""
    v = F.col("v")
    open_ones = F.filter(json.items(v, "$.credits"), lambda c: F.coalesce(json.strict_string(c, "$.status") == "available", F.lit(False)))
    times_of = F.transform(open_ones, lambda c: _seconds(json.strict_string(c, "$.expires_at")))
    ordered = F.array_sort(times_of, lambda a, b: F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1).when(a < b, -1).when(a > b, 1).otherwise(0))
    return _mapped(rows, {"available_count": F.greatest(json.strict_int(v, "$.available_count"), F.lit(0)), "expirations": ordered})


def copilot(rows: DataFrame) -> DataFrame:
    """plan_type, premium (null if unlimited or nothing is granted), premium_remaining, premium_entitlement, premium_unlimited, limit_reached."""
    v, path = F.col("v"), "$.quota_snapshots.premium_interactions"
    day = F.concat(json.strict_string(v, "$.quota_reset_date"), F.lit("T00:00:00Z"))
    resets = F.coalesce(_seconds(json.strict_string(v, "$.quota_reset_date_utc")), _seconds(day))
    remaining, granted = _number(v, f"{path}.remaining"), _number(v, f"{path}.entitlement")
    unlimited = F.coalesce(_flag(v, f"{path}.unlimited"), F.lit(False))
    nothing = F.coalesce((remaining.cast("long") == 0) & (granted.cast("long") == 0), F.lit(False))
    used = F.coalesce(100 - _number(v, f"{path}.percent_remaining"), F.when(granted > 0, (1 - remaining / granted) * 100))
    premium = F.when(~unlimited & ~nothing & used.isNotNull(), window(F.least(F.greatest(used, F.lit(0.0)), F.lit(100.0)), resets))
    return _mapped(rows, {
        "plan_type": nonempty(json.strict_string(v, "$.copilot_plan")), "premium": premium, "premium_remaining": remaining.cast("long"), "premium_entitlement": granted.cast("long"), "premium_unlimited": unlimited,
        "limit_reached": F.coalesce(premium["used_percent"] >= 100, F.lit(False)),
    })


def cursor(rows: DataFrame) -> DataFrame:
    """plan_type, total, auto, api, on_demand_dollars (own spend if enabled, else the team's), limit_reached."""
    v = F.col("v")
    resets = _seconds(json.strict_string(v, "$.billingCycleEnd"))
    part = {}
    for name in ("total", "auto", "api"):
        used = _number(v, f"$.individualUsage.plan.{name}PercentUsed")
        part[name] = F.when(used.isNotNull(), window(F.least(F.greatest(used, F.lit(0.0)), F.lit(100.0)), resets))
    own = F.when(_flag(v, "$.individualUsage.onDemand.enabled"), _number(v, "$.individualUsage.onDemand.used"))
    cents = F.coalesce(own, _number(v, "$.teamUsage.onDemand.used"))
    unlimited = F.coalesce(_flag(v, "$.isUnlimited"), F.lit(False))
    return _mapped(rows, {"plan_type": nonempty(json.strict_string(v, "$.membershipType")), **part, "on_demand_dollars": cents / 100, "limit_reached": ~unlimited & F.coalesce(part["total"]["used_percent"] >= 100, F.lit(False))})


def grok(rows: DataFrame) -> DataFrame:
    """included, period_label, on_demand_dollars, on_demand_cap_dollars, prepaid_balance_dollars, limit_reached. Amounts are cents; what is left out is zero."""
    v = F.col("v")
    there = json.is_object(v, "$.config")

    def dollars(name: str) -> Column:
        return F.when(json.is_object(v, f"$.config.{name}"), F.coalesce(_number(v, f"$.config.{name}.val"), F.lit(0.0)) / 100)

    end = F.coalesce(json.strict_string(v, "$.config.currentPeriod.end"), json.strict_string(v, "$.config.billingPeriodEnd"))
    used = F.least(F.greatest(F.coalesce(_number(v, "$.config.creditUsagePercent"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    cap = dollars("onDemandCap")
    cap, spent, balance = F.when(cap > 0, cap), dollars("onDemandUsed"), dollars("prepaidBalance")
    label = F.create_map(*[F.lit(x) for pair in _PERIODS.items() for x in pair])[json.strict_string(v, "$.config.currentPeriod.type")]
    return _mapped(rows, {
        "included": F.when(there, window(used, _seconds(end))), "period_label": label, "on_demand_dollars": F.when(cap.isNotNull(), F.coalesce(spent, F.lit(0.0))).otherwise(F.when(spent > 0, spent)),
        "on_demand_cap_dollars": cap, "prepaid_balance_dollars": F.when(balance > 0, balance), "limit_reached": there & (used >= 100),
    })


def session_limits(lines: DataFrame, now: Column) -> DataFrame:
    """(path, plan_type, five_hour, seven_day): of each log the last record with a limit of the main account that is still live."""
    v = F.col("v")
    limits = F.coalesce(F.try_variant_get(v, "$.payload.rate_limits", "variant"), F.try_variant_get(v, "$.payload.info.rate_limits", "variant"))
    rows = lines.filter("not malformed").withColumn("r", limits).filter(json.is_object(F.col("r")))
    r = F.col("r")
    rows = rows.filter(F.coalesce(json.strict_string(r, "$.limit_id"), F.lit("codex")) == "codex")

    def one(name: str) -> tuple[Column, Column]:
        w = window(F.coalesce(_number(r, f"$.{name}.used_percent"), F.lit(0.0)), json.strict_int(r, f"$.{name}.resets_at"))
        return F.when(json.is_object(r, f"$.{name}") & is_live(w, now), w), json.strict_int(r, f"$.{name}.window_minutes") * 60

    five, seven = slots([one("primary"), one("secondary")])
    found = rows.select("path", "line_no", json.strict_string(r, "$.plan_type").alias("plan_type"), five.alias("five_hour"), seven.alias("seven_day")).filter("five_hour IS NOT NULL OR seven_day IS NOT NULL")
    return found.groupBy("path").agg(F.max_by(F.struct("plan_type", "five_hour", "seven_day"), "line_no").alias("s")).select("path", "s.*")


def newest_files(files: DataFrame, per_root: int = 64, days: int = 14, most: int = 64) -> DataFrame:
    """The newest logs (root, path, modified), which may hold current limits: of each root the files of its latest ``days`` folders,
    or if it has no folders its last ``per_root`` by name; of those the ``most`` last changed. The limits are the feature."""
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    flat = folder == F.regexp_replace("root", r"/+$", "")
    by_day = F.dense_rank().over(Window.partitionBy("root", "flat").orderBy(F.col("folder").desc()))
    by_name = F.row_number().over(Window.partitionBy("root", "flat").orderBy(F.substring_index("path", "/", -1).desc()))
    ranked = files.withColumns({"folder": folder, "flat": flat}).withColumns({"day": by_day, "place": by_name})
    kept = ranked.filter((F.col("flat") & (F.col("place") <= per_root)) | (~F.col("flat") & (F.col("day") <= days)))
    return kept.drop("folder", "flat", "day", "place").orderBy(F.col("modified").desc(), F.col("path").desc()).limit(most)


def gauge_class(used_percent: Column) -> Column:
    """'red' from 90, 'yellow' from 70, else 'green'."""
    return F.when(used_percent >= 90, "red").when(used_percent >= 70, "yellow").otherwise("green")


def staleness(age_seconds: Column) -> Column:
    """'old' beyond six hours, 'stale' beyond one, else 'fresh'."""
    return F.when(age_seconds > 6 * 3600, "old").when(age_seconds > 3600, "stale").otherwise("fresh")


def current_version(snapshots: DataFrame, version: int) -> DataFrame:
    """Kept snapshots of this schema version; those of another are not read."""
    return snapshots.filter(F.col("schema_version") == version)
