"""Requests of the file providers, normalised to disjoint token buckets.

Each reader takes the lines of its provider (sources.logs.lines) and returns REQUEST_USAGE rows:
input without cache reads, output without reasoning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokentide.functions import json, models, times, tokens
from tokentide.operators import windows
from tokentide.schemas import REQUEST_USAGE
from tokentide.sources import logs

AT = (["path"], ["line_no"])
#: Lines of a log that are scanned at once; a longer log is scanned in parts (see operators.windows).
PART_LINES = 1 << 16
PART = "__part"


def in_parts(rows: DataFrame) -> DataFrame:
    """``rows`` of lines with the column PART, by which windows split long logs."""
    return rows.withColumn(PART, F.floor(F.col("line_no") / PART_LINES))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _int(v: Column, path: str) -> Column:
    return F.coalesce(json.strict_int(v, path), F.lit(0))


def _rows(rows: DataFrame, provider: str, **columns: Column) -> DataFrame:
    """``columns`` completed to REQUEST_USAGE: counts that a provider lacks are 0, other columns null."""
    given = {"provider": F.lit(provider), "path": F.col("path"), "session_date": F.col("session_date")} | columns
    none = {"published_total", "request_context", "stored_cost", "session_id", "ts_ms", "model"}
    out = []
    for f in StructType.fromDDL(REQUEST_USAGE):
        missing = F.lit(None) if f.name in none else F.lit(False) if f.name == "is_advisor" else F.lit(0)
        out.append(given.get(f.name, missing).cast(f.dataType).alias(f.name))
    return rows.select(*out)


#: Field names of the formats, here and below. Fixed values.
_CLAUDE_NESTED = {"cache_creation": ["ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens"], "server_tool_use": ["web_search_requests", "web_fetch_requests"]}
_CLAUDE = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]


def claude(lines: DataFrame) -> DataFrame:
    """Assistant records with a usable usage object and a model, and each advisor iteration."""
    v = F.col("v")
    records = lines.filter(json.strict_string(v, "$.type") == "assistant").select(
        "path", "session_date", "line_no", json.strict_string(v, "$.sessionId").alias("session_id"), times.iso_ms(json.strict_string(v, "$.timestamp")).alias("ts_ms"),
        json.strict_string(v, "$.message.model").alias("model"), _get(v, "$.message.usage").alias("u"),
    )
    own = records.withColumn("is_advisor", F.lit(False))
    steps = records.withColumn("step", F.explode(json.items(F.col("u"), "$.iterations"))).filter(json.strict_string(F.col("step"), "$.type") == "advisor_message")
    named = F.coalesce(windows.nonempty(json.strict_string(F.col("step"), "$.model")), F.col("model"))
    advisors = steps.withColumn("model", named).withColumn("u", F.col("step")).withColumn("is_advisor", F.lit(True)).drop("step")
    rows = own.unionByName(advisors).filter(json.usable_counts(F.col("u"), _CLAUDE, _CLAUDE_NESTED) & windows.nonempty(F.col("model")).isNotNull())
    u = F.col("u")
    split = [json.strict_int(u, f"$.cache_creation.ephemeral_{t}_input_tokens") for t in ("5m", "1h")]
    five, hour = tokens.split_cache_writes(json.strict_int(u, "$.cache_creation_input_tokens"), *split)
    context = _int(u, "$.input_tokens") + _int(u, "$.cache_read_input_tokens") + five + hour
    return _rows(
        rows, "claude", session_id=F.col("session_id"), ts_ms=F.col("ts_ms"), model=F.col("model"), is_advisor=F.col("is_advisor"), input=_int(u, "$.input_tokens"), output=_int(u, "$.output_tokens"),
        cache_read=_int(u, "$.cache_read_input_tokens"), cc_5m=five, cc_1h=hour, web_search=_int(u, "$.server_tool_use.web_search_requests"), request_context=context,
    )


_CODEX = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def _codex_usable(info: Column) -> Column:
    """Token objects that are there are usable, and one is there or the context window is known."""
    window = "$.model_context_window"
    parts = [(json.has(info, f"$.{f}"), json.usable_counts(_get(info, f"$.{f}"), _CODEX)) for f in ("total_token_usage", "last_token_usage")]
    fine = reduce(Column.__and__, [~there | usable for there, usable in parts])
    unknown = F.coalesce(json.variant_type(info, window), F.lit("VOID"))
    known = parts[0][0] | parts[1][0] | (unknown == "BIGINT")
    return json.is_object(info) & fine & unknown.isin("BIGINT", "VOID") & known


def codex(lines: DataFrame) -> DataFrame:
    """Increments of the cumulative token counts, credited to the model in force; before any model, to none."""
    v = F.col("v")
    kind = json.strict_string(v, "$.type")
    counted = (kind == "event_msg") & (json.strict_string(v, "$.payload.type") == "token_count")
    total = "$.payload.info.total_token_usage"
    rows = lines.filter(kind.isin("session_meta", "turn_context") | counted).select(
        "path", "session_date", "line_no", F.when(kind == "session_meta", json.strict_string(v, "$.payload.id")).alias("id"), times.iso_ms(json.strict_string(v, "$.timestamp")).alias("ts_ms"),
        F.when(kind == "turn_context", json.strict_string(v, "$.payload.model")).alias("named"),
        (counted & _codex_usable(_get(v, "$.payload.info"))).alias("counts"), *[F.when(counted, json.strict_int(v, f"{total}.{c}")).alias(c) for c in _CODEX],
        json.strict_int(v, "$.payload.info.last_token_usage.input_tokens").alias("last_input"),
    )
    carried = {"model": windows.nonempty(F.col("named")), "session_id": windows.nonempty(F.col("id"))}
    rows = windows.scanned(in_parts(rows), carried, *AT, PART).withColumns({c: F.col(c)["now"] for c in carried}).filter("counts")
    rows = windows.counter_deltas(rows, _CODEX, "total_tokens", *AT, PART).filter("model is not null")
    fresh = F.greatest(F.col("input_tokens_delta") - F.col("cached_input_tokens_delta"), F.lit(0))
    spoken = F.greatest(F.col("output_tokens_delta") - F.col("reasoning_output_tokens_delta"), F.lit(0))
    context = F.when(F.col("last_input") > 0, F.col("last_input")).otherwise(F.col("input_tokens_delta"))
    return _rows(
        rows, "codex", session_id=F.col("session_id"), ts_ms=F.col("ts_ms"), model=F.col("model"), input=fresh, output=spoken, reasoning=F.col("reasoning_output_tokens_delta"),
        cache_read=F.col("cached_input_tokens_delta"), published_total=F.col("total_tokens_delta"), request_context=context,
    )


_COPILOT = ["inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "reasoningTokens"]


def copilot(lines: DataFrame) -> DataFrame:
    """The last shutdown's metrics per model; a session without any gets its streamed output."""
    v = F.col("v")
    kind = json.strict_string(v, "$.type")
    metrics = lines.filter(kind == "session.shutdown").select("path", "session_date", "line_no", F.explode(json.entries(v, "$.data.modelMetrics")).alias("name", "m"))
    metrics = metrics.select("*", _get(F.col("m"), "$.usage").alias("u")).filter(json.usable_counts(F.col("u"), _COPILOT))
    metrics = metrics.withColumn("model", models.canonical_claude(F.col("name")))
    last = metrics.groupBy("path", "session_date", "model").agg(F.max_by("u", "line_no").alias("u"))
    u = F.col("u")
    final = _rows(
        last, "copilot", model=F.col("model"), input=_int(u, "$.inputTokens"), output=F.greatest(_int(u, "$.outputTokens") - _int(u, "$.reasoningTokens"), F.lit(0)), reasoning=_int(u, "$.reasoningTokens"),
        cache_read=_int(u, "$.cacheReadTokens"), cc_5m=_int(u, "$.cacheWriteTokens"),
    )
    turns = lines.filter(kind.isin("session.model_change", "assistant.message")).select(
        "path", "session_date", "line_no", F.when(kind == "session.model_change", models.canonical_claude(json.strict_string(v, "$.data.newModel"))).alias("named"), json.strict_int(v, "$.data.outputTokens").alias("output")
    )
    turns = windows.carry_forward(in_parts(turns), "named", *AT, "model", PART).filter("output is not null and model is not null")
    streamed = turns.join(last.select("path").distinct(), "path", "left_anti")
    return final.unionByName(_rows(streamed, "copilot", model=F.col("model"), output=F.col("output")))


_GEMINI = ["input", "output", "cached", "thoughts", "tool", "total"]


def gemini_revisions(lines: DataFrame) -> DataFrame:
    """(path, session_date, line_no, pos, id, m): every assistant message with an id, alone or in a ``$set`` of messages."""
    v = F.col("v")
    alone = json.strict_string(v, "$.id").isNotNull() & json.strict_string(v, "$.type").isNotNull()
    single = F.array(v)
    several = json.items(_get(v, "$['$set']"), "$.messages")
    rows = lines.filter(~F.coalesce(json.has(v, "$['$rewindTo']"), F.lit(False)))
    rows = rows.select("path", "session_date", "line_no", F.posexplode(F.when(F.coalesce(alone, F.lit(False)), single).otherwise(several)).alias("pos", "m"))
    named = rows.withColumn("id", windows.nonempty(json.strict_string(F.col("m"), "$.id")))
    return named.filter("id is not null").filter(json.strict_string(F.col("m"), "$.type") == "gemini")


def gemini(lines: DataFrame) -> DataFrame:
    """The last revision of each message; one without usable tokens and a model keeps the tokens of the revision before."""
    m = F.col("m")
    model = windows.nonempty(json.strict_string(m, "$.model"))
    usable = json.usable_counts(_get(m, "$.tokens"), _GEMINI, empty=False) & model.isNotNull()
    rows = gemini_revisions(lines).select(
        "path", "session_date", "line_no", "pos", "id", model.alias("model"), times.iso_ms(json.strict_string(m, "$.timestamp")).alias("ts_ms"), F.when(usable, _get(m, "$.tokens").cast("string")).alias("t")
    )
    last = windows.last_revision(rows, ["path"], "id", ["line_no", "pos"], ["t", "model"]).filter("t is not null and model is not null").withColumn("t", F.parse_json("t"))
    t = F.col("t")
    return _rows(
        last, "gemini", ts_ms=F.col("ts_ms"), model=F.col("model"), input=F.greatest(_int(t, "$.input") - _int(t, "$.cached"), F.lit(0)), output=_int(t, "$.output"), reasoning=_int(t, "$.thoughts"),
        cache_read=_int(t, "$.cached"), tool_tokens=_int(t, "$.tool"), published_total=json.strict_int(t, "$.total"), request_context=_int(t, "$.input"),
    )


def readable_deepseek(lines: DataFrame) -> DataFrame:
    """Lines of logs whose header, if there is one, is of the one version that is known."""
    v = F.col("v")
    foreign = (json.strict_string(v, "$.type") == "session") & ~json.strict_int(v, "$.version").eqNullSafe(F.lit(0))
    return lines.join(lines.filter(foreign).select("path"), "path", "left_anti")


def deepseek_samples(lines: DataFrame) -> DataFrame:
    """The last of consecutive samples of a (turn, step), with the message's model, else the routed one, else null."""
    v = F.col("v")
    kind = json.strict_string(v, "$.type")
    chunk = (kind == "assistant/chunk") & (json.strict_string(v, "$.data.chunk.type") == "usage")
    rows = readable_deepseek(lines).filter(kind.isin("request/context", "assistant/message") | chunk).select(
        "path", "session_date", "line_no", json.strict_int(v, "$.time").alias("ts_ms"), F.when(kind == "request/context", json.strict_string(v, "$.data.model")).alias("named"),
        json.strict_int(v, "$.data.turn").alias("turn"), json.strict_int(v, "$.data.step").alias("step"), windows.nonempty(json.strict_string(v, "$.data.message.source.model")).alias("own"),
        F.coalesce(_get(v, "$.data.chunk.usage"), _get(v, "$.data.usage")).alias("u"),
    )
    routed = windows.carry_forward(in_parts(rows), "named", *AT, "route", PART).filter(json.is_object(F.col("u")))
    return windows.supersede_runs(routed, ["path"], ["turn", "step"], ["line_no"], PART).withColumn("model", F.coalesce("own", "route"))


def deepseek(lines: DataFrame) -> DataFrame:
    last = deepseek_samples(lines).filter("model is not null")
    u = F.col("u")
    context = _int(u, "$.inputTokens") + _int(u, "$.cacheReadTokens") + _int(u, "$.cacheWriteTokens")
    return _rows(
        last, "deepseek", ts_ms=F.col("ts_ms"), model=F.col("model"), input=_int(u, "$.inputTokens"), output=F.greatest(_int(u, "$.outputTokens") - _int(u, "$.reasoningTokens"), F.lit(0)),
        reasoning=_int(u, "$.reasoningTokens"), cache_read=_int(u, "$.cacheReadTokens"), cc_5m=_int(u, "$.cacheWriteTokens"), request_context=context,
    )


def grok_model(signals: Column, summary: Column | None = None) -> Column:
    """The primary model, else the first listed one that is not blank, else the summary's."""
    trimmed = F.transform(json.items(signals, "$.modelsUsed"), lambda m: F.trim(json.strict_string(m, "$")))
    listed = F.try_element_at(F.filter(trimmed, lambda m: m != ""), F.lit(1))
    own = windows.nonempty(F.trim(json.strict_string(signals, "$.primaryModelId")))
    last = [] if summary is None else [windows.nonempty(F.trim(json.strict_string(summary, "$.current_model_id")))]
    return F.coalesce(own, listed, *last)


def is_grok_signals(v: Column) -> Column:
    has = lambda f: json.has(v, f"$.{f}")
    return has("primaryModelId") & has("contextTokensUsed") & (has("contextWindowTokens") | has("toolsUsed"))


def grok(signals: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One gauge of context tokens per session, as cache reads. ``summaries``: documents of the files summary.json beside."""
    v = F.col("v")
    rows = signals.filter("not malformed").filter(is_grok_signals(v)).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    if summaries is None:
        rows = rows.withColumn("s", F.lit(None).cast("variant"))
    else:
        beside = summaries.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), F.col("v").alias("s"))
        rows = rows.join(beside, "folder", "left")
    rows = rows.select("path", "session_date", grok_model(v, F.col("s")).alias("model"), _int(v, "$.contextTokensUsed").alias("gauge")).filter("model is not null")
    return _rows(rows, "grok", model=F.col("model"), cache_read=F.col("gauge"))


READERS = {"claude": claude, "codex": codex, "copilot": copilot, "gemini": gemini, "deepseek": deepseek, "grok": grok}


def read_usage(spark: SparkSession, roots: dict[str, str | list[str]]) -> DataFrame:
    """REQUEST_USAGE of all file providers in ``roots`` (provider -> folder or folders)."""
    return reduce(DataFrame.unionByName, [READERS[p](*provider_lines(spark, p, paths)) for p, paths in roots.items()])


def beside(spark: SparkSession, signals: list[str], name: str) -> list[str]:
    """The files ``name`` in the folders of ``signals``, as readers take them; those that are not there are left out."""
    there = [p.rsplit("/", 1)[0] + "/" + name for p in signals]
    return [logs.readable(p) for p in there if logs.existing(spark, [logs.named(p)])]


def provider_lines(spark: SparkSession, provider: str, paths: str | list[str], only: list[str] | None = None) -> tuple[DataFrame, ...]:
    """What a provider's reader takes: its lines, or for Grok the documents of its signals and summaries.

    Roots that are not there hold nothing, nor do files that cannot be read (see sources.scans). Of Codex files with one name
    in several roots those of the first root count. ``only``: the files below the roots to read, if not all.
    """
    roots = logs.existing(spark, [paths] if isinstance(paths, str) else paths)
    pattern, matching, barring, depth = logs.FILES[provider]
    if provider == "grok":
        signals = None if only is None else list(map(logs.readable, only))
        summaries = None if only is None else beside(spark, only, "summary.json")
        named = ((pattern, matching, signals), ("summary.json", matching.replace("signals", "summary"), summaries))
        return tuple(logs.documents(logs.within_depth(logs.read_files(spark, roots if some is None else some, name, path, lenient=True), roots, depth)) for name, path, some in named)
    chosen = list(map(logs.readable, only or []))
    packed = [p for p in chosen if p.endswith(".zstd")]
    plain = roots if only is None else [p for p in chosen if not p.endswith(".zstd")]
    rows = logs.within_depth(logs.read_lines(spark, plain, pattern, matching, barring, lenient=True), roots, depth)
    if provider == "deepseek":
        files = logs.read_zstd_files(spark, roots if only is None else packed, lenient=True).filter(F.col("path").rlike(matching.replace("$", r"\.zstd$")))
        rows = rows.unionByName(logs.lines(logs.within_depth(files, roots, depth)))
    if provider == "codex" and len(roots) > 1 and only is None:
        rows = rows.join(logs.first_of_names(rows.select("path").distinct(), roots).select("path"), "path", "left_semi")
    return (rows,)
