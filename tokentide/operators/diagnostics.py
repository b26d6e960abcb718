"""Data-quality counters of sources and the verdict on each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.functions import json


def counters(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the boolean columns malformed, recognized, relevant, normalized of each source."""
    flags = ["malformed", "recognized", "relevant", "normalized"]
    return records.groupBy(*keys).agg(F.count("*").alias("records"), *[F.count_if(f).alias(f) for f in flags])


def verdict(counted: DataFrame) -> DataFrame:
    """'failed' if nothing was recognized, or of relevant records none normalized; 'partial' if some
    were lost; else 'ok'. A source without records is 'ok'."""
    lost = (F.col("malformed") > 0) | (F.col("normalized") < F.col("relevant"))
    nothing = (F.col("records") > 0) & (F.col("recognized") == 0)
    fruitless = (F.col("relevant") > 0) & (F.col("normalized") == 0)
    return counted.withColumn("verdict", F.when(nothing | fruitless, "failed").when(lost, "partial").otherwise("ok"))


def emitted(counted: DataFrame) -> DataFrame:
    return verdict(counted).filter("verdict <> 'failed'")


#: Types of records that each log format is known to have, whether or not anything is taken from them. Fixed values.
RECORD_TYPES = {
    "claude": """assistant user system summary progress file-history-snapshot file-history-delta queue-operation attachment bridge-session
        permission-mode mode last-prompt ai-title agent-name pr-link started result agent-setting frame-link""".split(),
    "codex": "session_meta turn_context event_msg response_item inter_agent_communication_metadata world_state compacted".split(),
    "copilot": """session.start session.model_change session.task_complete session.shutdown session.info session.mode_changed system.message user.message
        assistant.message assistant.turn_start assistant.turn_end tool.execution_start tool.execution_complete hook.start hook.end abort
        subagent.started subagent.completed system.notification session.resume""".split(),
    "gemini": "gemini user info error".split(),
    "deepseek": """session request/context assistant/message assistant/chunk tool/call tool/result
        agent-preset/selected agent/inbox/spliced approval/asked approval/decided approval/policy command/done command/run
        compaction/end compaction/prune compaction/start compaction/summary feedback/record goal/change hook/invoked hook/result
        llm/retry llm/retry-started permission/preset plan/mode reasoning-chunks request/header sandbox/mode schedule/change
        session/end-seed session/title session/title-llm-request step/end step/start subagent/descriptor text-chunks todo/write
        tool-call-chunks tool-workflow/agent-end tool-workflow/agent-start tool-workflow/run-end tool-workflow/run-start
        tool/code-dispatch tool/code-dispatch-start turn/end turn/start user/message web/deepseek-search-llm-request""".split(),
}


def recognized(lines: DataFrame, provider: str) -> DataFrame:
    """``lines`` with ``recognized``: whether the record is of a type that the provider's format is known to have.

    Claude's records with a tool result count too, and of Gemini's the first, which describes the
    session, and changes of the conversation.
    """
    v = F.col("v")
    known = json.strict_string(v, "$.type").isin(RECORD_TYPES[provider])
    if provider == "claude":
        known = known | json.is_object(v, "$.toolUseResult")
    if provider == "gemini":
        known = known & json.strict_string(v, "$.id").isNotNull() | json.has(v, "$['$set']") | json.has(v, "$['$rewindTo']") | json.has(v, "$.projectHash")
    return lines.withColumn("recognized", F.coalesce(known, F.lit(False)))


def lost_records(counted: DataFrame) -> DataFrame:
    """``partial_failures``: records that a source lost though it did not fail."""
    lost = F.col("relevant") - F.col("normalized") + F.col("malformed") + (F.col("records") - F.col("malformed") - F.col("recognized"))
    return verdict(counted).withColumn("partial_failures", F.when(F.col("verdict") == "failed", F.lit(0)).otherwise(lost))
