"""Calls that wait for their results in a stream of log records.

A call and its result may lie in different micro-batches, so the pending call of each key is kept
as state. The rules are those of operators.pairing.pair_calls: a result takes the latest call of its
key before it, a call is used once, and one that repeats a pending call's key replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

_PAIR = "call_at bigint, call string, result_at bigint, result string"


def pair_stream(events: DataFrame, keys: list[str], wait_ms: int | None = None) -> DataFrame:
    """(keys, call_at, call, result_at, result) of a stream of events (keys, at, is_call, body), for append mode.

    ``at`` is the place in the source, ``body`` what the record says, null for nothing. A key's records must come in
    the order of their places from one micro-batch to the next, as lines that are appended to a log do; within one they may
    come in any. With ``wait_ms`` a call whose key has been silent for so long is let go as a row without a result, so
    calls that never end do not stay for good.
    """
    kinds = [StructField(k, events.schema[k].dataType) for k in keys]
    output = StructType([*kinds, *StructType.fromDDL(_PAIR)])
    names = output.names

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, *pending, None, None)], columns=names)
            return
        rows = [r for b in batches for r in b[["at", "is_call", "body"]].itertuples(index=False)]
        out = []
        for r in sorted(rows, key=lambda r: (r.at, r.is_call)):  # at one place a result comes before a call
            body = None if pd.isna(r.body) else r.body
            if r.is_call:
                pending = (int(r.at), body)
            elif pending is not None:
                out.append((*key, *pending, int(r.at), body))
                pending = None
        if pending is not None:
            state.update(pending)
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy(*keys).applyInPandasWithState(run, output, "at bigint, body string", "append", timeout)
