"""The retry queue: a filing that failed for a passing reason waits in keyed state, and its timer fires when it is due.

Time is that of the outcomes (event time), so a replay of the same outcomes gives the
same queue. Whoever extracts reads the rows of status due, and sends the outcome back in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..sources.keyed import KeyedTable

HOUR_MS = 3_600_000
ROWS = "key string, at_ms long, status string, retry_count int, next_ms long, error string"
#: Retries so far, when the next one is due (null: none waits) and why.
STATE = "retry_count int, due_ms long, error string"


def _advance(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, due, why = state.get if state.exists else (0, None, None)
    out = []
    if state.hasTimedOut:
        out.append((key[0], due, "due", count, None, why))
        state.update((count, None, why))
    else:
        for r in pd.concat(list(batches)).sort_values("at_ms", kind="stable").itertuples():
            if due is not None and r.at_ms >= due:  # its outcome came in before the timer could fire
                out.append((key[0], due, "due", count, None, why))
                due = None
            if r.outcome == "parsed":
                count, due, why = 0, None, None
                out.append((key[0], r.at_ms, "parsed", count, None, None))
            elif r.transient and count < text.MAX_RETRIES:
                due, why = r.at_ms + min(2**count, text.LONGEST_WAIT_HOURS) * HOUR_MS, r.error
                count += 1
                out.append((key[0], r.at_ms, "retry_scheduled", count, due, why))
            else:
                due, why = None, f"{r.error}:retries_exhausted" if r.transient else r.error
                out.append((key[0], r.at_ms, "failed", count, None, why))
        if count == 0 and due is None:
            state.remove()
        else:
            state.update((count, due, why))
            if due is not None:
                state.setTimeoutTimestamp(max(int(due), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["key", "at_ms", "status", "retry_count", "next_ms", "error"]).astype({"at_ms": "Int64", "next_ms": "Int64", "retry_count": "Int32"})


def retry_queue(outcomes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """What becomes of filings, from a stream of their outcomes (key, at, outcome: parsed or failed, error): key, at, status, retry_count, next_retry_at, error.

    A transient failure is scheduled again after 1, 2, 4, ... hours (a day at most), five
    times; when its time has come the filing is due. Other failures, and those whose retries are used
    up, are failed; parsed filings leave the queue. Outcomes may come late by `late`, by which timers fire later.
    """
    rows = outcomes.select(
        "key", "at", F.unix_millis("at").alias("at_ms"), "outcome", "error", (text.failure_class(F.col("error")) == "transient").alias("transient"),
    ).withWatermark("at", late)
    found = rows.groupBy("key").applyInPandasWithState(_advance, ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", F.timestamp_millis("at_ms").alias("at"), "status", "retry_count", F.timestamp_millis("next_ms").alias("next_retry_at"), "error")


def run_queue(queue: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Keeps the newest row of each filing in the keyed table at path, for what there is now, and ends. A repeated batch changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        KeyedTable(batch.sparkSession, path, ["key"], buckets).upsert(batch, [F.desc("at"), F.desc("retry_count"), F.col("status") == "retry_scheduled"])

    return queue.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
