"""State processors for streams: rate limits and progress states, kept per key in the state store."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from linkweave.operators.folds import (
    ACTION_STATUS,
    FIELD_CHARS,
    GAP,
    PER_WINDOW,
    WINDOW,
    next_answer,
    unique_tail,
)


class CodeRequests(StatefulProcessor):
    """Accepts or refuses code requests of one user; remembers the accepted times of the last hour."""

    def __init__(self, gap: float = GAP, window: float = WINDOW, most: int = PER_WINDOW, ttl_ms: int | None = None) -> None:
        self.rule = (gap, window, most)
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # at most five times per user; with a time to live it dies once nothing in it can matter
        self.accepted = handle.getValueState("accepted", "times array<double>", self.ttl_ms)

    def handleInputRows(self, key, rows, timer_values):
        times = list(self.accepted.get()[0]) if self.accepted.exists() else []
        for batch in rows:
            out = []
            for at in sorted(batch["at"]):
                ok, wait, times = next_answer(times, at, *self.rule)
                out.append((key[0], at, ok, wait))
            yield pd.DataFrame(out, columns=["user_id", "at", "accepted", "retry_after"])
        self.accepted.update((times,))

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, expire: bool = False) -> DataFrame:
    """Streaming twin of the batch rate limit: (user_id, at) -> answers. Arrival order decides.

    `expire` lets idle users' state die by wall-clock time. It is for jobs that keep running: with a clock
    there is always one more batch to run, so such a stream never ends by itself.
    """
    return requests.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=CodeRequests(ttl_ms=int(WINDOW * 1000) if expire else None),
        outputStructType="user_id long, at double, accepted boolean, retry_after long",
        outputMode="append", timeMode="processingTime" if expire else "none",
    )


class ProgressState(StatefulProcessor):
    """Folds progress events of one task into its state; one row out per batch of events.

    Each field, and the status, keeps the `seq` of the event that set it, so events may come in any order and the
    newest wins. Artifacts stand in order of arrival.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "body string")

    def handleInputRows(self, key, rows, timer_values):
        state = json.loads(self.state.get()[0]) if self.state.exists() else {"revision": 0, "artifacts": [], "at": {}}
        at = state["at"]

        def newer(field, seq):
            if seq < at.get(field, seq):
                return False
            at[field] = int(seq)
            return True

        for batch in rows:
            for event in batch.sort_values("seq").to_dict("records"):
                state["revision"] += 1
                if newer("status", event["seq"]):
                    state["status"] = ACTION_STATUS.get(event["action"], "running")
                for field, limit in FIELD_CHARS.items():
                    text = str(event.get(field) or "").strip()[:limit]
                    if text and newer(field, event["seq"]):
                        state[field] = text
                state["artifacts"] = unique_tail(state["artifacts"], [event.get("artifact") or ""])
        self.state.update((json.dumps(state),))
        yield pd.DataFrame([{
            "task_id": key[0], "revision": state["revision"], "status": state.get("status", "planned"),
            **{f: state.get(f, "") for f in FIELD_CHARS}, "artifacts": json.dumps(state["artifacts"]),
        }])

    def close(self) -> None:
        pass


def fold_progress_stream(events: DataFrame) -> DataFrame:
    fields = ", ".join(f"{f} string" for f in FIELD_CHARS)
    return events.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=ProgressState(),
        outputStructType=f"task_id long, revision long, status string, {fields}, artifacts string",
        outputMode="update", timeMode="none",
    )
