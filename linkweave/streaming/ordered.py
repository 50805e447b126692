"""Streams in event order: rows wait in state until the watermark has passed them, whatever the order in which they came.

Keys are dealt into buckets, and a bucket holds the rows of its keys that may still be overtaken, so no more than arrive within the
allowed lateness, and a timer. Once the watermark has passed a row nothing older can come, and the rows up to it are folded key by key in
order of time and `seq`: the answers are those of a batch over the same rows. Calls to the state store are made per bucket and batch, not
per key. Rows later than that never reach a bucket; `counts_with_late` shows how to keep such rows aside.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from linkweave.operators.folds import ACTION_STATUS, FIELD_CHARS, GAP, PER_WINDOW, WINDOW, next_answer, unique_tail

BUCKETS = 1024
"""Buckets that keys are dealt into. What waits in one is in the memory of a task."""

ROWS_OUT = 1 << 14
"""Rows of a result handed on at a time."""

_WAITING = pa.schema([("key", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("body", pa.string())])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


class InEventOrder(StatefulProcessor):
    """Releases the rows of the keys of a bucket, each key's in order of (ts, seq). `fields`: the columns a step needs; `out`: those it returns."""

    fields: tuple[str, ...] = ()
    out: tuple[str, ...] = ()

    def step(self, key: tuple, state: dict, row: dict) -> tuple | None:
        """Changes the state of a key by one row and returns a row of the result, or nothing."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.states = handle.getMapState("states", "key string", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, parts = None, []
        for batch in rows:
            low = int(batch["at"].min())
            first = low if first is None else min(first, low)
            parts.append((_packed(pa.Table.from_pandas(batch[_WAITING.names], _WAITING, preserve_index=False)),))
        if parts:
            self.waiting.appendList(parts)
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.waiting.exists():
            return
        held = pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()])
        passed = pc.less_equal(held["at"], due)
        ready, rest = held.filter(passed).sort_by([(c, "ascending") for c in ("key", "at", "seq")]), held.filter(pc.invert(passed))
        if not len(ready):
            return
        if len(rest):
            self.waiting.put([(_packed(rest),)])
            self._wake(pc.min(rest["at"]).as_py())
        else:
            self.waiting.clear()
        found = []
        for name, own in groupby(_rows(ready), key=lambda r: r[0]):
            place, old = tuple(json.loads(name).values()), self.states.getValue((name,))
            state = json.loads(old[0]) if old else {}
            for _, at, seq, body in own:
                given = json.loads(body) if self.fields else {}
                found.append(self.step(place, state, {"at": at, "seq": seq, **{f: given.get(f) for f in self.fields}}))
            self.states.updateValue((name,), (json.dumps(state),))
            found = [f for f in found if f is not None] if None in found else found
            if len(found) >= ROWS_OUT:
                yield pd.DataFrame(found, columns=list(self.out))
                found = []
        if found:
            yield pd.DataFrame(found, columns=list(self.out))

    def close(self) -> None:
        pass


def _rows(table: pa.Table) -> Iterator[tuple]:
    for batch in table.to_batches(ROWS_OUT):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class LedgerCalls(InEventOrder):
    """An exactly-once ledger of one (scope, call_id): the first input, whether it has succeeded, and the result to replay."""

    fields = ("name", "arguments", "status", "retry_safe", "result")
    out = ("scope", "call_id", "seq", "answer", "result")

    def step(self, key, state, row):
        given = hashlib.sha256("\0".join(str(row[f]) for f in ("name", "arguments") if row[f] is not None).encode()).hexdigest()
        if "input" not in state:
            state["input"], answer = given, "execute"
        elif given != state["input"]:
            answer = "collision"
        elif "result" in state:
            answer = "replay"
        else:
            answer = "retry" if row["retry_safe"] else "uncertain"
        known = state.get("result") if answer == "replay" else None
        if row["status"] == "succeeded" and given == state["input"] and "result" not in state:
            state["result"] = row["result"]
        return (*key, row["seq"], answer, known)


class CodeRequestsInOrder(InEventOrder):
    """Accepts or refuses the code requests of one user in the order of their times."""

    out = ("user_id", "at", "seq", "accepted", "retry_after")

    def step(self, key, state, row):
        at = row["at"] / 1e6
        ok, wait, state["times"] = next_answer(state.get("times", []), at, GAP, WINDOW, PER_WINDOW)
        return (key[0], at, row["seq"], ok, wait)


class ProgressInOrder(InEventOrder):
    """Folds the progress events of one task; each released event gives the state after it."""

    fields = ("action", "artifact", *FIELD_CHARS)
    out = ("task_id", "revision", "status", *FIELD_CHARS, "artifacts")

    def step(self, key, state, row):
        state["revision"] = state.get("revision", 0) + 1
        state["status"] = ACTION_STATUS.get(row["action"], "running")
        for field, limit in FIELD_CHARS.items():
            text = str(row[field] or "").strip()[:limit]
            if text:
                state[field] = text
        state["artifacts"] = unique_tail(state.get("artifacts", []), [row["artifact"] or ""])
        return (key[0], state["revision"], state["status"], *(state.get(f, "") for f in FIELD_CHARS), json.dumps(state["artifacts"]))


def _in_order(rows: DataFrame, keys: list[str], processor: InEventOrder, schema: str, late: str) -> DataFrame:
    timed = rows.select(*keys, "ts", "seq", *processor.fields).withWatermark("ts", late)
    key, body = (f"to_json(struct({', '.join(names)}), map('ignoreNullFields', 'false'))" if names else "''" for names in (keys, processor.fields))
    first = -(1 << 63) + 1000  # rows without a time come first
    packed = timed.selectExpr(
        f"pmod(xxhash64({', '.join(keys)}), {BUCKETS}) AS bucket", f"{key} AS key", "ts", f"coalesce(unix_micros(ts), {first}L) AS at", "bigint(seq) AS seq",
        f"{body} AS body",
    )
    return packed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime"
    )


def ledger_stream(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answer to every attempt (scope, call_id, ts, seq, name, arguments, status, result, retry_safe), with the stored result of a replay."""
    return _in_order(calls, ["scope", "call_id"], LedgerCalls(), "scope long, call_id string, seq long, answer string, result string", late)


def ordered_rate_limits(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answers to code requests (user_id, ts, seq)."""
    return _in_order(requests, ["user_id"], CodeRequestsInOrder(), "user_id long, at double, seq long, accepted boolean, retry_after long", late)


def ordered_progress(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The state of each task after each of its progress events (task_id, ts, seq, action, fields, artifact)."""
    fields = ", ".join(f"{f} string" for f in FIELD_CHARS)
    return _in_order(events, ["task_id"], ProgressInOrder(), f"task_id long, revision long, status string, {fields}, artifacts string", late)
