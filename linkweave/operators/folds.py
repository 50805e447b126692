"""Ordered folds whose steps depend on earlier answers: rate limits and progress states."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import when
from linkweave.operators.ordered import carried_lag, carried_max

GAP = 60.0
WINDOW = 3600.0
PER_WINDOW = 5

ANSWER = "user_id long, at double, requests long, accepted boolean, retry_after long"


def next_answer(accepted: list[float], at: float, gap: float = GAP, window: float = WINDOW, most: int = PER_WINDOW):
    """(accepted?, seconds to wait, accepted times that still matter) for one request."""
    if accepted:
        wait = math.ceil(gap - (at - accepted[-1]))
        if wait > 0:
            return False, wait, accepted
    recent = [a for a in accepted if a >= at - window]
    if len(recent) >= most:
        return False, max(1, math.ceil(window - (at - recent[0]))), accepted
    return True, 0, (recent + [at])[-most:]


def rate_limit(requests: DataFrame, gap: float = GAP, window: float = WINDOW, most: int = PER_WINDOW) -> DataFrame:
    """Answers to code requests (user_id, at): only accepted ones count, so each answer needs those before.

    Requests of one instant are combined first: at most the first of them can pass. After an idle hour
    nothing is remembered, so every busy stretch of a user is a group of its own; a stretch runs through
    its task as a stream of batches that keeps five numbers.
    """
    instants = requests.groupBy("user_id", "at").agg(F.count(F.lit(1)).alias("requests"))
    timed = carried_lag(instants, ["user_id"], "at", ["at"], width=int(window * 24))
    breaks = f"if(is_first OR at - prev_at > {window}, at, NULL)"
    opened = timed.selectExpr("user_id", "at", "requests", f"{breaks} AS opens")
    stretches = carried_max(opened, ["user_id"], "at", "opens", "stretch", width=int(window * 24))

    def fold(batches):
        current, accepted = None, []
        for batch in batches:
            answers = []
            for user, stretch, at in zip(batch["user_id"], batch["stretch"], batch["at"]):
                if (user, stretch) != current:
                    current, accepted = (user, stretch), []
                ok, wait, accepted = next_answer(accepted, at, gap, window, most)
                answers.append((ok, wait))
            yield pd.DataFrame({
                "user_id": batch["user_id"], "at": batch["at"], "requests": batch["requests"],
                "accepted": [a[0] for a in answers], "retry_after": [a[1] for a in answers],
            })

    placed = stretches.repartition("user_id", "stretch").sortWithinPartitions("user_id", "stretch", "at")
    return placed.select("user_id", "stretch", "at", "requests").mapInPandas(fold, ANSWER)


# State a task is in after each action.
ACTION_STATUS = {"complete": "completed", "block": "blocked", "plan": "planned", "compact": "continuing"}
# Longest text kept of each field.
FIELD_CHARS = {
    "objective": 1000, "title": 240, "summary": 2000, "why": 1200, "result": 2000, "verification": 1200, "next_step": 1200,
}
LAST_ARTIFACTS = 20


def fold_progress(events: DataFrame, fields: dict[str, int] = FIELD_CHARS) -> DataFrame:
    """State of each task (task_id) after all its progress events (seq, action, fields, artifact).

    Every field keeps its newest text that is not blank: one maximum per field, combined before the shuffle.
    """
    folds = [
        F.expr(f"max_by(left(trim({f}), {n}), seq) FILTER (WHERE trim(coalesce({f}, '')) <> '') AS {f}")
        for f, n in fields.items()
    ]
    grouped = events.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("revision"), F.expr("max_by(action, seq) AS last_action"), *folds
    )
    status = when(*[(f"last_action = '{a}'", f"'{s}'") for a, s in ACTION_STATUS.items()], otherwise="'running'")
    return grouped.selectExpr(
        "task_id", "revision", f"{status} AS status", *[f"coalesce({f}, '') AS {f}" for f in fields]
    )


def work_item_status(events: DataFrame) -> DataFrame:
    """Status of each work item (task_id, work_item_id) after its newest event that sets one."""
    done = "trim(coalesce(result, '')) <> '' AND trim(coalesce(verification, '')) <> ''"
    status = when(
        ("action = 'start'", "'running'"), ("action = 'update'", f"if({done}, 'completed', 'running')"),
        ("action = 'complete'", "'completed'"), ("action = 'block'", "'blocked'"),
    )
    rows = events.selectExpr("task_id", "work_item_id", "seq", f"{status} AS status").where(
        "status IS NOT NULL AND coalesce(work_item_id, '') <> ''"
    )
    return rows.groupBy("task_id", "work_item_id").agg(
        F.count(F.lit(1)).alias("events"), F.expr("max_by(status, seq) AS status")
    )


def unique_tail(existing: list[str], new: list[str], keep: int = LAST_ARTIFACTS, limit: int = 500) -> list[str]:
    """Distinct texts in order of appearance, the last `keep` of them."""
    seen: dict[str, None] = {}
    for item in [*existing, *new]:
        text = (item or "").strip()[:limit]
        if text:
            seen.setdefault(text)
    return list(seen)[-keep:]
