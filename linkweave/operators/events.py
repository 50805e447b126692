"""Reductions of run event logs. Events: (run_id, seq, type, call_id, status, action, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import bounded_text, filled, quoted, strip, when
from linkweave.operators.ordered import WIDTH, carried_lag, carried_sum

# Event types that are shown but not kept.
TRANSIENT = ("token", "reasoning", "model_call", "progress_message")


def persistent_events(events: DataFrame) -> DataFrame:
    """Events worth keeping. A plain filter, so it also runs on a stream."""
    return events.where(
        f"type NOT IN ({quoted(TRANSIENT)}) AND NOT (type = 'file_operation' AND coalesce(status, '') = 'streaming')"
    )


def reconcile(events: DataFrame, ledger: DataFrame, limit: int = 4000) -> DataFrame:
    """Running events take the final status of their call from the ledger (one row per call id).

    Works on a stream against a static ledger too.
    """
    final = ledger.where("status IN ('succeeded', 'failed') AND coalesce(call_id, '') <> ''").selectExpr(
        "run_id", "call_id", "status AS final_status", "summary AS final_summary", "error AS final_error"
    )
    joined = events.join(final, ["run_id", "call_id"], "left")
    closes = "status = 'running' AND final_status IS NOT NULL"
    done = f"{closes} AND final_status = 'succeeded'"
    failed = f"{closes} AND final_status = 'failed'"
    kept = [c for c in events.columns if c not in ("status", "output", "error")]
    return joined.selectExpr(
        *kept,
        f"if({closes}, final_status, status) AS status",
        f"if({done}, left(coalesce(final_summary, ''), {limit}), output) AS output",
        when((done, "NULL"), (failed, f"left(coalesce(final_error, ''), {limit})"), otherwise="error") + " AS error",
    )


def progress_text(events: DataFrame, limit: int = 4000) -> DataFrame:
    """Adds `text`: the explicit message, else the plan as a numbered list, else result, check and next step.

    Needs message, action, objective, title, summary, result, verification, next_step, work_items (titles).
    """
    # Wordings of progress messages.
    opening = "'我已经理解目标，正在按下面的步骤推进。'"
    compacted = "'当前阶段和检查点已经保存，我会在新的上下文中继续同一任务。'"
    blocked = "'当前任务需要补充一项信息后才能继续。'"
    titles = "filter(transform(coalesce(work_items, cast(array() as array<string>)), t -> trim(t)), t -> t <> '')"
    numbered = f"array_join(transform({titles}, (t, i) -> concat(i + 1, '. ', t)), '\\n')"
    plan = (
        f"concat(coalesce({filled('objective')}, {filled('summary')}, {opening}),"
        f" if(size({titles}) > 0, concat('\\n\\n', {numbered}), ''),"
        f" coalesce(concat('\\n\\n接下来：', {filled('next_step')}), ''))"
    )
    # the plan's parts are joined as they are: a list starts with one line feed of its own
    plan = plan.replace("'\\n\\n'", "'\\n'", 1).replace("\\n\\n接下来", "\\n接下来")
    lead = f"coalesce({filled('result')}, {filled('summary')}, {filled('title')}, '')"
    parts = (
        f"concat_ws('\\n\\n', nullif({lead}, ''),"
        f" if(coalesce({filled('verification')}, '') <> '' AND NOT contains({lead}, {strip('verification')}),"
        f" concat('验收：', {strip('verification')}), NULL),"
        f" concat('下一步：', {filled('next_step')}))"
    )
    step = when(
        (f"{parts} = '' AND act = 'compact'", compacted), (f"{parts} = '' AND act = 'block'", blocked), otherwise=parts
    )
    acted = events.selectExpr("*", f"lower(coalesce({filled('action')}, 'update')) AS act")
    text = f"coalesce({filled('message')}, if(act = 'plan', {plan}, {step}))"
    return acted.selectExpr("* EXCEPT (act)", f"left({text}, {limit}) AS text")


# Actions that show a progress message.
SHOWN_ACTIONS = ("plan", "start", "update", "block", "compact")


def new_progress(events: DataFrame, width: int = WIDTH) -> DataFrame:
    """Progress events that differ from the progress shown just before them in the same run."""
    shown = events.where(f"type = 'agent_progress' AND action IN ({quoted(SHOWN_ACTIONS)}) AND text <> ''")
    fields = ["action", "work_item_id", "text"]
    marked = carried_lag(shown, ["run_id"], "seq", fields, width)
    again = " AND ".join(f"prev_{f} <=> {f}" for f in fields)
    return marked.where(f"is_first OR NOT ({again})").select(*events.columns)


def activity_slices(events: DataFrame, messages: DataFrame, width: int = WIDTH) -> DataFrame:
    """Number of the message each event belongs to: the events since the last message go with the next one.

    messages: (run_id, seq) of the shown messages, each at the sequence number of its own event. Events
    after the last message get number n+1.
    """
    shown = messages.selectExpr("run_id", "seq", "1 AS is_message")
    marked = events.select("run_id", "seq").join(shown, ["run_id", "seq"], "left").selectExpr(
        "run_id", "seq", "coalesce(is_message, 0) AS is_message"
    )
    counted = carried_sum(marked, ["run_id"], "seq", "is_message", "upto", width)
    return counted.selectExpr("run_id", "seq", "upto - is_message + 1 AS message_no")


def latest_per_key(events: DataFrame, keys: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """Newest event of each key: one maximum per group, combined before the shuffle."""
    packed = f"max_by(struct({', '.join(values)}), {order})"
    return events.groupBy(*keys).agg(F.expr(f"{packed} AS latest")).select(*keys, "latest.*")


def merge_calls(events: DataFrame, keys: list[str], fields: list[str], order: str = "seq") -> DataFrame:
    """Events of one call folded into one row: each field keeps its newest value that is not null."""
    folds = [F.expr(f"max_by({f}, {order}) FILTER (WHERE {f} IS NOT NULL) AS {f}") for f in fields]
    return events.groupBy(*keys).agg(
        F.min(order).alias("first_seq"), F.max(order).alias("last_seq"), F.count(F.lit(1)).alias("events"), *folds
    )


def technical_groups(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls of one group: their number, the status that matters most, and the call that shows it."""
    ranked = calls.where("type <> 'file_operation'").selectExpr(
        "*", when(("status = 'running'", "2"), ("status = 'failed'", "1"), otherwise="0") + " AS weight"
    )
    grouped = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), F.max("weight").alias("weight"),
        F.expr("max_by(call_id, struct(weight, first_seq)) AS shown_call"),
    )
    status = when(("weight = 2", "'running'"), ("weight = 1", "'failed'"), otherwise="'succeeded'")
    return grouped.selectExpr(*keys, "calls", f"{status} AS status", "shown_call")


def file_activities(events: DataFrame, keep: int = 5) -> DataFrame:
    """Newest file events of each run, one per path, newest paths first."""
    files = events.where(f"type = 'file_operation' AND {strip('path')} <> ''")
    newest = files.selectExpr("*", "row_number() OVER (PARTITION BY run_id, path ORDER BY seq DESC) AS copy").where("copy = 1")
    ranked = newest.selectExpr("*", "row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rank")
    return ranked.where(f"rank <= {keep}").selectExpr(
        "run_id", "rank", "path", "coalesce(nullif(operation, ''), 'manage') AS operation",
        "coalesce(nullif(status, ''), 'completed') AS status",
    )


def run_summary(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Latest progress text of a run, else how many of its calls succeeded and failed."""
    text = "coalesce(nullif(summary, ''), nullif(result, ''), nullif(title, ''), nullif(next_step, ''))"
    latest = events.groupBy("run_id").agg(
        F.expr(f"max_by(struct({text} AS text), seq) FILTER (WHERE type = 'agent_progress') AS latest")
    )
    counts = calls.groupBy("run_id").agg(
        F.expr("count_if(status = 'succeeded') AS succeeded"), F.expr("count_if(status = 'failed') AS failed")
    )
    # Wordings of run summaries.
    direct = "'模型完成直接回复，未调用外部能力。'"
    counted = "format_string('Agent 完成回复；能力调用成功 %d 个，失败 %d 个。', succeeded, failed)"
    return latest.join(counts, "run_id", "left").selectExpr(
        "run_id", "coalesce(succeeded, 0) AS succeeded", "coalesce(failed, 0) AS failed",
        f"left(coalesce({filled('latest.text')}, if(succeeded IS NULL, {direct}, {counted})), 500) AS summary",
    )


def manifest_tails(events: DataFrame, calls: DataFrame, progress: int = 8, results: int = 8) -> DataFrame:
    """Last progress lines and last call results per task, oldest first within the tail."""
    steps = events.where("type IN ('agent_progress', 'plan', 'task_handoff')").selectExpr(
        "*", "row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS back"
    ).where(f"back <= {progress} AND type <> 'plan'")
    said = "coalesce(nullif(summary, ''), nullif(result, ''), nullif(title, ''), nullif(next_step, ''), '')"
    lines = steps.selectExpr(
        "task_id", "'progress' AS part", "seq",
        f"if(type = 'task_handoff', left(trim(coalesce(summary, '')), 360), left(trim({said}), 500)) AS body",
        "if(type = 'task_handoff', 'handoff', coalesce(nullif(action, ''), nullif(status, ''), 'update')) AS tag",
    ).where("body <> ''")
    spoken = calls.selectExpr("*", "coalesce(nullif(summary, ''), nullif(error, ''), '') AS body").where("trim(body) <> ''")
    tail = spoken.selectExpr("*", "row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS back").where(f"back <= {results}")
    told = tail.selectExpr("task_id", "'result' AS part", "seq", "left(body, 500) AS body", "coalesce(status, 'done') AS tag")
    return lines.unionByName(told).selectExpr("task_id", "part", "seq", "concat('  - [', tag, '] ', body) AS line")


def last_distinct(events: DataFrame, key: str, item: str, keep: int, order: str = "seq") -> DataFrame:
    """Distinct items of each key by first appearance, the last `keep` of them."""
    first = events.where(f"{strip(item)} <> ''").groupBy(key, F.expr(f"{strip(item)} AS item")).agg(F.min(order).alias("first_seq"))
    back = first.selectExpr("*", f"row_number() OVER (PARTITION BY {key} ORDER BY first_seq DESC, item DESC) AS back")
    return back.where(f"back <= {keep}").select(key, "item", "first_seq")


def assemble_fragments(fragments: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Fragments (name, arguments) of each call joined in the order of arrival; bad JSON is kept raw.

    A group is the text of one call, so its size is that of one message.
    """
    def joined(field: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order}, {field}))), f -> coalesce(f.{field}, '')), '')"

    whole = fragments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fragments"), F.expr(f"{joined('name')} AS name"), F.expr(f"{joined('arguments')} AS raw")
    ).where("name <> ''")
    packed = "coalesce(nullif(raw, ''), '{}')"
    valid = f"try_parse_json({packed})"
    arguments = when(
        (f"{valid} IS NULL", "to_json(named_struct('_raw', raw))"),
        (f"left(ltrim({packed}), 1) = '{{'", packed),
        otherwise=f"concat('{{\"value\":', {packed}, '}}')",
    )
    return whole.selectExpr(*keys, "fragments", "name", f"{arguments} AS arguments", f"{valid} IS NOT NULL AS parsed")


def bounded_history(messages: DataFrame, budget: int = 32_000, per_message: int = 12_000) -> DataFrame:
    """Newest messages of each session that fit a character budget, each cut in the middle if too long.

    A message costs min(length, limit), the budget runs out at a prefix of the newest-first order, and the
    last one that fits is cut to what is left: one running sum, no loop.
    """
    # Fixed value: mark of a cut message.
    marker = "\\n\\n[Earlier message content omitted by context budget]\\n\\n"
    mark = f"'{marker}'"
    budget = max(1_000, budget)
    back = "PARTITION BY session_id ORDER BY seq DESC"
    # every message that is kept costs a character or more, so no more than `budget` of them matter
    newest = messages.where("coalesce(content, '') <> ''").selectExpr("*", f"row_number() OVER ({back}) AS back").where(f"back <= {budget}")
    cost = f"least(char_length(coalesce(content, '')), {per_message})"
    spent = f"coalesce(sum({cost}) OVER ({back} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    kept = newest.selectExpr("*", f"{spent} AS spent").where(f"spent < {budget}")
    sized = kept.selectExpr("*", f"int(least({per_message}, {budget} - spent)) AS room").selectExpr(
        "*", f"greatest(room - char_length({mark}), 0) AS free"
    ).selectExpr("*", "int(floor(free / 3)) AS head")
    text = f"if(char_length(content) <= room, content, concat(left(content, head), {mark}, right(content, free - head)))"
    return sized.selectExpr("session_id", "seq", "role", f"{text} AS content")


def request_sizes(messages: DataFrame, limit: int = 1_000, role: str = "system") -> DataFrame:
    """Characters one role contributes to each conversation, and whether that is over the limit."""
    sizes = messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.expr(f"coalesce(sum(if(lower(role) = '{role}', char_length(content), 0)), 0) AS role_chars"),
    )
    return sizes.selectExpr("*", f"role_chars > {limit} AS exceeded")


def listing_changes(before: DataFrame, after: DataFrame, keep: int = 50) -> DataFrame:
    """Creates, edits and deletes between two listings (path, modified, size), the first fifty in order."""
    b = before.selectExpr("path", "modified AS b_modified", "size AS b_size")
    a = after.selectExpr("path", "modified AS a_modified", "size AS a_size")
    joined = b.join(a, "path", "full_outer")
    operation = when(
        ("b_size IS NULL", "'create'"), ("a_size IS NULL", "'delete'"),
        ("b_modified <> a_modified OR b_size <> a_size", "'edit'"),
    )
    changed = joined.selectExpr("path", f"{operation} AS operation").where("operation IS NOT NULL")
    # creates, edits and deletes in turn; a top-n, so each task keeps its own best first
    placed = changed.selectExpr("*", "position(operation IN 'create edit delete') AS place")
    first = placed.orderBy("place", "path").limit(keep)
    return first.selectExpr("row_number() OVER (ORDER BY place, path) AS n", "operation", "path")


# Rate limits, ledgers and folds --------------------------------------------------------------------


def ledger_state(calls: DataFrame) -> DataFrame:
    """What an exactly-once ledger answers for each (scope, call_id) after all attempts.

    calls: (scope, call_id, seq, name, arguments, status, result, retry_safe). The first attempt fixes the
    input; one with other input is a collision; a success is replayed from then on.
    """
    keyed = calls.selectExpr("*", "sha2(concat_ws('\\0', name, arguments), 256) AS input")
    grouped = keyed.groupBy("scope", "call_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.min_by("input", "seq").alias("first_input"),
        F.expr("min(struct(seq, result)) FILTER (WHERE status = 'succeeded') AS success"),
        F.expr("max_by(status, seq) AS last_status"),
        F.expr("bool_and(retry_safe) AS retry_safe"),
        F.expr("min(input) <> max(input) AS collision"),
    )
    state = when(
        ("success IS NOT NULL", "'succeeded'"), ("last_status IN ('running', 'failed') AND retry_safe", "'retryable'"),
        otherwise="'uncertain'",
    )
    return grouped.selectExpr(
        "scope", "call_id", "attempts", f"{state} AS state", "collision", "success.result AS result"
    )


def ledger_answers(calls: DataFrame) -> DataFrame:
    """Answer to every single attempt: execute, replay, retry, collision or uncertain.

    Only three numbers per call decide: its first attempt, that one's input and its first success. They are
    plain aggregates, so a call repeated a billion times is combined before the shuffle.
    """
    keyed = calls.selectExpr("*", "sha2(concat_ws('\0', name, arguments), 256) AS input")
    first = keyed.groupBy("scope", "call_id").agg(
        F.min("seq").alias("first_seq"), F.min_by("input", "seq").alias("first_input")
    )
    opened = keyed.join(first, ["scope", "call_id"])
    success = opened.where("status = 'succeeded' AND input = first_input").groupBy("scope", "call_id").agg(
        F.min("seq").alias("success_seq")
    )
    answer = when(
        ("seq = first_seq", "'execute'"), ("input <> first_input", "'collision'"), ("success_seq < seq", "'replay'"),
        ("retry_safe", "'retry'"), otherwise="'uncertain'",
    )
    return opened.join(success, ["scope", "call_id"], "left").selectExpr("scope", "call_id", "seq", f"{answer} AS answer")


def live_sessions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Account of each request's token where the session has not expired at the time of the request."""
    return requests.join(sessions, "token").where("expires_at > at").select(*requests.columns, "account_id")


def expired(rows: DataFrame, now: str, attempts: int | None = None) -> DataFrame:
    """Rows past their time to live, or locked after too many attempts."""
    test = f"expires_at <= {now}"
    if attempts is not None:
        test = f"({test}) OR attempts >= {attempts}"
    return rows.where(test)
