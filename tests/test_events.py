"""Event reductions, ordered windows, folds and claim rules against fixtures or plain Python."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from linkweave.operators import claims as V
from linkweave.operators import events as E
from linkweave.operators import folds as H
from linkweave.operators import ordered as O
from linkweave.operators import preview as P
from linkweave.operators import records as N
from linkweave.session import cut_lineage, fresh_folder
from linkweave.streaming import jobs as J
from linkweave.streaming.ordered import ledger_stream
from linkweave.streaming.state import fold_progress_stream


def test_carried_values_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(k, s, rng.choice("ab")) for k in "xy" for s in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k string, s long, v string")
    plain = df.selectExpr(
        "k", "s", "lag(v) OVER (PARTITION BY k ORDER BY s) AS prev_v",
        "sum(int(v = 'a')) OVER (PARTITION BY k ORDER BY s) AS n", "max(if(v = 'a', s, NULL)) OVER (PARTITION BY k ORDER BY s) AS m",
    )
    lagged = O.carried_lag(df, ["k"], "s", ["v"], width=7)
    summed = O.carried_sum(lagged, ["k"], "s", "int(v = 'a')", "n", width=13)
    got = O.carried_max(summed, ["k"], "s", "if(v = 'a', s, NULL)", "m", width=29)
    assert sorted(map(str, got.select("k", "s", "prev_v", "n", "m").collect())) == sorted(map(str, plain.collect()))


def test_progress_suppression_and_reconciliation(spark):
    schema = "run_id string, seq long, type string, call_id string, status string, action string, work_item_id string, text string, output string, error string"
    rows = [
        ("r", 1, "agent_progress", "", "", "update", "w", "same", None, None),
        ("r", 2, "agent_progress", "", "", "update", "w", "same", None, None),
        ("r", 3, "token", "", "", "", "", "x", None, None),
        ("r", 4, "tool_call", "c1", "running", "", "", "", None, "old"),
        ("r", 5, "file_operation", "c2", "streaming", "", "", "", None, None),
        ("r", 6, "agent_progress", "", "", "update", "w", "other", None, None),
    ]
    events = spark.createDataFrame(rows, schema)
    assert [r["seq"] for r in E.new_progress(events, width=2).orderBy("seq").collect()] == [1, 6]
    assert [r["seq"] for r in E.persistent_events(events).orderBy("seq").collect()] == [1, 2, 4, 6]
    ledger = spark.createDataFrame([("r", "c1", "succeeded", "ok" * 3000, "")], "run_id string, call_id string, status string, summary string, error string")
    row = E.reconcile(events, ledger).where("seq = 4").first()
    assert (row["status"], len(row["output"]), row["error"]) == ("succeeded", 4000, None)
    shown = E.new_progress(events, width=2).select("run_id", "seq")
    assert {r["seq"]: r["message_no"] for r in E.activity_slices(events, shown, width=3).collect()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2}


def test_rate_limit_fixture(spark):
    at = [0.0, 30.0, 60.0, 120.0, 180.0, 240.0, 300.0]
    df = spark.createDataFrame([(1, t) for t in at], "user_id long, at double")
    got = {r["at"]: (r["accepted"], r["retry_after"]) for r in H.rate_limit(df).collect()}
    assert {t for t in at if got[t][0]} == {0.0, 60.0, 120.0, 180.0, 240.0}
    assert got[30.0] == (False, 30) and got[300.0] == (False, 3300)


def test_rate_limit_against_one_pass(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for user in (1, 2):
        t, accepted = 0.0, []
        for _ in range(150):
            t += rng.choice([5.0, 40.0, 70.0, 900.0, 4000.0])
            rows.append((user, t))
            ok, wait, accepted = H.next_answer(accepted, t)
            want[user, t] = (ok, wait)
    got = {(r["user_id"], r["at"]): (r["accepted"], r["retry_after"]) for r in H.rate_limit(spark.createDataFrame(rows, "user_id long, at double")).collect()}
    assert got == want


def bounded(history, budget):
    marker = "\n\n[Earlier message content omitted by context budget]\n\n"
    remaining, out = max(1000, budget), []
    for seq, content in reversed(history):
        if remaining <= 0:
            break
        limit = min(12_000, remaining)
        if len(content) > limit:
            free = max(0, limit - len(marker))
            head = free // 3
            content = content[:head] + marker + (content[-(free - head):] if free - head else "")
        if content:
            out.append((seq, content))
            remaining -= len(content)
    return sorted(out)


@pytest.mark.parametrize("sizes,budget", [([20_000, 500, 13_000], 32_000), ([300] * 9, 1000), ([0, 700, 0, 900], 1500)])
def test_bounded_history(spark, sizes, budget):
    rows = [("s", i, "user", "".join(chr(97 + (i + j) % 26) for j in range(n))) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "session_id string, seq long, role string, content string")
    got = sorted((r["seq"], r["content"]) for r in E.bounded_history(df, budget).collect())
    assert got == bounded([(r[1], r[3]) for r in rows], budget)


def test_ledger_answers(spark):
    rows = [
        ("s", "c", 1, "t", "{}", "failed", "", True), ("s", "c", 2, "t", "{}", "succeeded", "ok", True), ("s", "c", 3, "t", "{}", "running", "", True),
        ("s", "c", 4, "t", "{1}", "running", "", True), ("s", "d", 5, "t", "{}", "failed", "", False), ("s", "d", 6, "t", "{}", "failed", "", False),
    ]
    df = spark.createDataFrame(rows, "scope string, call_id string, seq long, name string, arguments string, status string, result string, retry_safe boolean")
    got = {r["seq"]: r["answer"] for r in E.ledger_answers(df).collect()}
    assert got == {1: "execute", 2: "retry", 3: "replay", 4: "collision", 5: "execute", 6: "uncertain"}
    state = {r["call_id"]: (r["state"], r["collision"], r["result"]) for r in E.ledger_state(df).collect()}
    assert state == {"c": ("succeeded", True, "ok"), "d": ("uncertain", False, None)}


def test_listing_changes(spark):
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, modified long, size long")
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, modified long, size long")
    assert [(r["operation"], r["path"]) for r in E.listing_changes(before, after).orderBy("n").collect()] == [("create", "d"), ("edit", "b"), ("delete", "c")]


def test_header_row(spark):
    rows = [("s", 0, ["Report 2024"]), ("s", 1, ["id", "name", "mail"]), ("s", 2, ["1", "ann", "2"])]
    df = spark.createDataFrame(rows, "table_id string, row_idx int, cells array<string>")
    assert P.header_rows(df).first()["header_row"] == 2
    repeated = spark.createDataFrame([("s", 0, ["id", "name", "id"])], df.schema)
    names = [r["name"] for r in P.inferred_headers(repeated).orderBy("position").collect()]
    assert names == ["id", "name", "id_2"]


def test_merged_items_and_decisions(spark):
    old = spark.createDataFrame([("t", "a", 1, "A", "x"), ("t", "b", 2, "", "y")], "task string, id string, seq long, title string, why string")
    new = spark.createDataFrame([("t", "a", 3, "", "z"), ("t", "c", 4, "C", "")], "task string, id string, seq long, title string, why string")
    got = [(r["id"], r["title"], r["why"]) for r in N.merge_items(old, new, ["task", "id"], ["title", "why"]).orderBy("n").collect()]
    assert got == [("a", "A", "z"), ("c", "C", "")]
    df = spark.createDataFrame([("Approve",), ("approve? Deny",), ("",)], "a string")
    assert [r[0] for r in df.selectExpr(N.decision("a")).collect()] == ["approve", "reject", "reject"]


def read_branches(chain, branches, node_types, returns):
    """Pass after pass over the branches in order; what the relaxation in Spark must reproduce."""
    attached, pending, bad = set(chain), list(branches), set()
    while pending:
        moved = False
        for branch in list(pending):
            name, origin, path = branch
            if origin not in attached:
                continue
            end = path[-1]
            back = any(a == end and b in attached for a, b in returns)
            if end not in attached and node_types.get(end) not in ("output", "state", "object") and not back:
                bad.add(("branch_end", name))
            attached.update(path)
            pending.remove(branch)
            moved = True
        if not moved:
            return bad | {("branch_unattached", b[0]) for b in pending}
    return bad


def test_branch_rules_against_passes(spark):
    rng = random.Random(11)
    chain_rows, branch_rows, node_rows, edge_rows, want = [], [], [], [], set()
    for g in range(12):
        nodes = {f"n{i}": rng.choice(["output", "activity", "activity", "rule"]) for i in range(9)}
        chain = ["n0", "n1"]
        branches = [(f"b{i}", f"n{rng.randrange(9)}", [f"n{rng.randrange(9)}" for _ in range(rng.randrange(1, 3))]) for i in range(6)]
        returns = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(2)]
        chain_rows += [(g, i, n) for i, n in enumerate(chain)]
        branch_rows += [(g, i, b[0], b[1], b[2], ["E"]) for i, b in enumerate(branches)]
        node_rows += [(g, n, t, n, ["E"]) for n, t in nodes.items()]
        edge_rows += [(g, f"r{i}", s, t, "returns_to", 0.5, ["E"]) for i, (s, t) in enumerate(returns)]
        want |= {(g, *item) for item in read_branches(chain, branches, nodes, returns)}
    frame = lambda rows, schema: cut_lineage(spark.createDataFrame(rows, schema))
    claims = V.Claims(
        graphs=None, coverage=None, inventory=None, cards=None,
        nodes=frame(node_rows, "graph_id long, id string, type string, name string, evidence_ids array<string>"),
        edges=frame(edge_rows, "graph_id long, id string, source string, target string, type string, confidence double, evidence_ids array<string>"),
        chain=frame(chain_rows, "graph_id long, pos int, node string"),
        branches=frame(branch_rows, "graph_id long, pos int, id string, origin string, path array<string>, evidence_ids array<string>"),
    )
    assert {tuple(r) for r in V.branch_rules(claims).collect()} == want


def test_branches_in_a_row_take_no_round_each(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(1, 2 * i, f"n{i}", [f"n{i + 1}"]) for i in range(40)] + [(2, 40 - i, f"n{i}", [f"n{i + 1}"]) for i in range(12)] + [(3, 0, None, None), (3, 1, "n9", [])]
    rows += [(4, i, f"n{rng.randrange(9)}", [f"n{rng.randrange(9)}", None]) for i in range(9)] + [(5, 0, "n0", ["n1"])]
    frame = lambda rows, schema: cut_lineage(spark.createDataFrame(rows, schema))
    claims = V.Claims(
        graphs=None, nodes=None, edges=None, coverage=None, inventory=None, cards=None, chain=frame([(g, 0, "n0") for g in range(5)], "graph_id long, pos int, node string"),
        branches=frame(rows, "graph_id long, pos int, origin string, path array<string>"),
    )
    written = []
    monkeypatch.setattr(V, "cut_lineage", lambda df, *name: written.append(name) or cut_lineage(df, *name))
    order = {tuple(r) for r in V.branch_order(claims).collect()}
    assert len(written) < 5
    assert {r for r in order if r[0] < 3} == {(1, 2 * i, 1) for i in range(40)} | {(2, 40 - i, i + 1) for i in range(12)}
    monkeypatch.setattr(V, "WHOLE_GRAPH", 8)  # graphs above it go through the rounds, with the same result
    few = replace(claims, branches=claims.branches.where("graph_id > 1"))
    assert {tuple(r) for r in V.branch_order(few).collect()} == {r for r in order if r[0] > 1}


def test_steps_of_unattached_branches_are_not_judged(spark):
    frame = lambda rows, schema: cut_lineage(spark.createDataFrame(rows, schema))
    claims = V.Claims(
        graphs=None, coverage=None, inventory=None, cards=None, nodes=None,
        edges=frame([("g", "a", "b", "produces")], "graph_id string, source string, target string, type string"),
        chain=frame([("g", 0, "a"), ("g", 1, "b")], "graph_id string, pos int, node string"),
        branches=frame([("g", 0, "on", "b", ["c"]), ("g", 1, "off", "x", ["y"])], "graph_id string, pos int, id string, origin string, path array<string>"),
    )
    assert [tuple(r) for r in V.path_rules(claims).collect()] == [("g", "branch_start", "on:b->c")]


def files_of(spark, parts, schema):
    """A folder with a table of several files, each a later arrival than the one before."""
    folder = fresh_folder(spark, "stream")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet/{k}")
    return folder


def test_streamed_rows_of_several_files_keep_apart(spark):
    folder = files_of(spark, [[(10 * k + i,) for i in range(10)] for k in range(4)], "event_id long")
    numbers = []
    out = fresh_folder(spark, "numbered")
    stream = J.table_stream(spark, folder, "events", files_per_batch=2)
    query = stream.writeStream.foreachBatch(
        lambda batch, n: numbers.extend(r["row_no"] for r in J.numbered_batch(batch, n).collect())
    ).option("checkpointLocation", out).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(numbers) == len(set(numbers)) == 40


def test_newest_event_wins_in_any_order(spark):
    schema = "task_id long, seq long, action string, title string, artifact string, " + ", ".join(
        f"{f} string" for f in H.FIELD_CHARS if f != "title"
    )
    more = ("",) * (len(H.FIELD_CHARS) - 1)
    parts = [[(1, 5, "complete", "late", "a", *more)], [(1, 2, "start", "early", "b", *more)], [(1, 3, "update", "", "a", *more)]]
    folder, out = files_of(spark, parts, schema), fresh_folder(spark, "folded")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    J.run_to_folder(fold_progress_stream(J.table_stream(spark, folder, "events", files_per_batch=1)), out, "update")
    rows = J.read_batches(spark, out).orderBy("revision").collect()
    assert [(r["revision"], r["status"], r["title"]) for r in rows] == [(n, "completed", "late") for n in (1, 2, 3)]


def test_progress_state(spark):
    rows = [(1, 1, "plan", "goal", "", ""), (1, 2, "update", "", "T", "done"), (1, 3, "complete", " ", "U", "")]
    df = spark.createDataFrame(rows, "task_id long, seq long, action string, objective string, title string, result string")
    row = H.fold_progress(df, {"objective": 1000, "title": 240, "result": 2000}).first()
    assert (row["revision"], row["status"], row["objective"], row["title"], row["result"]) == (3, "completed", "goal", "U", "done")
    assert H.unique_tail(["a", "b"], ["a", " c ", ""], keep=2) == ["b", "c"]
    assert df.agg(F.count("*")).first()[0] == 3


def shuffled_parts(rows, parts, turn):
    """Rows (the first field a time in seconds) as they come with delays of up to 300 s, in files; then one that closes the stream."""
    late = sorted(rows, key=lambda r: r[0] + turn.randrange(300))
    size = -(-len(late) // parts)
    return [late[k : k + size] for k in range(0, len(late), size)]


def test_streams_answer_in_event_order(spark):
    """Whatever the order of arrival within the lateness: the answers of a plain loop over the events in their order."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    turn = random.Random(4)
    start = 1_700_000_000
    calls = [
        (start + 20 * n, 1, f"c{turn.randrange(6)}", n, "tool", f"a{turn.randrange(8) // 6}", turn.choice(["failed", "failed", "running", "succeeded"]), f"r{n}", turn.random() < 0.7)
        for n in range(150)
    ]
    schema = "t long, scope long, call_id string, seq long, name string, arguments string, status string, result string, retry_safe boolean"
    parts = shuffled_parts(calls, 4, turn)
    assert [r[3] for p in parts for r in p] != sorted(r[3] for r in calls)
    folder = files_of(spark, [*parts, [(start + 10**6, -1, "end", 0, "", "", "", "", True)]], schema)
    out = fresh_folder(spark, "answers")
    stream = J.table_stream(spark, folder, "events", files_per_batch=1).withColumn("ts", F.timestamp_seconds("t"))
    J.run_to_folder(ledger_stream(stream, "2000 seconds"), out)
    want, first, stored = set(), {}, {}
    for t, scope, call, seq, name, given, status, result, safe in calls:
        if call not in first:
            first[call], answer, known = given, "execute", None
        elif given != first[call]:
            answer, known = "collision", None
        else:
            answer, known = ("replay", stored[call]) if call in stored else ("retry" if safe else "uncertain", None)
        if status == "succeeded" and given == first[call]:
            stored.setdefault(call, result)
        want.add((scope, call, seq, answer, known))
    got = J.read_batches(spark, out)
    assert {tuple(r) for r in got.drop("batch").collect()} == want and {a[3] for a in want} == {"execute", "collision", "replay", "retry", "uncertain"}
    assert got.select("batch").distinct().count() >= 3


def test_late_rows_are_kept_and_merged(spark):
    turn = random.Random(8)
    rows = [(1_700_000_000 + 60 * turn.randrange(600), n, turn.choice("ab"), "x") for n in range(400)]
    parts = [rows[k : k + 100] for k in range(0, 400, 100)]  # in no order of time at all
    folder = files_of(spark, parts, "t long, seq long, type string, status string")
    stream = J.table_stream(spark, folder, "events", files_per_batch=1).withColumn("ts", F.timestamp_seconds("t"))
    out = fresh_folder(spark, "late")
    J.counts_with_late(stream, out, "10 minutes", "1 hour")
    # a row is late once an earlier batch has passed the end of its window by an hour
    late, newest = set(), None
    for part in parts:
        late |= {r[1] for r in part if newest is not None and r[0] // 600 * 600 + 600 <= newest - 3600}
        newest = max([r[0] for r in part] + ([newest] if newest else []))
    assert late and {r["seq"] for r in J.late_rows(spark, out).collect()} == late
    batch = spark.createDataFrame(rows, "t long, seq long, type string, status string").withColumn("ts", F.timestamp_seconds("t"))
    want = batch.groupBy(F.window("ts", "10 minutes").start.alias("window_start"), "type", "status").agg(F.count("*").alias("events"))
    assert sorted(map(str, J.merged_counts(spark, out, "10 minutes").collect())) == sorted(map(str, want.collect()))


def test_versions_as_of_many_times(spark):
    """Whatever the width of a bucket: the newest version at or before each time, none before the first."""
    turn = random.Random(5)
    versions = [(r, at, n, f"s{r}-{n}") for r in (1, 2, None) for n, at in enumerate(sorted(turn.sample(range(10_000), 40)))] + [(3, 5, 1, "a"), (3, 5, 2, "b")]
    asked = [(k, turn.choice((1, 2, 3, 4, None)), turn.randrange(-100, 11_000)) for k in range(400)] + [(1000 + k, 3, at) for k, at in enumerate((4, 5, 6))]
    known = spark.createDataFrame(versions, "record_id long, at long, version long, snapshot string")
    requests = spark.createDataFrame(asked, "n long, record_id long, at long")
    want = {}
    for n, record, at in asked:
        before = [(t, v, s) for r, t, v, s in versions if r == record and t <= at]
        want[n] = max(before)[1:] if before else (None, None)
    for width in (100, 3000, 10**6):
        got = {r["n"]: (r["version"], r["snapshot"]) for r in N.versions_at(requests, known, width=width).collect()}
        assert got == want


def test_state_is_called_per_bucket_of_keys(spark):
    """The rows of many users wait as a few packed tables, and null keys, long keys and rows in no order are answered as in a loop."""
    from linkweave.streaming.ordered import BUCKETS, CodeRequestsInOrder, ordered_rate_limits

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    turn = random.Random(9)
    users = [None, 2**62 + 1, 2**62 + 2, *range(200)]
    rows = [(1_700_000_000 + turn.randrange(400), n, turn.choice(users)) for n in range(1200)]
    folder = files_of(spark, [*shuffled_parts(rows, 2, turn), [(1_700_000_000 + 10**6, 0, -1)]], "t long, seq long, user_id long")
    out = fresh_folder(spark, "requests")
    stream = J.table_stream(spark, folder, "events", files_per_batch=1).withColumn("ts", F.timestamp_seconds("t"))
    J.run_to_folder(ordered_rate_limits(stream, "2000 seconds"), out)
    want, times = set(), {}
    for t, n, user in sorted(rows):
        ok, wait, times[user] = H.next_answer(times.get(user, []), float(t))
        want.add((user, float(t), n, ok, wait))
    assert {tuple(r) for r in J.read_batches(spark, out).drop("batch").collect()} == want

    class Handle:
        calls, timers = [], []

        def getListState(self, name, schema):
            return self

        def getMapState(self, name, keys, values):
            return self

        def appendList(self, rows):
            self.calls.append(rows)

        def registerTimer(self, at):
            self.timers.append(at)

    processor = CodeRequestsInOrder()
    processor.init(Handle())
    batch = spark.range(5000).selectExpr("string(id) AS key", "timestamp_micros(id) AS ts", "5000000 + id AS at", "id AS seq", "'' AS body").toPandas()
    assert list(processor.handleInputRows((3,), iter([batch[:2000], batch[2000:]]), None)) == []
    assert len(Handle.calls) == 1 and len(Handle.calls[0]) == 2 and Handle.timers == [5000] and BUCKETS >= 256


def test_large_arrivals_come_in_several_files(spark, monkeypatch):
    from linkweave.plans import queries_events as W

    monkeypatch.setattr(W, "_ROWS", 20, raising=False)
    rows = spark.range(1000).selectExpr("id AS user_id", "id AS seq", "timestamp_seconds(1700000000 + id * 60) AS ts")
    stream, _ = W.arrivals(spark, rows, {"user_id": "-1L"})
    out = fresh_folder(spark, "several")
    J.run_to_folder(stream, out)
    got = J.read_batches(spark, out)
    assert sorted(r["user_id"] for r in got.collect()) == [-1, *range(1000)]
    assert got.where("user_id >= 0").groupBy("batch").agg(F.countDistinct("file_path").alias("n")).agg(F.max("n")).first()[0] > 1


def test_long_streams_close_within_the_range_of_times(spark):
    """Rows of two years: the row that closes their stream stays a time that Python can hold, and all of them are answered."""
    from linkweave.plans.queries_events import arrivals

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    calls = spark.range(40).selectExpr(
        "1L AS scope", "'c' || id % 3 AS call_id", "id AS seq", "'t' AS name", "'a' AS arguments", "if(id < 9, 'failed', 'succeeded') AS status",
        "'r' || id AS result", "true AS retry_safe", "timestamp_seconds(1700000000 + id * 86400 * 20) AS ts",
    )
    stream, late = arrivals(spark, calls, {"scope": "-1L"})
    out = fresh_folder(spark, "long")
    J.run_to_folder(ledger_stream(stream, late), out)
    got = {r["seq"]: (r["answer"], r["result"]) for r in J.read_batches(spark, out).collect()}
    want = {n: ("execute", None) if n < 3 else ("retry", None) if n < 12 else ("replay", f"r{9 + n % 3}") for n in range(40)}
    assert got == want
