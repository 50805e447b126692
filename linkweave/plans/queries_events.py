"""Registered queries: event logs, records, folds and streams, on events read as agent runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators import events as E
from linkweave.operators import folds as H
from linkweave.operators import records as N
from linkweave.operators import links as L
from linkweave.plans import queries_discovery as Q
from linkweave.plans.registry import query
from linkweave.plans.tables import read_table, read_tables
from linkweave.session import cut_lineage, fresh_folder
from linkweave.sources import catalog as S
from linkweave.streaming import jobs as J
from linkweave.streaming import ordered as Z
from linkweave.streaming import state as V

# One text for both engines: events as the log of agent runs. Every value is made from a row's own columns.
_RUN = (
    "select user_id as run_id, user_id % 5 as task_id, event_id as seq, ts, k,"
    " case event_type when 'view' then 'token' when 'click' then 'agent_progress' when 'purchase' then 'file_operation'"
    " when 'signup' then 'task_handoff' else 'tool_call' end as type,"
    " 'call-' || user_id || '-' || (k % 7) as call_id, case k % 4 when 0 then 'running' when 1 then 'succeeded' when 2 then 'failed' else 'streaming' end as status,"
    " case k % 5 when 0 then 'plan' when 1 then 'start' when 2 then 'update' when 3 then 'complete' else 'block' end as action,"
    " 'w' || (k % 2) as work_item_id, case when k % 6 = 0 then '' else 'step ' || (k % 3) end as message,"
    " 'goal ' || (k % 4) as objective, case when k % 3 = 0 then '' else 'title ' || k end as title,"
    " case when k % 4 = 0 then ' ' else 'sum ' || k end as summary, case when k % 2 = 0 then '' else 'res ' || k end as result,"
    " case when k % 5 = 0 then 'sum ' || k else 'chk ' || (k % 3) end as verification, case when k % 7 = 0 then '' else 'next ' || k end as next_step,"
    " '/workspace/' || (k % 6) || '.csv' as path, case when k % 9 = 0 then '' else 'edit' end as operation, cast(value as varchar(40)) as output,"
    " case when k % 3 = 0 then 'err ' || k end as error, 'a' || (k % 30) as artifact"
    " from (select *, cast({k} as bigint) as k from events)"
)
RUN_SPARK = _RUN.replace("{k}", "get_json_object(props, '$.k')").replace("varchar(40)", "string")
RUN = "ev as (" + _RUN.replace("{k}", "json_extract_string(props, '$.k')") + ")"
LEDGER = (
    "select user_id as run_id, call_id, max(seq) as last_seq, case max(seq) % 3 when 0 then 'succeeded' when 1 then 'failed' else 'running' end as status,"
    " 'done ' || max(seq) as summary, 'bad ' || min(seq) as error from (select run_id as user_id, call_id, seq from ev) group by 1, 2"
)


def runs(spark, folder) -> DataFrame:
    return spark.sql(RUN_SPARK.replace("from events)", "from {events})"), events=read_table(spark, folder, "events"))


def ledger(spark, folder) -> DataFrame:
    return spark.sql(LEDGER.replace("from ev)", "from {ev})"), ev=runs(spark, folder))


@query(f"with {RUN} select run_id, seq, type, status from ev where type not in ('token','reasoning','model_call','progress_message') and not (type='file_operation' and status='streaming')")
def persistent_events(spark, folder):
    return E.persistent_events(runs(spark, folder)).select("run_id", "seq", "type", "status")


_CLOSE = "e.status='running' and l.status in ('succeeded','failed')"


@query(
    f"with {RUN}, l as ({LEDGER}) select e.run_id, e.seq, case when {_CLOSE} then l.status else e.status end as status,"
    f" case when {_CLOSE} and l.status='succeeded' then l.summary else e.work_item_id end as output,"
    f" case when {_CLOSE} and l.status='succeeded' then null when {_CLOSE} then l.error else e.error end as error"
    " from ev e left join l on e.run_id=l.run_id and e.call_id=l.call_id"
)
def reconciled_events(spark, folder):
    events = runs(spark, folder).withColumn("output", F.col("work_item_id"))
    return E.reconcile(events, ledger(spark, folder)).select("run_id", "seq", "status", "output", "error")


def spoken(spark, folder) -> DataFrame:
    events = runs(spark, folder).withColumn("work_items", F.expr("array(title, '', objective)"))
    return E.progress_text(events)


_T = "coalesce(nullif(trim({0}),''), {1})"
_LEAD = "coalesce(nullif(trim(result),''), nullif(trim(summary),''), nullif(trim(title),''), '')"
_LIST = "list_filter([trim(title), '', trim(objective)], lambda t: t<>'')"
_TEXT = (
    "case when trim(message)<>'' then trim(message) when action='plan' then coalesce(nullif(trim(objective),''), nullif(trim(summary),''))"
    f" || chr(10) || array_to_string(list_transform({_LIST}, lambda t, i: i||'. '||t), chr(10))"
    " || case when trim(next_step)<>'' then chr(10)||'接下来：'||trim(next_step) else '' end"
    f" else concat_ws(chr(10)||chr(10), nullif({_LEAD},''), case when trim(verification)<>'' and not contains({_LEAD}, trim(verification)) then '验收：'||trim(verification) end,"
    " case when trim(next_step)<>'' then '下一步：'||trim(next_step) end) end"
)


@query(f"with {RUN} select run_id, seq, {_TEXT} as text from ev where type='agent_progress'")
def progress_texts(spark, folder):
    return spoken(spark, folder).where("type = 'agent_progress'").select("run_id", "seq", "text")


SHOWN = (
    f"sh as (select *, {_TEXT} as text from ev where type='agent_progress' and action in ('plan','start','update','block','compact')),"
    " lg as (select *, lag(action) over w as pa, lag(work_item_id) over w as pw, lag(text) over w as pt, row_number() over w as rn from sh where text<>'' window w as (partition by run_id order by seq)),"
    " nw as (select run_id, seq, action, text from lg where rn=1 or not (pa is not distinct from action and pw is not distinct from work_item_id and pt is not distinct from text))"
)


@query(f"with {RUN}, {SHOWN} select run_id, seq, action, text from nw")
def new_progress(spark, folder):
    """Progress that differs from the one shown before it; runs are cut into buckets of 500 events."""
    return E.new_progress(spoken(spark, folder), width=500).select("run_id", "seq", "action", "text")


@query(f"with {RUN}, {SHOWN} select e.run_id, e.seq, 1 + count(nw.seq)::bigint as message_no from ev e left join nw on nw.run_id=e.run_id and nw.seq<e.seq group by 1,2")
def activity_slices(spark, folder):
    """The message each event belongs to."""
    events = runs(spark, folder)
    shown = E.new_progress(spoken(spark, folder), width=500).select("run_id", "seq")
    return E.activity_slices(events, shown, width=500)


@query(f"with {RUN} select run_id, type, max(seq) as seq, max_by(status, seq) as status, max_by(summary, seq) as summary from ev group by 1,2")
def latest_events(spark, folder):
    return E.latest_per_key(runs(spark, folder), ["run_id", "type"], ["seq", "status", "summary"])


_CALLS = (
    "cl as (select run_id, call_id, min(seq) as first_seq, max(seq) as last_seq, count(*) as events, max_by(type, seq) as type, max_by(status, seq) as status,"
    " max_by(error, seq) filter (error is not null) as error, max_by(action, seq) as action from ev group by 1,2)"
)


@query(f"with {RUN}, {_CALLS} select * from cl")
def merged_calls(spark, folder):
    return E.merge_calls(runs(spark, folder), ["run_id", "call_id"], ["type", "status", "error", "action"])


@query(
    f"with {RUN}, {_CALLS}, w as (select *, case status when 'running' then 2 when 'failed' then 1 else 0 end as weight from cl where type<>'file_operation')"
    " select run_id, action, count(*) as calls, case max(weight) when 2 then 'running' when 1 then 'failed' else 'succeeded' end as status,"
    " max_by(call_id, weight*1000000000 + first_seq) as shown_call from w group by 1,2"
)
def technical_groups(spark, folder):
    calls = E.merge_calls(runs(spark, folder), ["run_id", "call_id"], ["type", "status", "error", "action"])
    return E.technical_groups(calls, ["run_id", "action"])


@query(
    f"with {RUN}, f as (select *, row_number() over (partition by run_id, path order by seq desc) as c from ev where type='file_operation' and trim(path)<>''),"
    " r as (select *, row_number() over (partition by run_id order by seq desc) as rank from f where c=1)"
    " select run_id, rank, path, coalesce(nullif(operation,''),'manage') as operation, coalesce(nullif(status,''),'completed') as status from r where rank<=5"
)
def file_activities(spark, folder):
    return E.file_activities(runs(spark, folder))


@query(
    f"with {RUN}, l as ({LEDGER}), t as (select run_id, max_by(coalesce(nullif(summary,''), nullif(result,''), nullif(title,''), nullif(next_step,'')), seq) filter (type='agent_progress') as text from ev group by 1),"
    " c as (select run_id, count(*) filter (status='succeeded') as s, count(*) filter (status='failed') as f from l group by 1)"
    " select t.run_id, s as succeeded, f as failed, coalesce(nullif(trim(text),''), 'Agent 完成回复；能力调用成功 '||s||' 个，失败 '||f||' 个。') as summary from t left join c using (run_id)"
)
def run_summaries(spark, folder):
    return E.run_summary(runs(spark, folder), ledger(spark, folder))


@query(
    f"with {RUN}, l as (select run_id % 5 as task_id, run_id * 1000000 + last_seq as seq, status, case when status='succeeded' then summary else '' end as summary, error from ({LEDGER})),"
    " p as (select *, row_number() over (partition by task_id order by seq desc) as b from ev where type in ('agent_progress','plan','task_handoff')),"
    " q as (select task_id, 'progress' as part, seq, case when type='task_handoff' then left(trim(summary),360) else left(trim(coalesce(nullif(summary,''),nullif(result,''),nullif(title,''),nullif(next_step,''),'')),500) end as body,"
    " case when type='task_handoff' then 'handoff' else action end as tag from p where b<=8),"
    " c as (select *, coalesce(nullif(summary,''),nullif(error,'')) as body, row_number() over (partition by task_id order by seq desc) as b from l)"
    " select task_id, part, seq, '  - ['||tag||'] '||body as line from q where body<>'' union all select task_id, 'result', seq, '  - ['||status||'] '||body from c where b<=8"
)
def manifest_tails(spark, folder):
    calls = ledger(spark, folder).selectExpr(
        "run_id % 5 AS task_id", "run_id * 1000000 + last_seq AS seq", "status", "if(status = 'succeeded', summary, '') AS summary", "error"
    )
    return E.manifest_tails(runs(spark, folder), calls)


@query(
    f"with {RUN}, f as (select task_id, trim(artifact) as item, min(seq) as first_seq from ev where trim(artifact)<>'' group by 1,2),"
    " b as (select *, row_number() over (partition by task_id order by first_seq desc, item desc) as back from f) select task_id, item, first_seq from b where back<=12"
)
def last_artifacts(spark, folder):
    return E.last_distinct(runs(spark, folder), "task_id", "artifact", 12)


@query(
    "with f as (select doc_id, unnest(string_split(text, ' ')) as frag, generate_subscripts(string_split(text, ' '), 1) as seq from documents),"
    " g as (select doc_id, count(*) as fragments, string_agg(case when seq=1 then 'write_file' else '' end, '' order by seq) as name,"
    " string_agg(case when seq=1 then '{\"n\":' when seq=2 then length(frag)::varchar when seq=3 and length(frag)>2 then '}' else '' end, '' order by seq) as raw from f group by 1)"
    " select doc_id, fragments, name, json_valid(raw) as parsed, case when json_valid(raw) then raw else '{\"_raw\":\"'||replace(raw,'\"','\\\"')||'\"}' end as arguments from g"
)
def assembled_calls(spark, folder):
    """Tool-call arguments put together from fragments; the words of each document steer what arrives."""
    words = read_table(spark, folder, "documents").selectExpr("doc_id", "posexplode(split(text, ' ')) AS (p, frag)")
    fragments = words.selectExpr(
        "doc_id", "p + 1 AS seq", "if(p = 0, 'write_file', '') AS name",
        "CASE WHEN p = 0 THEN '{\"n\":' WHEN p = 1 THEN string(char_length(frag)) WHEN p = 2 AND char_length(frag) > 2 THEN '}' ELSE '' END AS arguments",
    )
    return E.assemble_fragments(fragments, ["doc_id"])


@query(
    "with m as (select conv_id as session_id, turn as seq, role, text as content, row_number() over (partition by conv_id order by turn desc) as back from conversations where text<>''),"
    " s as (select *, coalesce(sum(least(length(content),300)) over (partition by session_id order by back rows between unbounded preceding and 1 preceding),0) as spent from m),"
    " r as (select *, least(300, 1000-spent)::int as room from s where spent<1000), f as (select *, greatest(room-55,0) as free, (greatest(room-55,0)//3)::int as head from r)"
    " select session_id, seq, role, case when length(content)<=room then content else left(content,head)||chr(10)||chr(10)||'[Earlier message content omitted by context budget]'||chr(10)||chr(10)||right(content,free-head) end as content from f"
)
def bounded_history(spark, folder):
    messages = read_table(spark, folder, "conversations").selectExpr("conv_id AS session_id", "turn AS seq", "role", "text AS content")
    return E.bounded_history(messages, budget=1000, per_message=300)


@query("select conv_id as session_id, count(*) as messages, coalesce(sum(length(text)) filter (role='user'),0)::bigint as role_chars, coalesce(sum(length(text)) filter (role='user'),0) > 1000 as exceeded from conversations group by 1")
def request_sizes(spark, folder):
    messages = read_table(spark, folder, "conversations").selectExpr("conv_id AS session_id", "role", "text AS content")
    return E.request_sizes(messages, role="user")


_LISTS = (
    "b as (select p_name || '/' || p_partkey as path, p_size as size, p_retailprice as modified from part where p_size < 30),"
    " a as (select p_name || '/' || p_partkey as path, least(p_size, 25) as size, p_retailprice as modified from part where p_size > 10)"
)


@query(
    f"with {_LISTS}, j as (select coalesce(a.path,b.path) as path, case when b.path is null then 'create' when a.path is null then 'delete' when a.size<>b.size or a.modified<>b.modified then 'edit' end as operation from b full join a on a.path=b.path)"
    " select row_number() over (order by instr('create edit delete', operation), path) as n, operation, path from j where operation is not null order by n limit 50"
)
def listing_changes(spark, folder):
    part = read_table(spark, folder, "part")
    before = part.where("p_size < 30").selectExpr("concat(p_name, '/', p_partkey) AS path", "p_size AS size", "p_retailprice AS modified")
    after = part.where("p_size > 10").selectExpr("concat(p_name, '/', p_partkey) AS path", "least(p_size, 25) AS size", "p_retailprice AS modified")
    return E.listing_changes(before, after)


_ATT = (
    "select run_id as scope, call_id, seq, type as name, work_item_id as arguments, status, summary as result, k % 5 <> 0 as retry_safe from ev"
)


@query(
    f"with {RUN}, a as ({_ATT}), i as (select *, sha256(concat_ws(chr(0), name, arguments)) as input from a)"
    " select scope, call_id, count(*) as attempts, case when count(*) filter (status='succeeded')>0 then 'succeeded' when max_by(status,seq) in ('running','failed') and bool_and(retry_safe) then 'retryable' else 'uncertain' end as state,"
    " count(distinct input)>1 as collision, min_by(result, seq) filter (status='succeeded') as result from i group by 1,2"
)
def call_ledger(spark, folder):
    return E.ledger_state(spark.sql(_ATT.replace("from ev", "from {ev}"), ev=runs(spark, folder)))


@query(
    f"with {RUN}, a as ({_ATT}), i as (select *, sha256(concat_ws(chr(0), name, arguments)) as input from a),"
    " f as (select *, first_value(input) over (partition by scope, call_id order by seq) as fi, row_number() over (partition by scope, call_id order by seq) as rn from i),"
    " d as (select *, coalesce(bool_or(status='succeeded' and input=fi) over (partition by scope, call_id order by seq rows between unbounded preceding and 1 preceding), false) as done from f)"
    " select scope, call_id, seq, case when rn=1 then 'execute' when input<>fi then 'collision' when done then 'replay' when retry_safe then 'retry' else 'uncertain' end as answer from d"
)
def call_answers(spark, folder):
    return E.ledger_answers(spark.sql(_ATT.replace("from ev", "from {ev}"), ev=runs(spark, folder)))


_SESS = "select 't' || c_custkey as token, c_custkey as account_id, c_acctbal * 1000 as expires_at from customer"
_REQ = "select event_id, 't' || user_id as token, value * 10000 as {q}at{q} from events"


@query(f"with s as ({_SESS}), r as ({_REQ.format(q=chr(34))}) select r.event_id, s.account_id from r join s using (token) where expires_at > r.\"at\"")
def live_sessions(spark, folder):
    t = read_tables(spark, folder, ("customer", "events"))
    sessions = spark.sql(_SESS.replace("from customer", "from {c}"), c=t["customer"])
    requests = spark.sql(_REQ.format(q="`").replace("from events", "from {e}"), e=t["events"])
    return E.live_sessions(requests, sessions).select("event_id", "account_id")


@query("select c_custkey, c_acctbal from customer where c_acctbal <= 500 or c_nationkey >= 20")
def expired_sessions(spark, folder):
    rows = read_table(spark, folder, "customer").selectExpr("c_custkey", "c_acctbal", "c_acctbal AS expires_at", "c_nationkey AS attempts")
    return E.expired(rows, "500", 20).select("c_custkey", "c_acctbal")


def code_requests(spark, folder) -> DataFrame:
    return read_table(spark, folder, "events").selectExpr("user_id", "unix_micros(cast(ts AS timestamp)) / 1e6D AS at")


RATES = (
    "with recursive q as (select user_id, epoch_us(ts)/1e6 as t, count(*) as requests from events group by 1,2),"
    " r as (select *, row_number() over (partition by user_id order by t) as rn from q),"
    " f as (select user_id, t, rn, requests, [t] as acc, true as accepted, 0::bigint as retry_after from r where rn=1 union all"
    " select user_id, t, rn, requests, case when wait<=0 and len(recent)<5 then list_append(recent, t)[-5:] else acc end, wait<=0 and len(recent)<5,"
    " case when wait>0 then wait when len(recent)>=5 then greatest(1, ceil(3600-(t-recent[1])))::bigint else 0 end"
    " from (select r.user_id, r.t, r.rn, r.requests, f.acc, ceil(60-(r.t-f.acc[-1]))::bigint as wait, list_filter(f.acc, lambda a: a>=r.t-3600) as recent from r join f on r.user_id=f.user_id and r.rn=f.rn+1))"
)


@query(RATES + ' select user_id, t as "at", requests, accepted, retry_after from f')
def rate_limits(spark, folder):
    """Answers to code requests: at least a minute apart and five an hour."""
    return H.rate_limit(code_requests(spark, folder))


_FOLD = ", ".join(
    f"coalesce(max_by(left(trim({f}),{n}), seq) filter (trim(coalesce({f},''))<>''),'') as {f}" for f, n in H.FIELD_CHARS.items() if f != "why"
)


@query(
    f"with {RUN} select task_id, count(*) as revision, case max_by(action,seq) when 'complete' then 'completed' when 'block' then 'blocked' when 'plan' then 'planned' else 'running' end as status, {_FOLD} from ev where type='agent_progress' group by 1"
)
def task_states(spark, folder):
    events = runs(spark, folder).where("type = 'agent_progress'")
    return H.fold_progress(events, {f: n for f, n in H.FIELD_CHARS.items() if f != "why"})


@query(
    f"with {RUN}, s as (select task_id, work_item_id, seq, case action when 'start' then 'running' when 'update' then case when trim(result)<>'' and trim(verification)<>'' then 'completed' else 'running' end when 'complete' then 'completed' when 'block' then 'blocked' end as status from ev)"
    " select task_id, work_item_id, count(*) as events, max_by(status, seq) as status from s where status is not null group by 1,2"
)
def work_item_states(spark, folder):
    return H.work_item_status(runs(spark, folder))


# Records --------------------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_custkey = 7 order by o_totalprice desc")
def owned_records(spark, folder):
    rows = read_table(spark, folder, "orders").selectExpr("o_orderkey", "o_totalprice", "string(o_custkey) AS owner_id")
    return N.newest_first(N.owned_by(rows, "7"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query(
    "with f as (select o_custkey as id, count(*) as n from orders group by 1), q as (select user_id as id, count(*) as n from events where event_type<>'click' group by 1), p as (select c_custkey as id, count(*) as n from customer where c_acctbal>0 group by 1)"
    " select c_custkey as record_id, coalesce(f.n,0) as file_count, coalesce(q.n,0) as open_question_count, coalesce(p.n,0) as package_count from customer left join f on f.id=c_custkey left join q on q.id=c_custkey left join p on p.id=c_custkey"
)
def record_summaries(spark, folder):
    t = read_tables(spark, folder, ("customer", "orders", "events"))
    return N.record_summaries(
        t["customer"].selectExpr("c_custkey AS record_id"), t["orders"].selectExpr("o_custkey AS record_id"),
        t["events"].selectExpr("user_id AS record_id", "if(event_type = 'click', 'answered', 'open') AS status"),
        t["customer"].where("c_acctbal > 0").selectExpr("c_custkey AS record_id"),
    )


_VERS = "v as (select o_custkey as record_id, o_orderkey as seq, o_orderstatus as snapshot, row_number() over (partition by o_custkey order by o_orderkey) as version from orders)"


@query(f"with {_VERS} select record_id, seq, version from v")
def numbered_versions(spark, folder):
    rows = read_table(spark, folder, "orders").selectExpr("o_custkey AS record_id", "o_orderkey AS seq", "o_orderstatus AS snapshot")
    return N.number_versions(rows, width=1000).select("record_id", "seq", "version")


@query(
    f"with {_VERS}, m as (select record_id, max(version) as latest from v group by 1)"
    " select record_id, snapshot, version::bigint as version, 'saved' as summary from v union all select record_id, snapshot, latest+1, 'Rolled back to v2' from v join m using (record_id) where version=2"
)
def rolled_back_versions(spark, folder):
    rows = read_table(spark, folder, "orders").selectExpr("o_custkey AS record_id", "o_orderkey AS seq", "o_orderstatus AS snapshot", "'saved' AS summary")
    return N.rollback(N.number_versions(rows, width=1000), 2)


@query(
    f"with {_VERS} select l.l_orderkey, l.l_linenumber, l.l_suppkey as record_id, v.version, v.snapshot"
    " from lineitem l asof left join v on l.l_suppkey = v.record_id and l.l_orderkey >= v.seq"
)
def versions_as_of(spark, folder):
    """The version of a record that was the newest at the time of each of many requests."""
    t = read_tables(spark, folder, ("orders", "lineitem"))
    saved = t["orders"].selectExpr("o_custkey AS record_id", "o_orderkey AS seq", "o_orderkey AS at", "o_orderstatus AS snapshot")
    asked = t["lineitem"].selectExpr("l_orderkey", "l_linenumber", "l_suppkey AS record_id", "l_orderkey AS at")
    return N.versions_at(asked, N.number_versions(saved, width=1000), width=1000).drop("at")


_ITEMS = (
    "x as (select l_suppkey as owner, 'i' || (l_partkey % 40) as id, 0 as side, l_orderkey * 10 + l_linenumber as seq, l_returnflag as title, l_linestatus as status, '' as result from lineitem where l_quantity < 25"
    " union all select l_suppkey, 'i' || (l_partkey % 40), 1, l_orderkey * 10 + l_linenumber, case when l_tax > 0.05 then '' else l_returnflag end, '', l_linestatus from lineitem where l_quantity >= 25)"
)


@query(
    f"with {_ITEMS},"
    " g as (select owner, id, min(side*1000000000000+seq) as place, coalesce(max_by(title, side*1000000000000+seq) filter (title<>''),'') as title, coalesce(max_by(status, side*1000000000000+seq) filter (status<>''),'') as status,"
    " coalesce(max_by(result, side*1000000000000+seq) filter (result<>''),'') as result from x group by 1,2),"
    " r as (select *, row_number() over (partition by owner order by place, id) as n from g where title<>'') select owner, id, n, length(title) as titled from r where n<=12"
)
def merged_work_items(spark, folder):
    """Work items of each supplier after all patches: fields that are not blank override."""
    line = read_table(spark, folder, "lineitem").selectExpr(
        "l_suppkey AS owner", "concat('i', l_partkey % 40) AS id", "l_orderkey * 10 + l_linenumber AS seq", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"
    )
    existing = line.where("l_quantity < 25").selectExpr("owner", "id", "seq", "l_returnflag AS title", "l_linestatus AS status", "'' AS result")
    incoming = line.where("l_quantity >= 25").selectExpr("owner", "id", "seq", "if(l_tax > 0.05, '', l_returnflag) AS title", "'' AS status", "l_linestatus AS result")
    merged = N.merge_items(existing, incoming, ["owner", "id"], ["title", "status", "result"])
    return merged.selectExpr("owner", "id", "n", "bigint(char_length(title)) AS titled")


@query("select p_brand as name, min(p_partkey) as place, max_by(p_name, p_partkey) as p_name, max_by(p_size, p_partkey) as p_size from part group by 1")
def last_entries(spark, folder):
    rows = read_table(spark, folder, "part").selectExpr("p_brand AS name", "p_partkey AS seq", "p_name", "p_size")
    return N.last_by_name(rows, ["p_name", "p_size"])


@query("select trim(p_brand) as name, min(p_partkey) as place, min_by(p_name, p_partkey) as p_name from part where trim(p_brand)<>'' group by 1")
def first_entries(spark, folder):
    rows = read_table(spark, folder, "part").selectExpr("p_brand AS name", "p_partkey AS seq", "p_name")
    return N.first_by_name(rows, ["p_name"])


@query(
    "with a as (select conv_id, turn, case turn % 4 when 0 then 'Approve: ' when 1 then 'do not run ' when 2 then '允许执行 ' else '' end || text as answer from conversations)"
    " select conv_id, turn, case when regexp_matches(lower(answer), '拒绝|不允许|reject|deny|do not run|don''t run') then 'reject' when regexp_matches(lower(answer), '允许本次执行|允许执行|approve|run once') then 'approve' else 'reject' end as decision from a"
)
def decisions(spark, folder):
    rows = read_table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn", "concat(CASE turn % 4 WHEN 0 THEN 'Approve: ' WHEN 1 THEN 'do not run ' WHEN 2 THEN '允许执行 ' ELSE '' END, text) AS answer"
    )
    return rows.selectExpr("conv_id", "turn", f"{N.decision('answer')} AS decision")


_QUES = (
    "select user_id as session_id, event_id as question_id, case when event_type='click' then 'answered' else 'open' end as status,"
    " case when event_type='click' then ' ' || props || ' ' else '' end as answer, case when event_type='error' then 'r1' else '' end as continuation_run_id, value as answered_at from events"
)


@query(
    f"with q as ({_QUES}), b as (select *, row_number() over (partition by session_id order by answered_at desc, question_id desc) as back from q where status='answered' and trim(answer)<>'' and continuation_run_id='')"
    " select session_id, row_number() over (partition by session_id order by answered_at, question_id) as n, question_id, trim(answer) as answer, answered_at from b where back<=12"
)
def answers_to_resume(spark, folder):
    rows = spark.sql(_QUES.replace("from events", "from {e}"), e=read_table(spark, folder, "events"))
    return N.answers_to_resume(rows)


@query(f"with q as ({_QUES}) select session_id, count(*) as open from q where status<>'answered' group by 1")
def open_questions(spark, folder):
    rows = spark.sql(_QUES.replace("from events", "from {e}"), e=read_table(spark, folder, "events"))
    return N.open_questions(rows).groupBy("session_id").agg(F.count(F.lit(1)).alias("open"))


@query("select o_custkey as session_id, max(o_orderkey) as run_id from orders where o_orderstatus='O' group by 1")
def waiting_runs(spark, folder):
    rows = read_table(spark, folder, "orders").selectExpr(
        "o_custkey AS session_id", "o_orderkey AS run_id", "o_orderkey AS seq", "if(o_orderstatus = 'O', 'waiting_for_user', 'done') AS status"
    )
    return N.waiting_run(rows)


@query(
    "with k as (select distinct o_custkey as record_id, o_orderpriority as text from orders), t as (select c_custkey as record_id, 'business_goal' as source, '5-LOW' as text from customer union all select c_custkey, 'business_description', c_mktsegment from customer)"
    " select t.record_id, t.text, max(source) as source from t left join k on k.record_id=t.record_id and k.text=t.text where k.text is null group by 1,2"
)
def missing_requirements(spark, folder):
    t = read_tables(spark, folder, ("customer", "orders"))
    records = t["customer"].selectExpr("c_custkey AS record_id", "' 5-LOW ' AS goal", "c_mktsegment AS description")
    return N.missing_requirements(records, t["orders"].selectExpr("o_custkey AS record_id", "o_orderpriority AS text"))


@query("select event_id, source_file_id from (select event_id, case when user_id<5 then '' else user_id::varchar end as source_file_id from events) where source_file_id='' or source_file_id in (select o_custkey::varchar from orders where o_orderstatus='F')")
def live_usages(spark, folder):
    t = read_tables(spark, folder, ("events", "orders"))
    usages = t["events"].selectExpr("event_id", "if(user_id < 5, '', string(user_id)) AS source_file_id")
    return N.usages_of_present_files(usages, t["orders"].where("o_orderstatus = 'F'").selectExpr("string(o_custkey) AS file_id")).select("event_id", "source_file_id")


# Streams --------------------------------------------------------------------------------------------


def run_stream(spark, folder) -> DataFrame:
    events = J.table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(RUN_SPARK.replace("from events)", "from {events})"), events=events)


@query(f"with {RUN} select run_id, seq, type from ev where type not in ('token','reasoning','model_call','progress_message') and not (type='file_operation' and status='streaming')")
def streamed_events(spark, folder):
    """The persistence filter on a stream, written batch by batch."""
    out = fresh_folder(spark, "kept-events")
    J.run_to_folder(E.persistent_events(run_stream(spark, folder)).select("run_id", "seq", "type"), out)
    return J.read_batches(spark, out).select("run_id", "seq", "type")


@query(
    f"with {RUN}, l as ({LEDGER}) select e.run_id, e.seq, case when {_CLOSE} then l.status else e.status end as status from ev e left join l on e.run_id=l.run_id and e.call_id=l.call_id"
)
def streamed_reconciliation(spark, folder):
    """Running events of a stream closed from a static ledger."""
    out = fresh_folder(spark, "reconciled")
    closed = E.reconcile(run_stream(spark, folder), cut_lineage(ledger(spark, folder)))
    J.run_to_folder(closed.select("run_id", "seq", "status"), out)
    return J.read_batches(spark, out).select("run_id", "seq", "status")


@query(f"with {RUN} select time_bucket(interval '1 hour', ts) as window_start, type, status, count(*) as events from ev group by 1,2,3")
def streamed_counts(spark, folder):
    """Events per hour, type and status, kept up to date by a stream."""
    out = fresh_folder(spark, "hourly")
    J.run_to_folder(J.windowed_counts(run_stream(spark, folder)), out, mode="update")
    keys = ["window_start", "type", "status"]
    return J.newest_batch(spark, out, keys, ["events"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "with s as (select user_id as run_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as opens from events),"
    " n as (select *, sum(opens) over (partition by run_id order by ts rows unbounded preceding) as n from s)"
    " select run_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as events from n group by run_id, n"
)
def session_counts(spark, folder):
    """Sessions of users: the batch form of the session window."""
    return J.session_counts(read_table(spark, folder, "events").selectExpr("user_id AS run_id", "ts"))


# Rows as they arrive: each up to a quarter of the whole span after its time, in five files, so a batch each; a last row far
# ahead closes the stream.
_DELAY, _FILES = 0.25, 5
_ROWS = 200_000
"""Rows of a file, at about: the fifth of a large table that comes in one batch is several files."""


def arrivals(spark, rows: DataFrame, closing: dict[str, str]) -> tuple[DataFrame, str]:
    """(stream, lateness that lets all of it through) of rows with ts and seq; `closing` has the columns of the last row (SQL).

    The lateness spans a batch more than the delays, so where files of two folders meet in a batch no row is late either.

    The last row stands a day more than the lateness after all others, so the watermark passes them, and no further: Python holds times
    of the years 1678 to 2261 only.
    """
    out, rows = fresh_folder(spark, "arrivals"), cut_lineage(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    low, high, size = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count(F.lit(1))).first()
    parts = min(spark.sparkContext.defaultParallelism, 1 + size // (_FILES * _ROWS))
    delay = max(1, int((high - low) * _DELAY))
    width = max(1, (high - low + delay) // _FILES + 1)
    placed = rows.withColumn("file", F.expr(f"(unix_micros(ts) - {low} + pmod(xxhash64(seq), {delay})) div {width}"))
    for n in range(_FILES):
        own = placed.where(f"file = {n}").drop("file")
        (own.repartition(parts) if parts > 1 else own.coalesce(1)).write.parquet(f"{out}/events.parquet/{n}")
    last = rows.limit(1).withColumns({"ts": F.timestamp_micros(F.lit(high + 2 * (delay + width) + 86_400_000_000)), **{c: F.expr(x) for c, x in closing.items()}})
    last.coalesce(1).write.parquet(f"{out}/events.parquet/{_FILES}")
    return J.table_stream(spark, out, "events", files_per_batch=parts), f"{(delay + width) // 1_000_000 + 1} seconds"


@query(
    f"with {RUN}, a as ({_ATT}), i as (select *, sha256(concat_ws(chr(0), name, arguments)) as input from a),"
    " f as (select *, first_value(input) over (partition by scope, call_id order by seq) as fi, row_number() over (partition by scope, call_id order by seq) as rn from i),"
    " d as (select *, min(seq) filter (status='succeeded' and input=fi) over (partition by scope, call_id) as done from f),"
    " k as (select scope, call_id, result as kept from d where seq=done)"
    " select scope, call_id, seq, case when rn=1 then 'execute' when input<>fi then 'collision' when done<seq then 'replay' when retry_safe then 'retry' else 'uncertain' end as answer,"
    " case when rn>1 and input=fi and done<seq then kept end as result from d left join k using (scope, call_id)"
)
def streamed_ledger(spark, folder):
    """Answers of a ledger on a stream whose attempts come out of order: the stored result is replayed, other inputs collide."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    calls = spark.sql(_ATT.replace("from ev", "from {ev}"), ev=runs(spark, folder)).withColumn("ts", F.expr("timestamp_seconds(1700000000 + seq * 60)"))
    stream, late = arrivals(spark, calls, {"scope": "-1L"})
    out = fresh_folder(spark, "calls")
    J.run_to_folder(Z.ledger_stream(stream, late), out)
    return J.read_batches(spark, out).select("scope", "call_id", "seq", "answer", "result")


@query(RATES + ' select user_id, t as "at", accepted, retry_after from f')
def ordered_rate_limits(spark, folder):
    """The rate limit on a stream of requests that come out of order: the same answers as in batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    requests = read_table(spark, folder, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("seq"))
    stream, late = arrivals(spark, requests, {"user_id": "-1L"})
    out = fresh_folder(spark, "limits")
    J.run_to_folder(Z.ordered_rate_limits(stream, late), out)
    return J.read_batches(spark, out).select("user_id", "at", "accepted", "retry_after")


@query(
    f"with {RUN} select task_id, count(*) as revision, case max_by(action,seq) when 'complete' then 'completed' when 'block' then 'blocked' when 'plan' then 'planned' else 'running' end as status, {_FOLD} from ev where type='agent_progress' group by 1"
)
def ordered_task_states(spark, folder):
    """Progress states folded by a stream in the order of the events and not of their arrival."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    events = runs(spark, folder).where("type = 'agent_progress'").withColumn("why", F.lit("")).withColumn("ts", F.expr("timestamp_seconds(1700000000 + seq * 60)"))
    stream, late = arrivals(spark, events.select("task_id", "ts", "seq", "action", "artifact", *H.FIELD_CHARS), {"task_id": "-1L"})
    out = fresh_folder(spark, "tasks")
    J.run_to_folder(Z.ordered_progress(stream, late), out)
    fields = [f for f in H.FIELD_CHARS if f != "why"]
    last = J.read_batches(spark, out).groupBy("task_id").agg(F.expr(f"max_by(struct(revision, status, {', '.join(fields)}), revision) AS v"))
    return last.select("task_id", "v.*")


@query(f"with {RUN} select time_bucket(interval '1 hour', ts) as window_start, type, status, count(*) as events, true as some_late from ev group by 1,2,3")
def counts_with_late_rows(spark, folder):
    """Events per hour from rows on time and those that came after their hour had closed, kept aside and added later."""
    rows = runs(spark, folder).select("ts", "seq", "type", "status")
    stream, _ = arrivals(spark, rows, {"type": "'close'"})
    out = fresh_folder(spark, "late-counts")
    J.counts_with_late(stream, out, late="1 day")
    some = J.late_rows(spark, out).limit(1).count() == 1
    return J.merged_counts(spark, out).where("type <> 'close'").withColumns({
        "window_start": F.col("window_start").cast("timestamp_ntz"), "some_late": F.lit(some)
    })


@query(
    "with s as (select user_id as run_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as opens from events),"
    " n as (select *, sum(opens) over (partition by run_id order by ts rows unbounded preceding) as n from s)"
    " select run_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as events from n group by run_id, n"
)
def streamed_sessions(spark, folder):
    """Sessions of users from a stream whose events come out of order; a session is written once it can't grow."""
    rows = read_table(spark, folder, "events").selectExpr("user_id AS run_id", "ts", "event_id AS seq")
    stream, late = arrivals(spark, rows, {"run_id": "-1L"})
    out = fresh_folder(spark, "sessions")
    J.run_to_folder(J.session_counts(stream, late=late), out)
    found = J.read_batches(spark, out).select("run_id", "session_start", "session_end", "events")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query(
    f"with {Q.PROBE} select s_table, s_column, t_table, t_column, fingerprint, row_no, confidence, verdict from matches where t_table='events'"
)
def streamed_probe(spark, folder):
    """A growing table probed against fixed seeds, batch by batch, under one cap for all batches."""
    catalog, candidates = Q.star_seeds(spark, folder)
    seeds = cut_lineage(L.seed_index(cut_lineage(candidates)))
    tables = read_tables(spark, folder, Q.SEED_TABLES + Q.PROBED)
    catalog = S.schema_catalog(spark, tables, Q.RULES.headers)
    columns = S.join_columns(catalog)["events"]
    out = fresh_folder(spark, "probe")
    found = J.probe_stream(J.table_stream(spark, folder, "events"), "events", columns, catalog, seeds, out, Q.RULES.values)
    return found.select("s_table", "s_column", "t_table", "t_column", "fingerprint", "row_no", "confidence", "verdict")


@query(RATES + ' select user_id, t as "at", accepted, retry_after from f')
def streamed_rate_limits(spark, folder):
    """The rate limit on a stream, with the accepted times in the state store."""
    out = fresh_folder(spark, "limits")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    stream = J.table_stream(spark, folder, "events").selectExpr("user_id", "unix_micros(cast(ts AS timestamp)) / 1e6D AS at")
    J.run_to_folder(V.rate_limit_stream(stream), out)
    return J.read_batches(spark, out).select("user_id", "at", "accepted", "retry_after")


@query(
    f"with {RUN} select task_id, count(*) as revision, case max_by(action,seq) when 'complete' then 'completed' when 'block' then 'blocked' when 'plan' then 'planned' else 'running' end as status, {_FOLD} from ev where type='agent_progress' group by 1"
)
def streamed_task_states(spark, folder):
    """Progress states folded by a stream; the newest batch of each task is its state."""
    out = fresh_folder(spark, "tasks")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.ROCKSDB)
    events = run_stream(spark, folder).where("type = 'agent_progress'").withColumn("why", F.lit(""))
    fields = [f for f in H.FIELD_CHARS if f != "why"]
    wanted = ["task_id", "seq", "action", "artifact", *H.FIELD_CHARS]
    J.run_to_folder(V.fold_progress_stream(events.select(*wanted)), out, mode="update")
    return J.newest_batch(spark, out, ["task_id"], ["revision", "status", *fields])
