"""Registered queries: validation of many claimed graphs, one per conversation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from linkweave.functions import statements as T
from linkweave.operators import claims as V
from linkweave.plans import oracle_text as O
from linkweave.plans.queries_text import LABEL_KIND, LABEL_STRENGTH, label_cards
from linkweave.plans.registry import ORACLES, query
from linkweave.plans.tables import read_table
from linkweave.session import cut_lineage, fresh_folder
from linkweave.sources import sinks as Z

# One text for both engines: each turn of a conversation claims a node and an edge to the turn before.
_TYPES = (
    "case when turn = 0 then 'input' else case length(text) % 6 when 0 then 'activity' when 1 then 'object' when 2 then 'output'"
    " when 3 then 'state' when 4 then 'decision' else 'widget' end end"
)
_EDGE_TYPES = (
    "case length(text) % 8 when 0 then 'feeds' when 1 then 'produces' when 2 then 'triggers' when 3 then 'branches_to'"
    " when 4 then 'derives' when 5 then 'joins_with' when 6 then 'precedes' else 'likes' end"
)
_NAME = "case when length(text) % 7 = 0 then '1000' || (conv_id * 1003 + turn) || '77' else split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) end"
NODES = f"select conv_id as graph_id, 'n' || turn as id, {_TYPES} as type, {_NAME} as name, turn, {{ev}} as evidence_ids from {{c}}"
EDGES = (
    "select conv_id as graph_id, 'e' || turn as id, 'n' || (turn - 1) as source, case when length(text) % 11 = 0 then 'n' || (turn - 1)"
    f" when length(text) % 13 = 0 then 'x' || turn else 'n' || turn end as target, {_EDGE_TYPES} as type, (length(text) % 130) / 100.0 as confidence,"
    " {ev} as evidence_ids from {c} where turn > 0"
)
CHAIN = "select conv_id as graph_id, turn as pos, case when length(text) % 17 = 0 then 'n0' else 'n' || turn end as node from {c} where turn < 4"
BRANCHES = (
    "select conv_id as graph_id, case when conv_id % 2 = 1 then 100 - turn else turn end as pos, 'b' || turn as id, 'n' || (turn - 1) as origin,"
    " {path} as path, {ev} as evidence_ids from {c} where turn >= 4"
)
COVERAGE = (
    "select conv_id as graph_id, 'src' || (length(text) % 20) as file, length(text) % 3 > 0 as included, case when length(text) % 5 = 0 then '' else 'because' end as reason,"
    " {ev} as evidence_ids from {c}"
)
INVENTORY = "select distinct conv_id as graph_id, 'src' || (turn % 20) as file from {c} union select conv_id, 'src' || (length(text) % 20) from {c} where length(text) % 4 > 0"
GRAPHS = "select conv_id as graph_id, min(role) as name, case when max(turn) > 3 then 'asks' else ' ' end as purpose from {c} group by conv_id"

_DUCK_EV = "[printf('E-%010d', conv_id), printf('E-%010d', turn * 3 + length(text) % 5)]"
_DUCK = {"c": "conversations", "ev": _DUCK_EV, "path": "['n' || turn, 'n' || (turn + length(text) % 2)]"}
_SPARK_EV = "array(format_string('E-%010d', conv_id), format_string('E-%010d', turn * 3 + length(text) % 5))"
_SPARK_PATH = "array('n' || turn, 'n' || (turn + length(text) % 2))"
CLAIMS = ", ".join(
    f"{n} as ({text.format(**_DUCK)})"
    for n, text in (("nodes", NODES), ("edges", EDGES), ("chain", CHAIN), ("branches", BRANCHES), ("cover", COVERAGE), ("inventory", INVENTORY), ("graphs", GRAPHS))
) + (
    f", cards as (select printf('E-%010d', doc_id) as id, {LABEL_KIND} as kind, {LABEL_STRENGTH} as strength, source as file, text as snippet from documents join labels using (doc_id))"
)


def claims(spark, folder) -> V.Claims:
    turns = read_table(spark, folder, "conversations")

    def frame(text):
        return spark.sql(text.replace("{ev}", _SPARK_EV).replace("{path}", _SPARK_PATH), c=turns)

    return V.Claims(
        graphs=frame(GRAPHS), nodes=frame(NODES), edges=frame(EDGES), chain=frame(CHAIN), branches=frame(BRANCHES),
        coverage=frame(COVERAGE), inventory=frame(INVENTORY), cards=label_cards(spark, folder),
    )


def found(rule: str, table: str, subject: str, where: str) -> str:
    return f"select graph_id, '{rule}' as rule, ({subject})::varchar as subject from {table} where {where}"


def any_in(items) -> str:
    return "(" + ",".join(O.lit(i) for i in items) + ")"


_SIZED = "length(trim(name)) between 2 and 80"
_RECORD = (
    "(regexp_full_match(trim(name),'[0-9][0-9,./:\\- ]*') or (length(regexp_replace(name,'\\s','','g'))>=9 and 2*length(regexp_replace(name,'\\D','','g'))>=length(regexp_replace(name,'\\s','','g')))"
    " or (length(regexp_replace(name,'\\s','','g'))>=10 and regexp_matches(name,'\\d') and regexp_full_match(regexp_replace(name,'\\s','','g'),'[A-Za-z0-9_.:/\\-]+')))"
)


@query(f"with {CLAIMS} " + " union all ".join([
    found("too_many_nodes", "(select graph_id, count(*) as n from nodes group by 1)", "n", "n>10"),
    found("too_many_edges", "(select graph_id, count(*) as n from edges group by 1)", "n", "n>14"),
    found("too_many_branches", "(select graph_id, count(*) as n from branches group by 1)", "n", "n>3"),
    found("node_type", "nodes", "id", f"type not in {any_in(V.NODE_TYPES)}"),
    found("node_name_length", "nodes", "id", f"not {_SIZED}"),
    found("node_name_is_record", "nodes", "id", f"{_SIZED} and {_RECORD}"),
    found("edge_type", "edges", "id", f"type not in {any_in(V.EDGE_TYPES)}"),
    found("edge_self_loop", "edges", "id", "source=target"),
    found("edge_confidence", "edges", "id", "not confidence between 0 and 1"),
    found("scenario_text", "graphs", "''", "trim(name)='' or trim(purpose)=''"),
]))
def claim_sizes(spark, folder):
    return V.size_rules(claims(spark, folder))


@query(f"with {CLAIMS}, per as (select graph_id, count(*) as n, min_by(node,pos) as head, max_by(node,pos) as tail from chain group by 1) " + " union all ".join([
    found("chain_too_short", "per", "n", "n<3"),
    found("chain_repeats", "(select distinct graph_id from chain group by graph_id, node having count(*)>1)", "''", "true"),
    found("chain_start_type", "(select per.graph_id, head, type from per join nodes on per.graph_id=nodes.graph_id and id=head)", "head", f"type not in {any_in(V.START_TYPES)}"),
    found("chain_end_type", "(select per.graph_id, tail, type from per join nodes on per.graph_id=nodes.graph_id and id=tail)", "tail", f"type not in {any_in(V.END_TYPES)}"),
]))
def claim_chains(spark, folder):
    return V.chain_rules(claims(spark, folder))


_OWNERS = (
    "own as (select graph_id, 'node' as owner, id as owner_id, evidence_ids from nodes union all select graph_id, 'edge', id, evidence_ids from edges union all select graph_id, 'branch', id, evidence_ids from branches"
    " union all select graph_id, 'excluded', file, evidence_ids from cover where not included),"
    " cited as (select graph_id, owner, owner_id, unnest(evidence_ids) as card from own)"
)


@query(f"with {CLAIMS}, {_OWNERS}, ends as (select graph_id, id, unnest([source,target]) as node from edges), steps as (select graph_id, id, unnest(path) as node from branches)"
       " select distinct graph_id, 'edge_unknown_node' as rule, id as subject from ends e where not exists (select 1 from nodes n where n.graph_id=e.graph_id and n.id=e.node)"
       " union all select distinct graph_id, 'chain_unknown_node', node from chain e where not exists (select 1 from nodes n where n.graph_id=e.graph_id and n.id=e.node)"
       " union all select distinct graph_id, 'branch_unknown_node', id from steps e where not exists (select 1 from nodes n where n.graph_id=e.graph_id and n.id=e.node)"
       " union all select distinct graph_id, 'unknown_card', owner||':'||owner_id||':'||card from cited where card not in (select id from cards)")
def claim_references(spark, folder):
    return V.reference_rules(claims(spark, folder))


_RULES = ", ".join(f"('{t}','{s}','{e}')" for t, (ss, ee) in V.ENDPOINTS.items() for s in ss for e in ee)
_TYPED = (
    f"rules(type, st, tt) as (values {_RULES}), te as (select e.*, a.type as st, b.type as tt from edges e join nodes a on a.graph_id=e.graph_id and a.id=e.source join nodes b on b.graph_id=e.graph_id and b.id=e.target),"
    " wrong as (select * from te where type in (select type from rules) and not exists (select 1 from rules r where r.type=te.type and r.st=te.st and r.tt=te.tt))"
)


@query(f"with {CLAIMS}, {_TYPED} select graph_id, 'edge_endpoint_types' as rule, id||':'||st||'->'||tt as subject from wrong")
def claim_endpoints(spark, folder):
    return V.endpoint_rules(claims(spark, folder))


@query(f"with {CLAIMS}, {_TYPED} select graph_id, id, coalesce(string_agg(distinct r.type, ',' order by r.type),'') as fitting from wrong left join rules r on r.st=wrong.st and r.tt=wrong.tt group by 1,2")
def claim_hints(spark, folder):
    """Edge types that would fit the ends of each edge that breaks the rule."""
    return V.endpoint_hints(claims(spark, folder))


@query(f"with recursive {CLAIMS}, att as (select graph_id, node from chain union select b.graph_id, unnest(b.path) from branches b join att a on a.graph_id=b.graph_id and a.node=b.origin),"
       f" s as (select graph_id, 'main_chain' as owner, lag(node) over (partition by graph_id order by pos) as source, node as target, false as first from chain),"
       " b0 as (select graph_id, id as owner, list_prepend(origin, path) as p, unnest(range(1, len(path)+1)) as i from branches b where exists (select 1 from att a where a.graph_id=b.graph_id and a.node=b.origin)),"
       " st as (select * from s where source is not null union all select graph_id, owner, p[i], p[i+1], i=1 from b0),"
       f" flow as (select distinct graph_id, source, target from edges where type in {any_in(V.FLOW_TYPES)}), br as (select distinct graph_id, source, target from edges where type='branches_to')"
       " select graph_id, 'step_without_flow_edge' as rule, owner||':'||source||'->'||target as subject from st where not first and not exists (select 1 from flow f where f.graph_id=st.graph_id and f.source=st.source and f.target=st.target)"
       " union all select graph_id, 'branch_start', owner||':'||source||'->'||target from st where first and not exists (select 1 from br f where f.graph_id=st.graph_id and f.source=st.source and f.target=st.target)")
def claim_paths(spark, folder):
    return V.path_rules(claims(spark, folder))


_ORDERED = O.any_of(O.fold("snippet"), T.SEQUENCE_MARKERS + T.BRANCH_MARKERS)
_STATED = f"kind in {any_in(V.STATED)}"


@query(f"with {CLAIMS}, c as (select e.graph_id, e.id, e.type, cards.* exclude (id), {_ORDERED} as ordered from (select graph_id, id, type, unnest(evidence_ids) as card from edges where type in {any_in(V.EDGE_TYPES)}) e join cards on cards.id=e.card),"
       f" f as (select graph_id, id, type, count(*) as n, bool_or(kind='field_relationship') as linked, bool_or({_STATED}) as stated, bool_or({_STATED} and ordered) as ord, count(*) filter (kind='goal_relation_statement') as goals,"
       " bool_or(kind='table_process_signal') as signal, sum(case strength when 'direct' then 3 when 'structural' then 2 when 'corroborating' then 1 else 0 end) as weight, bool_or(strength in ('direct','structural')) as firm from c group by 1,2,3)"
       f" select graph_id, id, type, case when type in {any_in(V.LINKED)} and linked then true when type in {any_in(V.ORDER_TYPES)} then ord or goals>=2 or (signal and n>=2) when stated then true else weight>=4 and firm end as adequate from f")
def claim_adequacy(spark, folder):
    """Whether the cards an edge cites are enough for its type."""
    return V.evidence_adequacy(claims(spark, folder))


@query(f"with recursive {CLAIMS}, u as (select graph_id, source as a, target as b from edges union select graph_id, target, source from edges), h as (select graph_id, min_by(node,pos) as head from chain group by 1),"
       " r as (select graph_id, head as node from h union select r.graph_id, u.b from r join u on u.graph_id=r.graph_id and u.a=r.node)"
       " select distinct n.graph_id, 'disconnected_node' as rule, n.id as subject from nodes n join h using (graph_id) where not exists (select 1 from r where r.graph_id=n.graph_id and r.node=n.id)")
def claim_connectivity(spark, folder):
    return V.connectivity_rules(claims(spark, folder))


@query(f"with recursive {CLAIMS}, att as (select graph_id, node from chain union select b.graph_id, unnest(b.path) from branches b join att a on a.graph_id=b.graph_id and a.node=b.origin)"
       " select graph_id, 'branch_unattached' as rule, id as subject from branches b where not exists (select 1 from att a where a.graph_id=b.graph_id and a.node=b.origin)")
def claim_unattached(spark, folder):
    """Branches that never attach to the main chain or to another branch."""
    return V.branch_rules(claims(spark, folder)).where("rule = 'branch_unattached'")


# branches read in order, pass after pass: (pass, pos) is when each attaches; no graph needs more passes than it has branches
_ATTACHED = (
    "w(graph_id, pos, pass) as (select b.graph_id, b.pos, 1 from branches b join chain c on c.graph_id=b.graph_id and c.node=b.origin"
    " union select b.graph_id, b.pos, w.pass + (w.pos > b.pos)::int from w join branches h on h.graph_id=w.graph_id and h.pos=w.pos"
    " join branches b on b.graph_id=h.graph_id and b.pos<>h.pos and list_contains(h.path, b.origin)"
    " where w.pass <= (select count(*) from branches n where n.graph_id=w.graph_id)),"
    " od as (select graph_id, pos, min(pass) as pass from w group by 1,2), fixed as (select b.*, pass, path[len(path)] as endpoint from branches b join od using (graph_id, pos)),"
    " pool as (select graph_id, node, 0 as pass, -1 as pos from chain union select graph_id, unnest(path), pass, pos from fixed)"
)


@query(f"with recursive {CLAIMS}, {_ATTACHED},"
       " fine as (select a.graph_id, a.pos from fixed a join pool p on p.graph_id=a.graph_id and p.node=a.endpoint and (p.pass<a.pass or (p.pass=a.pass and p.pos<a.pos))"
       " union select a.graph_id, a.pos from fixed a join edges e on e.graph_id=a.graph_id and e.source=a.endpoint and e.type='returns_to' join pool p on p.graph_id=a.graph_id and p.node=e.target and (p.pass<a.pass or (p.pass=a.pass and p.pos<a.pos))"
       f" union select a.graph_id, a.pos from fixed a join nodes n on n.graph_id=a.graph_id and n.id=a.endpoint and n.type in {any_in(V.END_TYPES)})"
       " select b.graph_id, 'branch_unattached' as rule, id as subject from branches b anti join od using (graph_id, pos)"
       " union all select a.graph_id, 'branch_end', id from fixed a anti join fine using (graph_id, pos)")
def claim_branches(spark, folder):
    return V.branch_rules(claims(spark, folder))


@query(f"with {CLAIMS}, {_OWNERS}, inc as (select distinct graph_id, file from cover where included), exc as (select distinct graph_id, file from cover where not included and reason<>''),"
       " nam as (select * from inc union select * from exc), ci as (select cited.*, file from cited join cards on id=card), used as (select distinct graph_id, file from ci where owner<>'excluded'),"
       " has as (select distinct graph_id, owner_id as file from ci where owner='excluded'), here as (select distinct graph_id, owner_id as file from ci where owner='excluded' and file=owner_id)"
       " select graph_id, 'file_outside_inventory' as rule, file as subject from (select * from nam except select * from inventory)"
       " union all select graph_id, 'file_not_covered', file from (select * from inventory except select * from nam)"
       " union all select graph_id, 'file_in_and_out', file from (select * from inc intersect select * from exc)"
       " union all select graph_id, 'exclusion_without_reason', file from cover where not included and reason=''"
       " union all select graph_id, 'exclusion_evidence_elsewhere', file from (select * from has except select * from here)"
       " union all select graph_id, 'included_file_unused', file from (select * from inc except select * from used)")
def claim_coverage(spark, folder):
    return V.coverage_rules(claims(spark, folder))


@query(ORACLES["claim_coverage"].replace(
    "ci as (select cited.*, file from", "ci as (select cited.*, unnest(list_distinct([file, 'src'||((substr(cards.id, 3)::bigint * 7 + 3) % 20)])) as file from"))
def claim_coverage_pairs(spark, folder):
    """Coverage where cards speak of two files: citing one uses both."""
    one = claims(spark, folder)
    cards = one.cards.selectExpr("*", "array_distinct(array(file, concat('src', (bigint(substring(id, 3)) * 7 + 3) % 20))) AS files")
    return V.coverage_rules(replace(one, cards=cards))


_ALL_RULES = " union ".join(
    f"select graph_id, rule, subject::varchar as subject from ({ORACLES[name]})"
    for name in ("claim_sizes", "claim_chains", "claim_references", "claim_endpoints", "claim_paths", "claim_connectivity", "claim_branches", "claim_coverage")
) + f" union select graph_id, 'weak_evidence', id||':'||type from ({ORACLES['claim_adequacy']}) where not adequate"


@query(_ALL_RULES)
def claim_violations(spark, folder):
    """All broken rules of all graphs."""
    return V.violations(claims(spark, folder))


@query(f"with {CLAIMS}, {_TYPED} select graph_id, purpose from graphs where graph_id not in (select graph_id from wrong)")
def valid_claims(spark, folder):
    """Graphs whose edges all join ends that fit their types."""
    all_claims = claims(spark, folder)
    return V.valid_graphs(all_claims, V.endpoint_rules(all_claims)).select("graph_id", "purpose")


@query(
    f"with {CLAIMS}, bad as ({_ALL_RULES}), n as (select graph_id, count(distinct rule) as rules, count(*) as violations from bad group by 1)"
    " select g.graph_id, coalesce(rules, 0) as broken_rules, coalesce(violations, 0) as violations, rules is null as valid from graphs g left join n using (graph_id)"
)
def graph_validity(spark, folder):
    """Every graph with the rules of all families that it breaks; valid where it breaks none."""
    all_claims = claims(spark, folder)
    broken = cut_lineage(V.violations(all_claims))
    per_graph = broken.groupBy("graph_id").agg(F.countDistinct("rule").alias("rules"), F.count(F.lit(1)).alias("found"))
    valid = V.valid_graphs(all_claims, broken).select("graph_id", F.lit(True).alias("fine"))
    rows = all_claims.graphs.select("graph_id").join(per_graph, "graph_id", "left").join(valid, "graph_id", "left")
    return rows.selectExpr("graph_id", "coalesce(rules, 0) AS broken_rules", "coalesce(found, 0) AS violations", "coalesce(fine, false) AS valid")


@query(f"with {CLAIMS}, p as (select graph_id, lag(node) over (partition by graph_id order by pos) as source, node as target, true as main from chain union all"
       " select graph_id, q[i], q[i+1], false from (select graph_id, list_prepend(origin, path) as q, unnest(range(1, len(path)+1)) as i from branches)),"
       " m as (select graph_id, source, target, bool_or(main) as main from p group by 1,2,3)"
       " select distinct graph_id, 'flowchart TB' as line from nodes union all select graph_id, '  '||id||'[\"'||left(replace(replace(name,'\"',''''),chr(10),' '),80)||'\"]' from nodes"
       " union all select e.graph_id, '  '||e.source||' '||case when main then '==>' when main is not null then '-.->' else '-->' end||'|\"'||type||'\"| '||e.target from edges e left join m using (graph_id, source, target)")
def claim_charts(spark, folder):
    """Mermaid lines of every claimed graph."""
    c = claims(spark, folder)
    return Z.scenario_mermaid(c.nodes, c.edges, V.path_steps(c)).select("graph_id", "line")


_CITED = (
    "cited as (select graph_id, 'node' as claim_kind, id as claim_id, unnest(evidence_ids) as evidence_id from nodes"
    " union all select graph_id, 'edge', id, unnest(evidence_ids) from edges)"
)


@query(f"with {CLAIMS}, {_CITED} select graph_id, claim_kind, claim_id, evidence_id, kind, strength, file, snippet from cited join cards on cards.id=evidence_id")
def stored_claims(spark, folder):
    """Claims and the cards they cite, written to the result tables of a run and read back."""
    out = fresh_folder(spark, "claims")
    Z.write_tables(Z.claim_tables(claims(spark, folder)), out, "run-1")
    cards = Z.read_table(spark, out, "evidence_cards").withColumnRenamed("id", "evidence_id")
    return Z.read_table(spark, out, "claim_evidence").join(cards, "evidence_id").select(
        "graph_id", "claim_kind", "claim_id", "evidence_id", "kind", "strength", "file", "snippet"
    )


@query(f"with {CLAIMS}, nn as (select graph_id, id as node, name from nodes),"
       " head as (select g.graph_id, g.name, purpose, (select count(*) from nodes n where n.graph_id=g.graph_id) as n, (select count(*) from edges n where n.graph_id=g.graph_id) as e, (select count(*) from branches n where n.graph_id=g.graph_id) as b from graphs g),"
       " main as (select graph_id, string_agg(coalesce(name, node), ' → ' order by pos) as route from chain left join nn using (graph_id, node) group by 1),"
       " step as (select graph_id, id, origin, unnest(path) as node, generate_subscripts(path, 1) as k from branches),"
       " way as (select graph_id, id, any_value(origin) as origin, string_agg(coalesce(name, node), ' → ' order by k) as route from step left join nn using (graph_id, node) group by 1, 2),"
       " ed as (select e.*, coalesce(s.name, source) as sn, coalesce(t.name, target) as tn from edges e left join nn s on s.graph_id=e.graph_id and s.node=source left join nn t on t.graph_id=e.graph_id and t.node=target),"
       " ev as (select graph_id, id as item, unnest(evidence_ids) as card, generate_subscripts(evidence_ids, 1) as k from edges), fi as (select distinct graph_id, file, included, reason from cover)"
       " select graph_id, 0 as part, '' as item, 0 as rank, '# 业务场景宏观数据关系' as line from head union all select graph_id, 0, '', 1, '- 场景：'||name from head union all select graph_id, 0, '', 2, '- 目的：'||purpose from head"
       " union all select graph_id, 0, '', 3, '- 节点：'||n||'；关系：'||e||'；分支：'||b from head"
       " union all select graph_id, 1, '', 0, '## 主数据路径' from main union all select graph_id, 1, '', 1, route from main"
       " union all select way.graph_id, 2, id, 0, '- '||coalesce(nn.name, origin)||' --[分支]→ '||route from way left join nn on nn.graph_id=way.graph_id and nn.node=origin"
       " union all select graph_id, 3, id, 0, '### '||id||' · '||type from ed union all select graph_id, 3, id, 1, sn||' → '||tn from ed union all select graph_id, 3, id, 2, '- 置信度：'||printf('%.3f', confidence::double) from ed"
       " union all select graph_id, 3, item, 2+k::int, '- `'||card||'` ['||strength||'] '||file||'：'||snippet from ev join cards on cards.id=card"
       " union all select graph_id, 4, file, 0, '- 已纳入 `'||file||'`' from fi where included union all select graph_id, 5, file, 0, '- 排除 `'||file||'`：'||reason from fi where not included")
def scenario_report(spark, folder):
    """The report of every claimed graph: counts, main path, branches, relations with their evidence, files."""
    return Z.scenario_report(claims(spark, folder))
