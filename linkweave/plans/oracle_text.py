"""DuckDB SQL fragments for the oracles, written apart from the Spark expressions they check."""

from __future__ import annotations

from linkweave.config import WAREHOUSE_HEADERS
from linkweave.sources.catalog import ROLE_TERMS

SCHEMAS = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": (
        "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d"
        " l_returnflag:s l_linestatus:s l_shipdate:t"
    ),
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i embedding:a label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}
COLUMNS = {t: [tuple(c.split(":")) for c in text.split()] for t, text in SCHEMAS.items()}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"replace(lower({x}),'ß','ss')"


def any_of(x: str, markers) -> str:
    return "(" + " or ".join(f"contains({x},{lit(m)})" for m in markers) + ")"


def count_of(x: str, markers) -> str:
    return "(" + " + ".join(f"contains({x},{lit(m)})::int" for m in markers) + ")"


def meaning_ctes(source: str, target: str) -> str:
    """`target`: the rows of `source`, which have a name, with key, kind and base under the warehouse rules."""
    r = WAREHOUSE_HEADERS
    key = "regexp_replace(lower(regexp_replace(name,'^[a-z]{1,2}_','')),'[^a-z0-9]+','','g')"
    refers = any_of("key", r.reference)
    kind = (
        f"case when {any_of('key', r.email)} then 'email' when {any_of('key', r.phone)} then 'phone'"
        f" when {any_of('key', r.url)} then 'url'"
        f" when {any_of('key', r.id)} then case when {refers} then 'reference' else 'id' end"
        f" when {any_of('key', r.code)} then 'code' when {refers} then 'reference'"
        f" when {any_of('key', r.name)} then 'name' else 'other' end"
    )

    def peel(markers):
        x = "key"
        for m in sorted(markers, key=len, reverse=True):
            x = f"replace({x},{lit(m)},'')"
        return x

    base = (
        f"case when kind='url' then replace(replace(key,'url',''),'uri','')"
        f" when kind in ('id','reference') and {any_of('key', r.id)} then {peel(r.id)}"
        f" when kind='code' then {peel(r.code)} when kind='name' then {peel(r.name)} else key end"
    )
    return (
        f"{target}_keyed as (select *, {key} as key from {source}), {target}_kinds as (select *, {kind} as kind from {target}_keyed),"
        f" {target} as (select *, {base} as base from {target}_kinds)"
    )


def catalog_cte(tables=None) -> str:
    """cat(tbl, position, name, key, kind, base) under the warehouse rules."""
    rows = ", ".join(
        f"('{t}',{i},'{c}')" for t in sorted(tables or COLUMNS) for i, (c, _) in enumerate(COLUMNS[t])
    )
    return f"names(tbl,position,name) as (values {rows}), {meaning_ctes('names', 'cat')}"


# columns with a join kind under the warehouse rules
JOINABLE = {
    "benchmark": ["item_id"], "conversations": ["conv_id"], "customer": ["c_custkey", "c_name", "c_nationkey"],
    "documents": ["doc_id", "source"], "embeddings": ["vec_id"], "events": ["event_id", "user_id"],
    "labels": ["doc_id", "toxic"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"], "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "pages": ["page_id", "url"], "part": ["p_partkey", "p_name"], "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
}


def cells_cte(tables=None, texts=()) -> str:
    """cells(tbl, col, rn, v): valid normalised values of the joinable columns. A zero is no value, but in tables read as text."""
    parts = []
    for t in sorted(tables or JOINABLE):
        types = dict(COLUMNS[t])
        for c in JOINABLE[t]:
            text = f"case when {c}=0 and {t not in texts} then '' else coalesce(cast({c} as varchar),'') end" if types[c] in "id" else f"coalesce({c},'')"
            v = fold(f"regexp_replace({text},'\\s+','','g')")
            parts.append(f"select '{t}' as tbl, '{c}' as col, row_number() over () as rn, {v} as v from {t}")
    raw = " union all ".join(parts)
    valid = (
        "v is not null and v<>'' and length(v)<=256 and v not in ('null','none','n/a','na','true','false','未知','无')"
        " and not regexp_full_match(v,'\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}([t\\s].*)?')"
        " and not (kind='name' and length(v)<3)"
    )
    return f"raw as ({raw}), cells as (select raw.* from raw join cat on tbl=cat.tbl and col=name where {valid})".replace(
        "on tbl=cat.tbl and col=name", "on raw.tbl=cat.tbl and raw.col=cat.name"
    )


def values_cte(tables=None, texts=()) -> str:
    """vals: one row per (tbl, col, v) with fingerprint, preview, specificity and the catalog's columns."""
    spec = (
        "case when kind in ('email','phone','url') then 3 when kind in ('id','code','reference') then"
        " case when length(v)>=8 or (regexp_matches(v,'[a-z]') and regexp_matches(v,'[0-9]')) then 3 else 2 end"
        " when length(v)>=8 then 2 else 1 end"
    )
    preview = (
        "case when kind='name' then left(v,72)||case when length(v)>72 then '...' else '' end"
        " when length(v)<=4 then repeat('*',length(v)) when length(v)<=10 then left(v,1)||'***'||right(v,1)"
        " else left(v,4)||'...'||right(v,4) end"
    )
    return (
        f"{catalog_cte()}, {cells_cte(tables, texts)},"
        " dist as (select tbl,col,v,min(rn) as rn,count(*) as n from cells group by 1,2,3),"
        f" vals as (select d.*, position, key, kind, base, sha256(v) as fp, {preview} as preview, {spec} as spec,"
        " 'table:'||d.tbl||';row:'||d.rn||';column:'||d.col as loc from dist d join cat on d.tbl=cat.tbl and d.col=cat.name)"
    )


def compat(a: str, b: str) -> str:
    k = "('id','code','reference')"
    return (
        f"case when {a}.key<>'' and {a}.key={b}.key then 1.0::double when {a}.base<>'' and {a}.base={b}.base then 0.96"
        f" when {a}.kind={b}.kind and {a}.kind in ('email','phone','url') then 0.95"
        f" when {a}.kind={b}.kind and {a}.kind in {k} then 0.82 when {a}.kind in {k} and {b}.kind in {k} then 0.72"
        f" when {a}.kind='name' and {b}.kind='name' and {a}.base<>'' and {b}.base<>'' then 0.76 else 0.0 end"
    )


def relation_id(s: str, t: str, kind: str, sc: str, tc: str) -> str:
    return f"'R-'||left(sha1(concat_ws(chr(0),{s},{t},{kind},{sc},{tc})),12)"


OVERLAP_STEPS = (
    ", prof as (select * from (select *, row_number() over (partition by tbl,col order by fp) as r from vals) where r<=128),"
    " pairs as (select a.fp, a.tbl as s, b.tbl as t, a.col as sc, b.col as tc, a.loc as sl, b.loc as tl, a.preview as sp,"
    f" b.preview as tp, a.spec as ss, b.spec as ts, {compat('a', 'b')} as compat from prof a join prof b on a.fp=b.fp and a.tbl<b.tbl),"
    " good as (select *, least(ss,ts) as spec, count(*) over w as shared, row_number() over (w order by fp) as seq"
    " from pairs where compat>=0.72 window w as (partition by s,sc,t,tc)),"
    " ev as (select *, 'profiled_value_overlap' as type,"
    " round(least(0.97, 0.78+0.12*compat+0.02*least(shared,4)),3) as confidence,"
    " case when (compat>=0.95 and shared>=2 and spec>=2) or (compat>=0.82 and shared>=3 and spec>=3) then 'confirmed'"
    " else 'supported_hypothesis' end as verdict,"
    " printf('Bounded column profiles contain %d exact shared fingerprint(s) (column compatibility %.2f).', shared, compat) as note,"
    f" {relation_id('s', 't', lit('profiled_value_overlap'), 'sc', 'tc')} as rid from good where seq<=12),"
    " rel as (select rid as id, s as source, t as target, type, 'undirected' as direction,"
    " case when bool_or(verdict='confirmed') then 'confirmed' else 'supported_hypothesis' end as verdict,"
    " max(confidence) as confidence, sc as source_column, tc as target_column, min_by(note,seq) as explanation,"
    " count(*) as evidence_count, 0::bigint as omitted_evidence_count from ev group by rid,s,t,type,sc,tc)"
)

OVERLAP = values_cte() + OVERLAP_STEPS

REL_COLUMNS = (
    "id, source, target, type, direction, verdict, confidence, source_column, target_column, explanation,"
    " evidence_count, omitted_evidence_count"
)

# Text columns whose rows hold entities, tables of numbers left out.
TEXT_ROWS = {t: [c for c, k in cols if k == "s"] for t, cols in COLUMNS.items() if any(k == "s" for _, k in cols)}


def discovery_ctes() -> str:
    """The directed probe as SQL, for data with one table at most above the seed budget: seeds, their links, its probe, sample overlaps.

    Ends in `links`, `ev` (evidence once) and `found` (relations).
    """
    counts = " union all ".join(f"select '{t}' as tbl, count(*) as n, count(*)*{len(COLUMNS[t])} as cells from {t}" for t in COLUMNS)
    joined = " union all ".join(
        f"select '{t}' as tbl, row_number() over () as rn, concat_ws(chr(9), {', '.join(f'nullif({c},chr(32))' for c in cols)}) as x from {t}" for t, cols in TEXT_ROWS.items()
    )
    clean = "lower(regexp_replace(regexp_replace({0}, '[.,;:!?)]+$', ''), '\\s+', '', 'g'))"
    label = "([A-Za-z][A-Za-z0-9_ -]{1,30})\\s*[:#]\\s*([A-Za-z0-9][A-Za-z0-9_./-]{3,80})"
    found = (
        f"select tbl, rn, 'email' as sk, 'email' as name, {clean.format('m')} as v from (select tbl, rn, unnest(regexp_extract_all(x, '(?i)[\\w.+-]{{1,64}}@[a-z0-9-]+(?:\\.[a-z0-9-]+)+')) as m from rt)"
        f" union all select tbl, rn, 'url', 'url', {clean.format('m')} from (select tbl, rn, unnest(regexp_extract_all(x, '(?i)https?://[^\\s<>\"'']{{6,300}}')) as m from rt)"
        f" union all select tbl, rn, 'label', l, lower(m) from (select tbl, rn, unnest(regexp_extract_all(x, '{label}', 1)) as l, unnest(regexp_extract_all(x, '{label}', 2)) as m from rt)"
    )
    spec = (
        "case when {k} in ('email','phone','url','uuid') then 3 when {k} in ('id','code','reference','labeled_value') then"
        " case when length(v)>=8 or (regexp_matches(v,'[a-z]') and regexp_matches(v,'[0-9]')) then 3 else 2 end when length(v)>=8 then 2 else 1 end"
    )
    scored = (
        "round(least(0.99, 0.82+0.12*c+0.015*spec),3) as confidence,"
        " case when (c>=0.95 and spec>=2) or (c>=0.82 and spec>=3) then 'confirmed' else 'supported_hypothesis' end as verdict"
    )
    ends = ", ".join(f"{p}.{c} as {p}_{c}" for p in "st" for c in ("tbl", "col", "loc", "preview", "spec"))
    hit = f"{ends}, t.fp, {{compat}} as raw, least(s.spec, t.spec) as sp"
    order = {"rid": relation_id("a_tbl", "b_tbl", "type", "a_col", "b_col")}
    swapped = ", ".join(f"case when s_tbl>t_tbl then {p}_{c} else {q}_{c} end as {e}_{c}" for p, q, e in (("t", "s", "a"), ("s", "t", "b")) for c in ("tbl", "col", "loc", "spec"))
    return (
        f"{values_cte()}{OVERLAP_STEPS}, sized as ({counts}),"
        f" placed as (select tbl, row_number() over (order by {count_of('tbl', ROLE_TERMS)} desc, cells, tbl) as place from sized where cells<=100000),"
        " cand_c as (select fp, tbl, col, key, kind, base, loc, preview, spec, printf('%06d/0/%04d/%s', place, position, fp) as ord"
        " from (select *, row_number() over (partition by tbl,col order by fp) as r from vals) join placed using (tbl) where r<=256),"
        f" rt as ({joined}), te as (select tbl, sk, name, v, min(rn) as rn from ({found}) group by all),"
        f" {meaning_ctes('te', 'tm')},"
        " tk as (select tbl, name as col, v, rn, sha256(v) as fp, case when sk<>'label' then sk else key end as key,"
        " case when sk<>'label' then sk when kind='other' then 'labeled_value' else kind end as kind, case when sk<>'label' then sk else base end as base from tm),"
        " tf as (select * from (select *, row_number() over (partition by tbl, fp order by rn, col, kind) as k from tk) where k=1),"
        f" cand_t as (select fp, tbl, col, key, kind, base, 'table:'||tbl||';row:'||rn as loc, '' as preview, {spec.format(k='kind')} as spec,"
        " printf('%06d/1/0000/%s', place, fp) as ord from (select *, row_number() over (partition by tbl order by fp) as r from tf) join placed using (tbl) where r<=2000),"
        " cand as (select * from cand_c union all select * from cand_t),"
        " adm as (select fp from cand group by fp order by min(ord), fp limit 20000),"
        " seeds as (select * from (select *, row_number() over (partition by fp order by ord, loc) as k from cand where fp in (select fp from adm)) where k<=4),"
        f" ss as (select {hit.format(compat=compat('s', 't'))}, '0/'||t.ord as seq, 'Exact normalized values match across compatible columns (column compatibility %.2f).' as n"
        " from cand t join seeds s on s.fp=t.fp and s.ord<t.ord and s.tbl<>t.tbl),"
        f" pc as (select x.tbl, x.col, x.rn, x.v, cat.position, cat.key, cat.kind, cat.base, sha256(v) as fp, '' as preview, {spec.format(k='cat.kind')} as spec,"
        " 'table:'||x.tbl||';row:'||x.rn||';column:'||x.col as loc from cells x join cat on x.tbl=cat.tbl and x.col=cat.name where x.tbl not in (select tbl from placed)),"
        f" ph as (select {hit.format(compat=compat('s', 't'))}, t.rn, t.position from pc t join seeds s on s.fp=t.fp and s.tbl<>t.tbl),"
        " pn as (select *, dense_rank() over (partition by t_tbl, fp order by rn, position) as cr, count(*) over (partition by t_tbl, fp order by rn, position) as upto,"
        " count(*) over (partition by t_tbl, fp, rn, position) as own from ph where raw>=0.70 or sp>=3),"
        " pm as (select * exclude (cr, upto, own) from pn where cr<=50 and upto-own<50),"
        " pp as (select * exclude (rn, position), printf('1/%06d/%020d/%06d', 1, rn, position) as seq,"
        " 'A bounded seed exactly matches this candidate column (column compatibility %.2f).' as n from pm),"
        f" seeded as (select *, {scored} from (select *, greatest(raw, 0.78) as c, sp as spec from (select * from ss union all select * from pp) where raw>=0.70 or sp>=3)),"
        " links as (select s_tbl, t_tbl, s_col, t_col, s_loc, t_loc, s_spec, t_spec, fp, 'seeded_value_link' as type, confidence, verdict, printf(n, c) as note, seq from seeded"
        " union all select s, t, sc, tc, sl, tl, ss, ts, fp, type, confidence, verdict, note, '2/'||lpad(seq::varchar, 20, '0') from ev),"
        f" canon as (select {swapped}, fp, type, confidence, verdict, note, seq from links), keyed_links as (select *, {order['rid']} as rid from canon),"
        " once as (select * from (select *, row_number() over (partition by rid, fp, a_loc, b_loc order by seq, note) as k from keyed_links) where k=1),"
        " found as (select rid as id, a_tbl as source, b_tbl as target, type, 'undirected' as direction,"
        " case when bool_or(verdict='confirmed') then 'confirmed' else 'supported_hypothesis' end as verdict, max(confidence) as confidence,"
        " a_col as source_column, b_col as target_column, arg_min(note, (seq, fp, a_loc, b_loc)) as explanation, count(*) as evidence_count,"
        " greatest(count(*)-12, 0)::bigint as omitted_evidence_count from once group by rid, a_tbl, b_tbl, type, a_col, b_col)"
    )
