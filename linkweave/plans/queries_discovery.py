"""Registered queries: catalog, occurrences, sketches, links, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.config import WAREHOUSE_HEADERS, WAREHOUSE_VALUES, Limits
from linkweave.functions.values import record_like_name
from linkweave.operators import cards as C
from linkweave.operators import graph as G
from linkweave.operators import links as L
from linkweave.operators import sketches as K
from linkweave.operators.occurrences import (
    describe_values,
    distinct_values,
    occurrences,
    with_row_number,
)
from linkweave.plans import discovery as D
from linkweave.plans import oracle_text as O
from linkweave.plans.registry import query
from linkweave.plans.store import Store
from linkweave.plans.tables import read_table, read_tables
from linkweave.session import cut_lineage, fresh_folder
from linkweave.sources import catalog as S
from linkweave.sources import files as X
from linkweave.sources import sinks as Z

RULES = D.Rules(WAREHOUSE_HEADERS, WAREHOUSE_VALUES)
SEED_TABLES = ("region", "nation", "supplier", "part", "customer", "labels", "benchmark", "embeddings", "pages")
PROBED = ("lineitem", "orders", "documents", "events", "conversations")
STARS = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


# Catalog --------------------------------------------------------------------------------------------


def filled_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, name, filled): cells that are not NULL, one pass per table."""
    parts = []
    for table, df in sorted(tables.items()):
        counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
        parts.append(counts.unpivot([], df.columns, "name", "filled").selectExpr(f"'{table}' AS table", "name", "filled"))
    return D._union(parts)


def counted_catalog(spark: SparkSession, folder: str) -> DataFrame:
    tables = read_tables(spark, folder)
    return S.schema_catalog(spark, tables, RULES.headers).join(filled_cells(tables), ["table", "name"])


FILLED = " union all ".join(
    f"select '{t}' as tbl, '{c}' as name, count({c}) as filled from {t}" for t in O.COLUMNS for c, _ in O.COLUMNS[t]
)
CATALOG = f"with {O.catalog_cte()}, filled as ({FILLED}), full_cat as (select cat.*, filled from cat join filled using (tbl, name))"


@query(f'{CATALOG} select tbl as "table", name, position, key, kind, base, filled from full_cat')
def column_catalog(spark, folder):
    return counted_catalog(spark, folder).select("table", "name", "position", "key", "kind", "base", "filled")


@query(
    "with h as (select doc_id as tbl, unnest(string_split(split_part(text, chr(10), 1), ' ')) as header,"
    " generate_subscripts(string_split(split_part(text, chr(10), 1), ' '), 1) - 1 as position from documents),"
    " n as (select *, coalesce(nullif(trim(header), ''), 'column_'||(position+1)) as name from h),"
    " s as (select *, row_number() over (partition by tbl, name order by position) as seen from n)"
    " select tbl as \"table\", position, name, case when seen=1 then name else name||'_'||(seen-1) end as query_name from s"
)
def unique_headers(spark, folder):
    """First lines of documents read as header rows: blanks are filled, repeats numbered."""
    lines = read_table(spark, folder, "documents").selectExpr(
        "doc_id AS table", "posexplode(split(split_part(text, '\\n', 1), ' ')) AS (position, header)"
    )
    return S.unique_headers(lines).select("table", "position", "name", "query_name")


ROLE_CASE = (
    "case greatest(" + ", ".join(f"n_{r}" for r in C.ROLES) + ") when 0 then 'object' "
    + " ".join(f"when n_{r} then '{r}'" for r in C.ROLES) + " end"
)
ROLES_SQL = (
    f"{CATALOG}, whole as (select *, regexp_replace(lower(name),'[^a-z0-9]+','','g') as wkey from full_cat),"
    " hits as (select *, " + ", ".join(f"{O.count_of('wkey', m)} as n_{r}" for r, m in C.ROLE_MARKERS.items())
    + f" from whole), roles as (select *, {ROLE_CASE} as role from hits)"
)


@query(f'{ROLES_SQL} select tbl as "table", name, role, filled from roles')
def header_roles(spark, folder):
    return C.column_roles(counted_catalog(spark, folder)).select("table", "name", "role", "filled")


_N = {r: f"count(*) filter (role='{r}')" for r in C.ROLES}


@query(
    f"{ROLES_SQL}, t as (select tbl, count(*) as columns, max(filled) as row_count, "
    + ", ".join(f"{v} as c_{r}" for r, v in _N.items())
    + " from roles group by 1) select tbl as \"table\", columns, row_count, case when c_decision>0 then 'decision_or_validation_record'"
    " when c_output>0 and c_state>0 then 'result_or_outcome_record' when c_measure>0 and c_state>0 then 'transaction_or_outcome_record'"
    " when c_time>0 and (c_actor>0 or c_state>0) then 'event_or_activity_record' when c_input>0 then 'input_or_request_material'"
    " when c_rule>=3 then 'rule_or_policy_material' when c_measure>0 then 'measurement_or_transaction_record'"
    " else 'business_object_record' end as material_role from t"
)
def table_roles(spark, folder):
    roles = C.column_roles(counted_catalog(spark, folder))
    rows = roles.groupBy("table").agg(F.max("filled").alias("row_count"))
    return C.table_roles(roles).join(rows, "table").select("table", "columns", "row_count", "material_role")


@query(
    f"{ROLES_SQL}, r1 as (select *, row_number() over (partition by tbl, role order by position) as i from roles),"
    " r2 as (select *, row_number() over (partition by tbl order by role, position) as n from r1 where i<=8)"
    ' select tbl as "table", role, n, name, filled from r2 where n<=40'
)
def bounded_column_groups(spark, folder):
    roles = C.column_roles(counted_catalog(spark, folder))
    return C.bounded_columns(roles).join(roles.select("table", "name", "filled"), ["table", "name"])


@query(
    f"{CATALOG}, g as (select tbl, name, filled, 'header:'||key as label, 1.0::double as score from full_cat where key<>''"
    " union all select tbl, name, filled, 'base:'||base, 0.96 from full_cat where base<>''"
    " union all select tbl, name, filled, 'kind:'||kind, 0.95 from full_cat where kind in ('email','phone','url')"
    " union all select tbl, name, filled, 'kind:'||kind, 0.82 from full_cat where kind in ('id','code','reference')"
    " union all select tbl, name, filled, 'keyed', 0.72 from full_cat where kind in ('id','code','reference')"
    " union all select tbl, name, filled, 'kind:name', 0.76 from full_cat where kind='name' and base<>'')"
    ' select label, score, tbl as "table", name, filled from g'
)
def compatible_columns(spark, folder):
    """Column compatibility for all columns of all tables, as shared labels instead of pairs."""
    catalog = counted_catalog(spark, folder)
    return L.compatible_groups(catalog).join(catalog.select("table", "name", "filled"), ["table", "name"])


@query(
    f"{CATALOG}, sizes as (select tbl, max(filled) as n from full_cat group by 1), opened as (select tbl from sizes where n > 5000)"
    ' select distinct a.tbl as "table", a.name from full_cat a, full_cat b, opened where b.tbl=opened.tbl and a.tbl<>b.tbl'
    f" and {O.compat('a', 'b')} >= 0.72"
)
def reachable_columns(spark, folder):
    """Columns that agree with a column of another large table."""
    catalog = counted_catalog(spark, folder)
    opened = catalog.groupBy("table").agg(F.max("filled").alias("n")).where("n > 5000")
    return L.reachable_columns(catalog, opened)


PAGE_FILES = (
    "pf as (select regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as path, url, page_id, html from pages)"
)


def page_files(spark, folder) -> DataFrame:
    """Pages as files: the path is the address without scheme and query, the content is the HTML."""
    return read_table(spark, folder, "pages").selectExpr(
        "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path", "page_id", "url", "html"
    )


@query(
    f"with {PAGE_FILES}, d as (select path, page_id, octet_length(encode(html)) as size, sha256(html) as sha256,"
    " lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.][^/]*([.][^./]+)$', 1)) as extension from pf)"
    " select row_number() over (order by lower(path), path, page_id) as id, path, page_id, size, sha256, extension,"
    " case when extension in ('.csv','.tsv','.xlsx','.jsonl','.ndjson','.parquet','.sqlite','.sqlite3','.db') then 'tabular'"
    " when extension in ('.txt','.md','.markdown','.log','.sql','.json','.xml','.html','.htm','.yaml','.yml','.ini','.cfg','.conf',"
    "'.pdf','.docx','.pptx','.png','.jpg','.jpeg','.gif','.bmp','.tif','.tiff','.webp') then 'document' else 'binary' end as kind from d"
)
def page_inventory(spark, folder):
    files = page_files(spark, folder).selectExpr(
        "path", "page_id", "octet_length(html) AS size", "sha2(html, 256) AS sha256"
    )
    described = files.selectExpr("*", f"{X.extension('path')} AS extension").selectExpr(
        "*", f"{X.file_kind('extension')} AS kind", "lower(path) AS order_key"
    )
    return X.global_rank(described, ["order_key", "path", "page_id"], "id").drop("order_key")


@query()
def folder_inventory(spark, folder):
    """The data folder itself: every file with size, digest and kind."""
    return X.inventory(spark, folder).select("id", "path", "size", "sha256", "extension", "kind")


LANES = ", ".join(
    f"sum(('0x'||substr(d,{1 + 15 * i},15))::ubigint::hugeint)::varchar as lane{i}" for i in range(4)
)


@query(
    f"with {PAGE_FILES}, l as (select sha256(concat_ws(chr(0), url, octet_length(encode(html))::varchar, page_id::varchar, sha256(html))) as d from pf),"
    f" s as (select count(*) as files, {LANES} from l)"
    " select files, sha256(concat_ws(chr(10), files::varchar, lane0, lane1, lane2, lane3)) as signature from s"
)
def catalog_signature(spark, folder):
    files = page_files(spark, folder).selectExpr(
        "url AS path", "octet_length(html) AS size", "page_id AS modified", "sha2(html, 256) AS sha256"
    )
    return S.catalog_signature(files)


@query(
    f"with {PAGE_FILES}, l as (select split_part(path, '/', 1) as host, sha256(concat_ws(chr(0), path, sha256(html))) as d from pf),"
    f" s as (select host, count(*) as files, {LANES} from l group by 1)"
    " select host, files, sha256(concat_ws(chr(10), files::varchar, lane0, lane1, lane2, lane3)) as digest from s"
)
def folder_digests(spark, folder):
    files = page_files(spark, folder).selectExpr("split_part(path, '/', 1) AS host", "path", "html AS content")
    return S.content_digest(files, "host")


@query(
    f"with {PAGE_FILES}, f as (select string_split(path, '/') as p, octet_length(encode(html)) as size from pf),"
    " e as (select p, size, unnest(range(0, len(p))) as i from f),"
    " c as (select array_to_string(p[1:i], '/') as folder, p[i+1] as child, i = len(p)-1 as leaf, count(*) as files, sum(size) as bytes from e group by 1,2,3)"
    " select folder, sum(files)::bigint as files, sum(bytes)::bigint as bytes, count(*) filter (not leaf) as folders_inside,"
    " count(*) filter (leaf) as files_inside from c group by 1"
)
def folder_rollup(spark, folder):
    return X.folder_rollup(page_files(spark, folder).selectExpr("path", "octet_length(html) AS size"))


@query(
    f"with {PAGE_FILES}, dead as (select distinct array_to_string(string_split(path, '/')[1:2], '/') as d from pf where page_id in (select conv_id from conversations where role='assistant'))"
    " select path, page_id from pf where not exists (select 1 from dead where pf.path = d or starts_with(pf.path, d||'/'))"
)
def live_paths(spark, folder):
    """Paths not under a deleted folder; folders of pages that a conversation answers count as deleted."""
    files = page_files(spark, folder)
    answered = read_table(spark, folder, "conversations").where("role = 'assistant'").selectExpr("conv_id AS page_id").distinct()
    dead = files.join(answered, "page_id", "left_semi").selectExpr("array_join(slice(split(path, '/'), 1, 2), '/') AS path")
    return X.hide_deleted(files.select("path", "page_id"), dead)


COUNTS = " union all ".join(
    f"select '{t}' as tbl, count(*) as row_count, {len(O.COLUMNS[t])} as column_count from {t}" for t in O.COLUMNS
)
ROLE_WORDS = O.count_of("tbl", S.ROLE_TERMS)


@query(
    f"with c as ({COUNTS}), s as (select *, row_count*column_count as cells, {ROLE_WORDS}::double as role_score from c)"
    ' select tbl as "table", row_count, column_count, cells, role_score,'
    " row_number() over (order by role_score desc, cells, tbl) as seed_order from s where cells <= 100000"
)
def seed_tables(spark, folder):
    sizes = D.table_sizes(read_tables(spark, folder))
    return S.seed_tables(sizes).select("table", "row_count", "column_count", "cells", "role_score", "seed_order")


_TOKENS = "list_distinct(regexp_extract_all({0}, '[a-z0-9_]{{2,}}'))"


@query(
    "with g as (select p_partkey, p_name, regexp_replace(lower(p_name), '\\s+', '', 'g') as f, regexp_replace(lower(p_type), '\\s+', '', 'g') as goal from part),"
    f" s as (select *, {O.count_of('f', S.ROLE_TERMS)}::double + 2.0*len(list_intersect({_TOKENS.format('f')}, {_TOKENS.format('goal')}))"
    f" / greatest(len({_TOKENS.format('f')}),1) as score from g) select p_partkey, round(score, 6) as role_score from s"
)
def role_scores(spark, folder):
    part = read_table(spark, folder, "part").selectExpr("p_partkey", f"{S.role_score('p_name', 'p_type')} AS score")
    return part.selectExpr("p_partkey", "round(score, 6) AS role_score")


# Scans ----------------------------------------------------------------------------------------------


@query("select row_number() over () as row_no, o_orderkey, o_totalprice from orders")
def parquet_rows(spark, folder):
    return with_row_number(read_table(spark, folder, "orders")).select("row_no", "o_orderkey", "o_totalprice")


@query("select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, c_mktsegment from customer")
def delimited_scan(spark, folder):
    """Customers written as semicolon-separated text and read back with a sniffed separator."""
    path = fresh_folder(spark, "csv")
    read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option(
        "header", True
    ).option("sep", ";").csv(path)
    return X.read_delimited(spark, path)


@query(
    "select event_type, count(*) as n, sum(cast(json_extract_string(props,'$.k') as bigint))::bigint as k_sum, min(event_id) as first_event from events group by 1"
)
def json_lines_scan(spark, folder):
    """Events written as JSON lines and read back as text columns."""
    path = fresh_folder(spark, "jsonl")
    read_table(spark, folder, "events").select("event_id", "event_type", "props").write.json(path)
    rows = X.read_json_lines(spark, path)
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.expr("sum(bigint(get_json_object(props, '$.k'))) AS k_sum"),
        F.expr("min(bigint(event_id)) AS first_event"),
    )


# Occurrences and sketches ---------------------------------------------------------------------------


def star_scan(spark, folder, names=tuple(O.JOINABLE)):
    return D.scan(spark, read_tables(spark, folder, names), RULES)


@query(
    f"with {O.values_cte()} select tbl as \"table\", col as \"column\", rn as row_no, n as cells, fp as fingerprint, kind, loc as locator,"
    " preview, spec as specificity from vals"
)
def value_occurrences(spark, folder):
    """Every distinct join value of every table: fingerprint, first row, masked preview, specificity."""
    catalog, cells = star_scan(spark, folder)
    return describe_values(distinct_values(cells), catalog).select(
        "table", "column", "row_no", "cells", "fingerprint", "kind", "locator", "preview", "specificity"
    )


@query(
    f"with {O.catalog_cte()}, {O.cells_cte(['lineitem', 'orders'])} select tbl as \"table\", col as \"column\", count(*) as cells,"
    " count(distinct v) as values from cells where rn <= 1000 group by 1,2"
)
def bootstrap_scan(spark, folder):
    """First thousand rows of tables too large to be seeds (the bootstrap sample is the feature)."""
    tables = read_tables(spark, folder, ("lineitem", "orders"))
    columns = S.join_columns(S.schema_catalog(spark, tables, RULES.headers))
    cells = occurrences(tables, columns, RULES.values, {t: RULES.limits.bootstrap_rows for t in tables})
    return cells.groupBy("table", "column").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("value").alias("values"))


@query(
    f"with {O.values_cte()}, b as (select *, row_number() over (partition by tbl,col order by fp) as r from vals)"
    ' select tbl as "table", col as "column", fp as fingerprint, rn as row_no from b where r <= 256'
)
def bottom_k_sample(spark, folder):
    catalog, cells = star_scan(spark, folder)
    return K.bottom_k(distinct_values(cells), 256).select("table", "column", "fingerprint", "row_no")


@query(
    f"with {O.values_cte()}, b as (select *, row_number() over (partition by tbl,col order by fp) as r from vals)"
    ' select tbl as "table", col as "column", fp as fingerprint, rn as row_no from b where r <= 32'
)
def prefiltered_bottom_k(spark, folder):
    """The same sample, smaller, by the way meant for huge columns: cut off in the scan, then checked."""
    catalog, cells = star_scan(spark, folder)
    return K.sampled_bottom_k(cells, K.cardinality(cells), 32).select("table", "column", "fingerprint", "row_no")


@query(
    f"with {O.values_cte()} select tbl as \"table\", col as \"column\", sum(n)::bigint as nonempty, count(*)::double as \"distinct\","
    " round(least(1.0, count(*)::double/sum(n)),6) as ratio from vals group by 1,2"
)
def column_cardinality(spark, folder):
    return K.cardinality(star_scan(spark, folder)[1], exact=True)


@query()
def column_cardinality_sketch(spark, folder):
    """Distinct counts from 256-register sketches: one pass, no shuffle of values."""
    return K.cardinality(star_scan(spark, folder)[1])


@query(f"with {O.values_cte()} select tbl as \"table\", col as \"column\", sum(n)::bigint as nonempty, true as close from vals group by 1,2")
def sketch_error(spark, folder):
    """Whether each sketched distinct count lies within four standard errors (26 %) of the exact one."""
    cells = star_scan(spark, folder)[1]
    exact = K.cardinality(cells, exact=True).withColumnRenamed("distinct", "counted")
    sketched = K.cardinality(cells).select("table", "column", F.col("distinct").alias("estimate"))
    return exact.join(sketched, ["table", "column"]).select(
        "table", "column", "nonempty", (F.abs(F.col("estimate") - F.col("counted")) <= 0.26 * F.col("counted")).alias("close")
    )


@query(
    f"with {O.values_cte()}, b as (select *, row_number() over (partition by tbl,col order by fp) as r, count(*) over (partition by tbl,col) as d,"
    ' sum(n) over (partition by tbl,col) as s from vals) select tbl as "table", col as "column", r as rank, fp as fingerprint,'
    " s::bigint as nonempty, d as \"distinct\", round(least(1.0, d::double/s),6) as ratio from b where r<=128"
)
def column_profile(spark, folder):
    return K.column_profile(star_scan(spark, folder)[1], 128).select(
        "table", "column", "rank", "fingerprint", "nonempty", "distinct", "ratio"
    )


# Links and relations --------------------------------------------------------------------------------


@query(f"with {O.OVERLAP} select {O.REL_COLUMNS} from rel")
def profile_relations(spark, folder):
    """Which columns of which tables hold the same values."""
    return D.profile_relations(spark, read_tables(spark, folder), RULES)


@query(
    f"with {O.OVERLAP} select rid as relation_id, seq as rank, 'bottom_k_exact_overlap' as kind, sl as source_locator, tl as target_locator,"
    " sc as source_column, tc as target_column, case when ss>=ts then sp else tp end as value_preview, fp as fingerprint,"
    " case when spec>=2 then 'strong' else 'corroborating' end as strength, note from ev"
)
def profile_evidence(spark, folder):
    return L.kept_evidence(D.profile_evidence(spark, read_tables(spark, folder), RULES))


@query(
    f"with {O.OVERLAP} select s as source, sc as source_column, t as target, tc as target_column, max(compat) as compat, count(*) as shared"
    " from pairs where compat>=0.72 group by 1,2,3,4"
)
def column_overlap(spark, folder):
    """Compatible columns of different tables that share values, with the number shared."""
    catalog, cells = star_scan(spark, folder)
    return L.column_overlap(D.profiles(catalog, cells, RULES)).groupBy(
        F.col("s_file").alias("source"), F.col("s_column").alias("source_column"),
        F.col("t_file").alias("target"), F.col("t_column").alias("target_column"),
    ).agg(F.max("compat").alias("compat"), F.count(F.lit(1)).alias("shared"))


@query(
    f"with {O.OVERLAP} select r.source, r.target, r.source_column, r.target_column, r.confidence, r.evidence_count,"
    " case when a.key=b.key then 'same_header' else 'same_semantic_base' end as alignment from rel r"
    " join cat a on a.tbl=r.source and a.name=r.source_column join cat b on b.tbl=r.target and b.name=r.target_column"
    " where r.verdict='confirmed' and ((a.key<>'' and a.key=b.key) or (a.base<>'' and a.base=b.base and a.kind=b.kind and a.kind<>'other'))"
)
def field_correspondences(spark, folder):
    tables = read_tables(spark, folder)
    rows = D.profile_relations(spark, tables, RULES)
    return L.field_correspondences(rows, S.schema_catalog(spark, tables, RULES.headers)).select(
        "source", "target", "source_column", "target_column", "confidence", "evidence_count", "alignment"
    )


def star_seeds(spark, folder, limits: Limits = RULES.limits):
    """Candidate seeds of the small tables: bottom-k per column, in reading order."""
    catalog, cells = star_scan(spark, folder, SEED_TABLES)
    sample = describe_values(K.bottom_k(distinct_values(cells), limits.seed_values_per_column), catalog)
    place = "CASE table " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(SEED_TABLES)) + " END"
    return catalog, sample.selectExpr(
        "*", "table AS file", f"format_string('%06d/0/%04d/%s', {place}, position, fingerprint) AS ord"
    )


_PLACE = "case tbl " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(SEED_TABLES)) + " end"
SEEDS = (
    f"{O.values_cte(SEED_TABLES)}, cand as (select * from (select *, row_number() over (partition by tbl,col order by fp) as r,"
    f" printf('%06d/0/%04d/%s', {_PLACE}, position, fp) as ord from vals) where r<=256),"
    " adm as (select fp from cand group by fp order by min(ord), fp limit {cap}),"
    " seeds as (select * from (select *, row_number() over (partition by fp order by ord, loc) as k from cand where fp in (select fp from adm)) where k<=4)"
)


@query(
    f"with {SEEDS.replace('{cap}', '1500')} select fp as fingerprint, tbl as \"table\", col as \"column\", ord, loc as locator, spec as specificity from seeds"
)
def seed_index(spark, folder):
    """Bounded seed index of the small tables; the bound of 1500 values bites."""
    limits = Limits(max_seed_values=1500)
    catalog, candidates = star_seeds(spark, folder, limits)
    return L.seed_index(candidates, limits).select("fingerprint", "table", "column", "ord", "locator", "specificity")


_SEEDED = (
    "round(least(0.99, 0.82+0.12*c+0.015*spec),3) as confidence,"
    " case when (c>=0.95 and spec>=2) or (c>=0.82 and spec>=3) then 'confirmed' else 'supported_hypothesis' end as verdict"
)


@query(
    f"with {SEEDS.replace('{cap}', '20000')}, m as (select s.tbl as s_table, s.col as s_column, t.tbl as t_table, t.col as t_column, t.fp as fingerprint,"
    f" {O.compat('s', 't')} as raw, least(s.spec,t.spec) as spec from seeds s join cand t on s.fp=t.fp and s.ord<t.ord and s.tbl<>t.tbl),"
    f" g as (select *, greatest(raw,0.78) as c from m where raw>=0.70 or spec>=3)"
    f" select s_table, s_column, t_table, t_column, fingerprint, {_SEEDED} from g"
)
def seed_links(spark, folder):
    """Links of each seed with the seeds of other tables met before it."""
    catalog, candidates = star_seeds(spark, folder)
    candidates = cut_lineage(candidates)
    index = L.seed_index(candidates)
    return L.seed_seed_links(index, candidates).select(
        "s_table", "s_column", "t_table", "t_column", "fingerprint", "confidence", "verdict"
    )


PROBE = (
    f"{SEEDS.replace('{cap}', '20000')}, {O.cells_cte(PROBED).replace('raw as', 'praw as', 1).replace('cells as (select raw.* from raw', 'pcells as (select praw.* from praw').replace('on raw.tbl=cat.tbl and raw.col=cat.name', 'on praw.tbl=cat.tbl and praw.col=cat.name')},"
    " p as (select x.*, cat.position, cat.key, cat.kind, cat.base, sha256(v) as fp, case when cat.kind in ('id','code','reference') then"
    " case when length(v)>=8 or (regexp_matches(v,'[a-z]') and regexp_matches(v,'[0-9]')) then 3 else 2 end when length(v)>=8 then 2 else 1 end as spec"
    " from pcells x join cat on x.tbl=cat.tbl and x.col=cat.name),"
    f" m as (select s.tbl as s_table, s.col as s_column, s.ord as s_ord, p.tbl as t_table, p.col as t_column, p.fp as fingerprint, p.rn as row_no, p.position,"
    f" {O.compat('s', 'p')} as raw, least(s.spec,p.spec) as spec from seeds s join p on s.fp=p.fp and s.tbl<>p.tbl),"
    " g as (select *, greatest(raw,0.78) as c from m where raw>=0.70 or spec>=3),"
    " n as (select *, dense_rank() over (partition by t_table, fingerprint order by row_no, position) as cr,"
    " count(*) over (partition by t_table, fingerprint order by row_no, position) as upto,"
    " count(*) over (partition by t_table, fingerprint, row_no, position) as own from g),"
    f" matches as (select *, {_SEEDED} from n where cr<=50 and upto-own<50)"
)


def probe(spark, folder):
    catalog, candidates = star_seeds(spark, folder)
    seeds = L.seed_index(cut_lineage(candidates))
    tables = read_tables(spark, folder, SEED_TABLES + PROBED)
    catalog = S.schema_catalog(spark, tables, RULES.headers)
    columns = S.join_columns(catalog)
    cells = occurrences(tables, {t: columns[t] for t in PROBED}, RULES.values)
    return catalog, cells, L.probe_seeds(cells, catalog, seeds)


@query(
    f"with {PROBE} select s_table, s_column, t_table, t_column, fingerprint, row_no, confidence, verdict from matches"
)
def seed_probe(spark, folder):
    """Cells of the large tables that equal a seed, under the cap of fifty matches a value."""
    return probe(spark, folder)[2].select(
        "s_table", "s_column", "t_table", "t_column", "fingerprint", "row_no", "confidence", "verdict"
    )


@query(
    f"with {PROBE}, rows as (select distinct t_table, row_no from matches), f as (select p.tbl, p.col, p.fp, min(p.rn) as rn from p join rows on p.tbl=t_table and p.rn=row_no group by 1,2,3),"
    " b as (select *, row_number() over (partition by tbl,col order by fp) as r from f)"
    ' select tbl as "table", col as "column", fp as fingerprint, rn as row_no from b where r<=128'
)
def frontier_values(spark, folder):
    """Values that stand next to a matched value: the next seeds."""
    catalog, cells, matches = probe(spark, folder)
    return L.frontier(cells, matches, 128).select("table", "column", "fingerprint", "row_no")


@query(
    f"with {O.values_cte(PROBED)}, st as (select tbl, col, least(1.0, count(*)::double/sum(n)) as ratio from vals group by 1,2)"
    ' select distinct st.tbl as "table", st.col as "column", round(st.ratio,6) as ratio from st join cat a on a.tbl=st.tbl and a.name=st.col, cat b'
    f" where st.ratio>=0.01 and b.tbl in ('lineitem','orders') and a.tbl<>b.tbl and {O.compat('a', 'b')}>=0.72"
)
def expandable_columns(spark, folder):
    """Columns whose neighbours may become seeds, while lineitem and orders are still open."""
    catalog, cells = star_scan(spark, folder, PROBED)
    opened = spark.createDataFrame([("lineitem",), ("orders",)], "table string")
    stats = K.cardinality(cells, exact=True)
    return L.expandable_columns(catalog, opened, stats).select("table", "column", "ratio")


@query(f"with {O.discovery_ctes()} select {O.REL_COLUMNS} from found")
def directed_discovery(spark, folder):
    """The whole directed probe: seeds, greedy scans, follow-up seeds, sample overlaps, relations."""
    return D.discover(spark, read_tables(spark, folder), RULES)["relations"]


@query(
    f"with {O.discovery_ctes()}, opened as (select tbl from sized where tbl not in (select tbl from placed)),"
    " fr as (select tbl, col, fp from pc where exists (select 1 from pm where pm.t_tbl=pc.tbl and pm.rn=pc.rn) group by 1,2,3),"
    " fk as (select * from (select *, row_number() over (partition by tbl, col order by fp) as r from fr) where r<=128)"
    f" select count(*) as tables, count(*) as completed, {len(O.JOINABLE)} as readable, (select count(*) from opened) as probe_steps, sum(n)::bigint as rows_scanned,"
    " (select count(*) from pm) as matches, (select count(*) from fk) as frontier_values, 'complete' as status, (select count(distinct fp) from seeds) as seed_values,"
    " (select count(*) from prof) as profile_values, (select count(*) from found) as relations, (select count(*) from found where verdict='confirmed') as confirmed from sized"
)
def discovery_coverage(spark, folder):
    return D.coverage(D.discover(spark, read_tables(spark, folder), RULES))


@query(f"with {O.discovery_ctes()} select {O.REL_COLUMNS}, true as second_run_read_nothing from found")
def resumed_discovery(spark, folder):
    """A discovery run again with the passes its first run has kept: the same relations, and no table is read."""
    tables, kept = read_tables(spark, folder), fresh_folder(spark, "kept")
    D.discover(spark, tables, RULES, store=Store(spark, kept))
    store = Store(spark, kept)
    rows = D.discover(spark, tables, RULES, store=store)["relations"]
    return rows.withColumn("second_run_read_nothing", F.lit(not store.made))


MIXED = {"customer": "csv", "nation": "tsv", "supplier": "jsonl", "region": "csv", "part": "ndjson"}
"""Tables written in text formats; the others stay Parquet."""


def mixed_folder(spark, folder, names=tuple(O.JOINABLE)) -> str:
    """The tables of a folder, some of them as text."""
    out = fresh_folder(spark, "mixed")
    for name in names:
        df, kind = read_table(spark, folder, name), MIXED.get(name, "parquet")
        if kind in ("csv", "tsv"):
            df.write.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(f"{out}/{name}.{kind}")
        else:
            (df.write.parquet if kind == "parquet" else df.write.json)(f"{out}/{name}.{kind}")
    return out


@query(f"with {O.values_cte(texts=MIXED)}{O.OVERLAP_STEPS} select {O.REL_COLUMNS} from rel")
def mixed_folder_relations(spark, folder):
    """Relations of a folder of Parquet, CSV, TSV and JSON-lines tables; text keeps its zeros."""
    out = mixed_folder(spark, folder)
    tables, _ = X.read_folder(spark, out, X.inventory(spark, out))
    return D.profile_relations(spark, {name.split(".")[0]: df for name, df in tables.items()}, RULES)


@query(
    "with f as (select doc_id, sha256(text) as sha256 from documents), g as (select sha256, min(doc_id) as source, count(*) as copies from f group by 1 having count(*)>1)"
    f" select {O.relation_id("printf('%010d', source)", "printf('%010d', doc_id)", O.lit('exact_duplicate'), O.lit('whole-file'), O.lit('whole-file'))} as id,"
    " printf('%010d', source) as source, printf('%010d', doc_id) as target, 1.0::double as confidence, sha256 as fingerprint, copies"
    " from f join g using (sha256) where doc_id<>source"
)
def exact_duplicates(spark, folder):
    """Documents with the same text, each tied to the first copy of its group."""
    files = read_table(spark, folder, "documents").selectExpr("format_string('%010d', doc_id) AS path", "sha2(text, 256) AS sha256")
    return L.duplicate_links(files).select("id", "source", "target", "confidence", "fingerprint", "copies")


@query(
    f"select 'doc/'||doc_id as source, 'item/'||item_id as target, 0.99::double as confidence from documents d, benchmark b"
    f" where length(b.text)>=4 and contains({O.fold('d.text')}, {O.fold('b.text')})"
)
def explicit_references(spark, folder):
    """Documents that hold the whole text of a benchmark item, taken as its name."""
    texts = read_table(spark, folder, "documents").selectExpr("concat('doc/', doc_id) AS path", "'file' AS locator", "text")
    names = read_table(spark, folder, "benchmark").selectExpr("concat('item/', item_id) AS path", "text AS file_name")
    return L.explicit_references(texts, names).select("source", "target", "confidence").distinct()


_WALK = (
    ", e as (select source as a, target as b from rel where verdict='confirmed' union select target, source from rel where verdict='confirmed'),"
    " w as (select a as node, a as reach from e union select w.node, e.b from w join e on w.reach=e.a)"
)


@query(
    f"with recursive {O.OVERLAP}{_WALK} select node, min(reach) as component from w group by 1"
)
def connected_files(spark, folder):
    rows = cut_lineage(D.profile_relations(spark, read_tables(spark, folder), RULES).where("verdict = 'confirmed'"))
    return G.components(rows)


@query(
    f"with recursive {O.OVERLAP}{_WALK}, m as (select node, min(reach) as component from w group by 1),"
    f" l as (select component, count(*) as files, {LANES} from (select component, sha256(node) as d from m) group by 1),"
    " n as (select component, files, 'C-'||left(sha256(concat_ws(chr(10), files::varchar, lane0, lane1, lane2, lane3)),12) as chain_id from l),"
    " r as (select component, count(*) as relation_count from rel join m on rel.source=node where verdict='confirmed' group by 1)"
    " select chain_id, component as first_file, files, relation_count from n join r using (component)"
)
def chains(spark, folder):
    rows = cut_lineage(D.profile_relations(spark, read_tables(spark, folder), RULES).where("verdict = 'confirmed'"))
    return G.chains(rows)["summary"].select("chain_id", "first_file", "files", "relation_count")


@query(
    f"with recursive {O.OVERLAP}, k as (select id, source as a, target as b, row_number() over (order by confidence desc, id) as r from rel),"
    " d as (select r, a, b from k union all select r, b, a from k),"
    " w as (select k.r as e, k.a as node from k union select w.e, d.b from w join d on d.a=w.node and d.r<w.e)"
    " select id from k where not exists (select 1 from w where w.e=k.r and w.node=k.b)"
)
def core_relations(spark, folder):
    """Maximum spanning forest over all relations of all tables."""
    rows = cut_lineage(D.profile_relations(spark, read_tables(spark, folder), RULES))
    return G.spanning_forest(rows)


@query(
    "with recursive e as (select 'c'||o_custkey as a, 'o'||o_orderkey as b from orders union select 'p'||l_partkey, 's'||l_suppkey from lineitem"
    " union select 'n'||n_nationkey, 'r'||n_regionkey from nation),"
    " one as (select 'c'||o_custkey as node, min('c'||o_custkey) as component from orders group by 1"
    " union all select 'o'||o_orderkey, min('c'||o_custkey) from orders group by 1"
    " union all select x, (select min(x) from (select 'p'||l_partkey as x from lineitem union select 's'||l_suppkey from lineitem))"
    " from (select 'p'||l_partkey as x from lineitem union select 's'||l_suppkey from lineitem)"
    " union all select 'n'||n_nationkey, min(m) from nation join (select n_regionkey as rk, min('n'||n_nationkey) as m from nation group by 1) on rk=n_regionkey group by 1"
    " union all select 'r'||n_regionkey, min('n'||n_nationkey) from nation group by 1)"
    " select node, component from one"
)
def connected_rows(spark, folder):
    """Components of the graph of orders, parts, suppliers and nations; one of them holds most edges."""
    t = read_tables(spark, folder, ("orders", "lineitem", "nation"))
    edges = (
        t["orders"].selectExpr("concat('c', o_custkey) AS source", "concat('o', o_orderkey) AS target")
        .unionAll(t["lineitem"].selectExpr("concat('p', l_partkey)", "concat('s', l_suppkey)"))
        .unionAll(t["nation"].selectExpr("concat('n', n_nationkey)", "concat('r', n_regionkey)"))
    )
    return G.components(edges)


# Sinks ----------------------------------------------------------------------------------------------


@query(f"with {O.OVERLAP} select 'run-1' as run_id, {O.REL_COLUMNS} from rel")
def stored_relations(spark, folder):
    """Relations written to the result tables of a run and read back."""
    out = fresh_folder(spark, "result")
    evidence = cut_lineage(D.profile_evidence(spark, read_tables(spark, folder), RULES))
    Z.write_tables({"relations": L.relations(evidence), "evidence": L.kept_evidence(evidence)}, out, "run-1")
    return Z.read_table(spark, out, "relations").select("run_id", *[c.strip() for c in O.REL_COLUMNS.split(",")])


@query(
    f"with {O.OVERLAP}, f as (select distinct x as file from (select source as x from rel union all select target from rel)),"
    " n as (select file, row_number() over (order by file) as node from f)"
    " select 'flowchart LR' as line union all select '  F'||node||'[\"'||file||'\"]' from n"
    " union all select '  F'||a.node||' ---|\"'||type||' '||printf('%.2f', confidence)||'\"| F'||b.node from rel join n a on a.file=source join n b on b.file=target"
)
def mermaid_chart(spark, folder):
    rows = cut_lineage(D.profile_relations(spark, read_tables(spark, folder), RULES))
    return Z.mermaid_lines(rows).select("line")


@query(
    f"with {O.OVERLAP} select id, 0 as part, 0 as rank, '### '||id||' · '||type as line from rel"
    " union all select id, 1, 0, concat_ws(chr(10), '`'||source||'` ↔ `'||target||'`', '', '- 列：`'||source_column||'` ↔ `'||target_column||'`',"
    " '- 判定：`'||verdict||'`；置信度：`'||printf('%.3f', confidence)||'`', '- 说明：'||explanation, '- 证据总数：'||evidence_count) from rel"
    " union all select rid, 2, seq::int, '- 证据：`bottom_k_exact_overlap`；`'||sl||'` ↔ `'||tl||'`；匹配 `'||case when ss>=ts then sp else tp end||'`；指纹 `'||left(fp, 16)||'...`' from ev"
)
def relation_report(spark, folder):
    evidence = cut_lineage(D.profile_evidence(spark, read_tables(spark, folder), RULES))
    return Z.relation_report(L.relations(evidence), L.kept_evidence(evidence))


@query(
    "select c_custkey, c_name, (length(regexp_replace(c_name, '\\D', '', 'g'))*2 >= length(c_name) and length(c_name)>=9)"
    " or (length(c_name)>=10 and regexp_matches(c_name,'\\d') and regexp_full_match(c_name,'[A-Za-z0-9_.:/\\-]+')) as record_like from customer"
)
def record_like_names(spark, folder):
    return read_table(spark, folder, "customer").selectExpr("c_custkey", "c_name", f"{record_like_name('c_name')} AS record_like")
