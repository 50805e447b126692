"""Registered queries: statements, entities, cards, text functions, previews, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions import nested
from linkweave.functions import statements as T
from linkweave.functions import text as X
from linkweave.functions.values import describe_entities, heading_like, text_entities
from linkweave.operators import cards as C
from linkweave.operators import preview as P
from linkweave.operators import search as R
from linkweave.operators.texts import known_names, scan_texts
from linkweave.plans import oracle_text as O
from linkweave.plans import queries_discovery as Q
from linkweave.plans.registry import query
from linkweave.plans.tables import read_table, read_tables
from linkweave.session import cut_lineage, spread
from linkweave.sources import catalog as S
from linkweave.sources import files as F_

# DuckDB: lines and statements of a text, in order. Spaces and line feeds are the only white space there.
LINES = "string_split(rtrim({0}, chr(10)), chr(10))"
_SPLIT = "string_split_regex(regexp_replace({0}, '([.!?。！？；;])\\s*', '\\1' || chr(1), 'g'), chr(1) || '|[\\r\\n]+')"
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def statements_sql(text: str) -> str:
    flat = _FLAT.format("x")
    return (
        f"list_transform(list_filter(list_transform({_SPLIT.format(text)}, lambda x: {flat}), lambda x: length(x)>=6),"
        " lambda x: left(x,320) || case when length(x)>320 then '...' else '' end)"
    )


MARK = (
    f"(3*{O.count_of('f', T.RELATION_MARKERS)} + 2*{O.any_of('f', T.SEQUENCE_MARKERS)}::int + 2*{O.any_of('f', T.BRANCH_MARKERS)}::int)"
)
MARKER_LIST = "array_to_string(list_sort(list_filter([" + ",".join(O.lit(m) for m in T.RELATION_MARKERS) + "], lambda m: contains(f, m)))[1:12], '|')"


def document_lines(spark, folder) -> DataFrame:
    """Lines of documents as segments of their source: (file, doc_id, line_no, ord, locator, text)."""
    lines = F_.line_segments(spread(read_table(spark, folder, "documents").select("source", "doc_id", "text")))
    return lines.selectExpr(
        "source AS file", "doc_id", "line_no", "doc_id * 1000000 + line_no AS ord",
        "concat('doc:', doc_id, ';', locator) AS locator", "line AS text",
    )


SEGMENTS = (
    f"ln as (select source as file, doc_id, unnest({LINES.format('text')}) as line, generate_subscripts({LINES.format('text')}, 1) as line_no from documents),"
    f" st as (select file, doc_id, line_no, 'doc:'||doc_id||';line:'||line_no as locator, unnest({statements_sql('line')}) as statement from ln),"
    f" fo as (select *, {O.fold('statement')} as f from st), sc as (select *, {MARK} as score from fo)"
)


@query(f"with {SEGMENTS} select doc_id, line_no, locator, line as text from (select *, 'doc:'||doc_id||';line:'||line_no as locator from ln)")
def text_segments(spark, folder):
    return document_lines(spark, folder).select("doc_id", "line_no", "locator", "text")


@query(f"with {SEGMENTS} select doc_id, count(*) as statements, sum(length(statement))::bigint as chars, sum(score)::bigint as score from sc group by 1")
def statement_scores(spark, folder):
    """Statements of each document with the sum of their relationship scores."""
    segments = document_lines(spark, folder)
    parts = segments.selectExpr("doc_id", f"explode({T.split_statements('text')}) AS statement")
    scored = parts.selectExpr("doc_id", "statement", f"{X.casefold('statement')} AS folded").selectExpr(
        "doc_id", "char_length(statement) AS n", f"{T.marker_score('folded')} AS score"
    )
    return scored.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("statements"), F.sum("n").alias("chars"), F.sum("score").alias("score")
    )


_BEST = (
    f"with {SEGMENTS}, nm as (select *, regexp_replace(f,'[^a-z0-9]+','','g') as name from sc where score>0),"
    " one as (select *, row_number() over (partition by file, name order by score desc, locator, statement) as copy from nm where name<>''),"
    " rk as (select *, row_number() over (partition by file order by score desc, locator, statement) as rank from one where copy=1)"
)


@query(f"{_BEST} select file, rank, locator, statement, score, {MARKER_LIST} as markers from rk where rank<=40")
def best_statements(spark, folder):
    """Forty best relationship statements of each source, equal texts once."""
    best = C.best_statements(C.scored_statements(document_lines(spark, folder)))
    return best.withColumn("markers", F.array_join("markers", "|"))


@query(f"with {SEGMENTS} select doc_id, line_no, statement from sc where length(trim(statement)) between 2 and 100"
       " and regexp_matches(trim(statement), '^(#{1,6}\\s+|\\d+(\\.\\d+)*[.)、\\s]|[-*•]\\s+)')")
def heading_statements(spark, folder):
    parts = document_lines(spark, folder).selectExpr("doc_id", "line_no", f"explode({T.split_statements('text')}) AS statement")
    return parts.where(heading_like("statement"))


@query(
    "with t as (select conv_id, turn, list_filter(list_distinct(regexp_extract_all("
    + O.fold("text") + ", '[a-z0-9]{3,}')), lambda w: w not in ('xlsx','csv','table')) as w from conversations)"
    " select conv_id, turn, len(w) as tokens, array_to_string(list_sort(w), ' ') as words from t"
)
def relation_tokens(spark, folder):
    rows = read_table(spark, folder, "conversations").selectExpr("conv_id", "turn", f"{T.relation_tokens('text')} AS w")
    return rows.selectExpr("conv_id", "turn", "bigint(size(w)) AS tokens", "array_join(array_sort(w), ' ') AS words")


_LAB = "([A-Za-z][A-Za-z0-9_ -]{1,30})\\s*[:#]\\s*([A-Za-z0-9][A-Za-z0-9_./-]{3,80})"
_CLEAN = "regexp_replace({0}, '[.,;:!?)]+$', '')"


@query(
    "with m as (select doc_id, 'email' as kind, unnest(regexp_extract_all(text, '(?i)[\\w.+-]{1,64}@[a-z0-9-]+(?:\\.[a-z0-9-]+)+')) as x from documents"
    " union all select doc_id, 'url', unnest(regexp_extract_all(text, '(?i)https?://[^\\s<>\"'']{6,300}')) from documents"
    " union all select doc_id, 'uuid', unnest(regexp_extract_all(text, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}')) from documents)"
    f" select doc_id, kind, sha256(lower({_CLEAN.format('x')})) as fingerprint from m"
)
def text_entities_found(spark, folder):
    """E-mails, links and UUIDs in documents."""
    found = read_table(spark, folder, "documents").selectExpr("doc_id", f"inline({text_entities('text')})")
    return describe_entities(found.where("source_kind IN ('email', 'url', 'uuid')")).select("doc_id", "kind", "fingerprint")


@query(
    f"select doc_id, label, lower(value) as value from (select doc_id, unnest(regexp_extract_all(text, '{_LAB}', 1)) as label, unnest(regexp_extract_all(text, '{_LAB}', 2)) as value from documents)"
)
def labelled_values(spark, folder):
    """`label: value` pairs in documents."""
    found = read_table(spark, folder, "documents").selectExpr("doc_id", f"inline({text_entities('text')})")
    return found.where("source_kind = 'label'").select("doc_id", "label", "value")


# One text for both engines; every fifth number is too long for a telephone.
_NOTE = (
    "concat('Order ref: ORD-', o_orderkey, ', customer no # CUST-', o_custkey, '/', o_orderstatus, '; call ',"
    " case when o_orderkey % 5 = 0 then '9' else '' end, '1', 3 + o_custkey % 7, lpad(cast(o_orderkey as {text}), 9, '0'), ' now')"
)


@query(
    f"with n as (select o_orderkey, {_NOTE.format(text='varchar')} as note from orders)"
    " select o_orderkey, 'phone' as kind, 'phone' as label, regexp_extract(note, 'call ([0-9]+)', 1) as value from n where o_orderkey % 5 <> 0"
    f" union all select o_orderkey, 'label', unnest(regexp_extract_all(note, '{_LAB}', 1)), lower(unnest(regexp_extract_all(note, '{_LAB}', 2))) from n"
)
def note_entities(spark, folder):
    """Telephone numbers and labelled values in a note on each order."""
    notes = read_table(spark, folder, "orders").selectExpr("o_orderkey", f"{_NOTE.format(text='string')} AS note")
    found = notes.selectExpr("o_orderkey", f"inline({text_entities('note')})")
    return found.where("source_kind IN ('phone', 'label')").select("o_orderkey", F.col("source_kind").alias("kind"), "label", "value")


# Cards ----------------------------------------------------------------------------------------------


def all_cards(spark, folder) -> DataFrame:
    """Cards of tables, links, documents and goals of the data folder."""
    tables = read_tables(spark, folder)
    # written: a row a column and a row a table, which the cards of tables read many times
    catalog = cut_lineage(S.schema_catalog(spark, tables, Q.RULES.headers), "catalog")
    sizes = Q.D.table_sizes(tables).select("table", "row_count").join(Q.D.table_bytes(tables), "table")
    files = cut_lineage(sizes.selectExpr(
        "table", "concat(table, '.parquet') AS file", "'.parquet' AS extension", "size", "'tabular' AS kind", "row_count"
    ), "files")
    relations = Q.D.profile_relations(spark, tables, Q.RULES)
    fields = C.field_cards(Q.L.field_correspondences(relations, catalog))
    names = files.selectExpr("file").unionAll(read_table(spark, folder, "documents").selectExpr("source AS file")).distinct()
    names = cut_lineage(names.selectExpr("file AS path", "file AS file_name", "regexp_extract(file, '^([^.]*)', 1) AS stem"))
    said, cells, heads = card_texts(spark, folder, tables, names)
    statements = C.statement_cards(C.best_statements(said, extra=("mentioned",)))
    in_tables = C.statement_cards(C.best_statements(cells, extra=("column", "mentioned")), from_table=True)
    outlines = C.outline_cards(C.outline_rows(heads))
    goals = C.goal_cards(goal_lines(spark, folder))
    return C.union_cards(C.schema_cards(catalog, files), fields, statements, in_tables, outlines, goals)


def card_texts(spark, folder, tables: dict[str, DataFrame], names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored statements of documents and of the text cells of all tables, and headings of documents, as far as cards may be made of them."""
    known = known_names(names)
    if known is None:  # too many names for a task: statements meet them in joins
        said = C.mention_scores(C.scored_statements(document_lines(spark, folder)), names)
        cells = C.mention_scores(C.scored_statements(C.table_segments(tables, {t: f"{t}.parquet" for t in tables}), ("column",)), names)
        return said, cells, C.scored_statements(document_lines(spark, folder), ("ord",))
    passes = [
        scan_texts(df, t, f"{t}.parquet", known, ("source", "doc_id", "text") if t == "documents" else None) for t, df in sorted(tables.items())
    ]
    kept = cut_lineage(C.union_cards(*[p for p in passes if p is not None]), "texts")  # all tables in one job
    return tuple(kept.where(f"what = '{what}'") for what in ("line", "cell", "head"))


def small_table_cells(spark, folder, sizes: DataFrame) -> DataFrame:
    """Text cells of the tables within the seed budget, as segments of their files; cards are made of all tables (card_texts)."""
    tables = read_tables(spark, folder)
    small = {r["table"] for r in sizes.collect() if r["row_count"] * len(tables[r["table"]].columns) <= Q.RULES.limits.seed_cell_budget}
    return C.table_segments({t: df for t, df in tables.items() if t in small}, {t: f"{t}.parquet" for t in tables})


_CELLS = " union all ".join(
    f"select '{t}.parquet' as file, '{c}' as col, 'table:{t};row:'||row_number() over ()||';column:{c}' as locator, {c} as text, (select count(*)*{len(O.COLUMNS[t])} from {t}) as cells from {t}"
    for t, cols in O.TEXT_ROWS.items() for c in cols
)


@query(
    f"with ce as (select * from ({_CELLS}) where cells<=100000 and length(trim(text))>=6), st as (select file, col, locator, unnest({statements_sql('text')}) as statement from ce),"
    f" fo as (select *, {O.fold('statement')} as f from st), sc as (select *, {MARK} as score from fo),"
    " nm as (select *, regexp_replace(f,'[^a-z0-9]+','','g') as name from sc where score>0),"
    " one as (select *, row_number() over (partition by file, name order by score desc, locator, statement) as copy from nm where name<>''),"
    " rk as (select *, row_number() over (partition by file order by score desc, locator, statement) as rank from one where copy=1)"
    f" select case when {MARKER_LIST}<>'' then 'table_relation_statement' else 'material_topic_alignment' end as kind,"
    f" case when {MARKER_LIST}<>'' and score>=5 then 'direct' else 'structural' end as strength, file, locator, statement as snippet from rk where rank<=40"
)
def table_statement_cards(spark, folder):
    """Cards of the best relationship statements in the text cells of small tables."""
    cells = small_table_cells(spark, folder, Q.D.table_sizes(read_tables(spark, folder)))
    best = C.best_statements(C.scored_statements(cells, ("column",)), extra=("column",))
    return C.statement_cards(best, from_table=True).select("kind", "strength", "file", "locator", "snippet")


_NAME_TOKENS = "list_filter(list_distinct(regexp_extract_all({0}, '[a-z0-9]{{3,}}')), lambda w: w not in ('xlsx','csv','table'))"


@query(
    f"with {SEGMENTS}, na as (select 'item/'||item_id as target, left(text, 24) as file_name, {_NAME_TOKENS.format(O.fold('left(text, 60)'))} as w from benchmark),"
    f" ds as (select distinct file, locator, statement, score from sc), tk as (select *, {O.fold('statement')} as f, {_NAME_TOKENS.format(O.fold('statement'))} as w from ds),"
    f" g as (select file, locator, statement, score, target, greatest(case when length(file_name)>=4 and contains(f, {O.fold('file_name')}) then 6 else 0 end,"
    " case when length(file_name)>=4 and len(na.w)>=3 and len(list_intersect(tk.w, na.w))>=3 then least(6, len(list_intersect(tk.w, na.w))) else 0 end) as gain from tk, na)"
    " select file, locator, statement, (score + sum(gain))::bigint as score, array_to_string(list_sort(list(target)), ' ') as mentioned from g where gain>0 group by file, locator, statement, score"
)
def statement_mentions(spark, folder):
    """Statements of documents that name a benchmark item or share three words with its begin, and their scores."""
    names = read_table(spark, folder, "benchmark").selectExpr("concat('item/', item_id) AS path", "left(text, 24) AS file_name", "left(text, 60) AS stem")
    scored = C.mention_scores(C.scored_statements(document_lines(spark, folder)), names).where("size(mentioned) > 0")
    return scored.selectExpr("file", "locator", "statement", "bigint(score) AS score", "array_join(mentioned, ' ') AS mentioned").distinct()


def goal_lines(spark, folder) -> DataFrame:
    """Lines of what users ask for: the goal text of each conversation."""
    asked = read_table(spark, folder, "conversations").where("role = 'user' AND turn = 0").selectExpr(
        "concat('goal/', conv_id) AS file", "text"
    )
    return F_.line_segments(asked).select("file", "line_no", "line")


@query(
    f"with ln as (select 'goal/'||conv_id as file, unnest({LINES.format('text')}) as line, generate_subscripts({LINES.format('text')}, 1) as line_no from conversations where role='user' and turn=0),"
    f" s0 as (select file, line_no, {statements_sql('line').replace('[.!?。！？；;]', '[.!?。！？；;，,]')} as l from ln),"
    " st as (select file, line_no, unnest(l) as statement, generate_subscripts(l,1) as p from s0),"
    f" fo as (select *, {O.fold('statement')} as f from st), sc as (select *, {MARK} as score, regexp_replace(f,'[^a-z0-9]+','','g') as name from fo),"
    " one as (select *, row_number() over (partition by file, name order by line_no, p) as copy from sc where score>0),"
    " rk as (select *, row_number() over (partition by file order by line_no, p) as rank from one where copy=1)"
    f" select file, rank, line_no, statement, score, {MARKER_LIST} as markers from rk where rank<=20"
)
def goal_statements(spark, folder):
    return C.goal_statements(goal_lines(spark, folder)).withColumn("markers", F.array_join("markers", "|"))


@query(f"{_BEST} select case when {MARKER_LIST}<>'' then 'document_relation_statement' else 'material_topic_alignment' end as kind,"
       f" case when {MARKER_LIST}<>'' and score>=5 then 'direct' else 'structural' end as strength, file, locator, statement as snippet from rk where rank<=40")
def statement_cards(spark, folder):
    best = C.best_statements(C.scored_statements(document_lines(spark, folder)))
    return C.statement_cards(best).select("kind", "strength", "file", "locator", "snippet")


@query()
def evidence_cards(spark, folder):
    """All cards, unique and bounded."""
    return C.bound_cards(cut_lineage(all_cards(spark, folder)), 300)


@query()
def card_kinds(spark, folder):
    return C.kind_histogram(all_cards(spark, folder))


@query()
def synthesis_brief(spark, folder):
    """Cards worth reading first, for the goals of the users."""
    cards = cut_lineage(all_cards(spark, folder))
    words = goal_lines(spark, folder).selectExpr(f"explode({T.relation_tokens('line')}) AS token")
    context = words.unionAll(cards.select("file").distinct().selectExpr(f"explode({T.relation_tokens('file')}) AS token"))
    return C.compact_cards(C.synthesis_brief(cards, context))


def label_cards(spark, folder) -> DataFrame:
    """A card per labelled document; kind and strength come from its labels and language."""
    t = read_tables(spark, folder, ("documents", "labels"))
    return t["documents"].join(t["labels"], "doc_id").selectExpr(
        "format_string('E-%010d', doc_id) AS id", f"{LABEL_KIND} AS kind", f"{LABEL_STRENGTH} AS strength", "source AS file",
        "lang AS statement", "text AS snippet",
    )


LABEL_KIND = "CASE lang WHEN 'en' THEN 'document_relation_statement' WHEN 'de' THEN 'field_relationship' WHEN 'fr' THEN 'table_process_signal' ELSE 'file_structure' END"
LABEL_STRENGTH = "CASE WHEN toxic = 1 THEN 'contextual' WHEN quality = 1 THEN 'direct' ELSE 'structural' END"
LABELLED = (
    f"lc as (select printf('E-%010d', doc_id) as id, {LABEL_KIND} as kind, {LABEL_STRENGTH} as strength, source as file, lang as statement, text as snippet from documents join labels using (doc_id)),"
    " pr as (select *, case strength when 'direct' then 0 when 'structural' then 1 else 3 end as priority from lc)"
)


@query(
    f"with {LABELLED}, n as (select count(*) filter (kind='file_structure') as must from pr),"
    " r as (select *, row_number() over (order by priority, kind, id) as k from pr where kind<>'file_structure')"
    " select id, kind, strength from pr where kind='file_structure' union all select id, kind, strength from r, n where k <= greatest(60 - must, 0)"
)
def bounded_cards(spark, folder):
    return C.bound_cards(label_cards(spark, folder), 60).select("id", "kind", "strength")


@query(
    f"with {LABELLED}, f as (select *, row_number() over (partition by file order by id) as k from pr where kind='field_relationship')"
    " select id, kind, file from f where k=1 order by file, id limit 16"
)
def first_card_per_file(spark, folder):
    return C.first_per_file(label_cards(spark, folder), "field_relationship", 16).select("id", "kind", "file")


@query(
    f"with {LABELLED}, f as (select * from pr where kind='document_relation_statement')"
    " select id, strength, (select count(*) from f) as total, (select count(*) from f) > 25 as has_more from f order by id limit 20 offset 5"
)
def evidence_page(spark, folder):
    page = C.evidence_page(label_cards(spark, folder), 5, 20, kinds=("document_relation_statement",))
    return page.select("id", "strength", "total", "has_more")


@query(f"with {LABELLED} select kind, count(*) as cards from lc group by 1")
def card_histogram(spark, folder):
    return C.kind_histogram(label_cards(spark, folder))


# Text functions -------------------------------------------------------------------------------------


@query(
    "select doc_id, line_no, line from (select doc_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) as line,"
    " generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) as line_no from documents) where contains(line, 'tion the')"
)
def grep_lines(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return F_.grep_lines(docs, "tion the").selectExpr("doc_id", "line_no", "line")


@query("select page_id, url from pages where url glob '*.example.*/*page=?*'")
def glob_urls(spark, folder):
    return F_.glob_filter(read_table(spark, folder, "pages"), "url", "*.example.*/*page=?*").select("page_id", "url")


@query(
    "with l as (select conv_id, turn, string_split(rtrim(text, chr(10)), chr(10)) as l from conversations)"
    " select conv_id, turn, len(l) as line_count, case when len(l)>1 then array_to_string(l[2:4], chr(10)) end as content from l"
)
def line_pages(spark, folder):
    """Lines 2 to 4 of every conversation turn."""
    rows = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return F_.line_page(rows, 1, 3).withColumn("line_count", F.col("line_count").cast("long"))


_NEST = (
    "named_struct('name', event_type, 'Token', props, 'headers', map('Accept', event_type, 'x', props), 'env', map('MY_API_KEY', props, 'LANG', event_type),"
    " 'servers', array(named_struct('url', event_type, 'api_key', props, 'inner', named_struct('password', props, 'port', user_id, 'headers', named_struct('any', event_type))),"
    " named_struct('url', props, 'api_key', cast(null as string), 'inner', named_struct('password', 'p', 'port', user_id, 'headers', named_struct('any', 'a')))))"
)


@query(
    "select event_id, event_type as name, '********' as token, '********' as accept, '********' as env_key, event_type as env_lang, event_type as url, '********' as api_key,"
    " '********' as password, user_id as port, '********' as any_header, props as other_url, null::varchar as other_key from events"
)
def redacted_nested(spark, folder):
    """Secrets masked at every level of a nested value: by key, below headers, and below env."""
    rows = read_table(spark, folder, "events").selectExpr("event_id", f"{_NEST} AS n")
    n = rows.selectExpr("event_id", f"{nested.redacted('n', rows.schema['n'].dataType)} AS n")
    return n.selectExpr(
        "event_id", "n.name", "n.Token AS token", "n.headers['Accept'] AS accept", "n.env['MY_API_KEY'] AS env_key", "n.env['LANG'] AS env_lang",
        "n.servers[0].url AS url", "n.servers[0].api_key AS api_key", "n.servers[0].inner.password AS password", "n.servers[0].inner.port AS port",
        "n.servers[1].inner.headers.any AS any_header", "n.servers[1].url AS other_url", "n.servers[1].api_key AS other_key",
    )


@query(
    f"with l as (select doc_id, {LINES.format('text')} as ls from documents),"
    " b as (select doc_id, ls, list_transform(ls[1:5], lambda x: left(x, 40) || case when length(x) > 40 then chr(10) || '[truncated]' else '' end) as kept from l)"
    " select doc_id, array_to_string(case when len(ls) > 5 then list_append(kept, '[' || (len(ls)-5) || ' more items omitted]') else kept end, '|') as lines,"
    " case when len(ls) > 5 then 6 else len(ls) end as shown from b"
)
def bounded_nested(spark, folder):
    """Texts and lists bounded three levels down."""
    lines = "split(rtrim('\\n', text), '\\n')"
    rows = read_table(spark, folder, "documents").selectExpr("doc_id", f"named_struct('body', map('parts', named_struct('lines', {lines}))) AS n")
    cut = rows.selectExpr("doc_id", f"{nested.bounded('n', rows.schema['n'].dataType, 5, 40)} AS n")
    return cut.selectExpr("doc_id", "array_join(n.body['parts'].lines, '|') AS lines", "bigint(size(n.body['parts'].lines)) AS shown")


@query(
    "select doc_id, replace(replace(replace(text, 'ation', '********'), 'tion', '********'), 'the', '********') as text from documents"
)
def redacted_texts(spark, folder):
    return read_table(spark, folder, "documents").selectExpr("doc_id", f"{X.redact_values('text', ['the', 'tion', 'ation'])} AS text")


@query(
    "select event_id, '********' as token, json_extract_string(props, '$.k') as note from events"
)
def redacted_fields(spark, folder):
    rows = read_table(spark, folder, "events").selectExpr(
        "event_id", "map('Token', props, 'note', get_json_object(props, '$.k')) AS fields"
    )
    return rows.selectExpr("event_id", f"{X.redact_map('fields')} AS fields").selectExpr(
        "event_id", "fields['Token'] AS token", "fields['note'] AS note"
    )


_WRAPPED = "'<think>' || left(text, 40) || '</THINK>' || substr(text, 41) || '<think>tail'"


@query(
    "with w as (select conv_id, turn, text from conversations)"
    " select conv_id, turn, trim(substr(text, 41) || 'tail', chr(10)||' ') as visible, left(text, 40) || '|tail' as reasoning from w"
)
def thinking_removed(spark, folder):
    """Conversation texts with their first forty characters marked as reasoning, split again."""
    rows = read_table(spark, folder, "conversations").selectExpr("conv_id", "turn", f"{_WRAPPED.replace('substr(text, 41)', 'substring(text, 41)')} AS marked")
    return rows.selectExpr(
        "conv_id", "turn", f"{X.strip_thinking('marked')} AS visible", f"array_join({X.reasoning_parts('marked')}, '|') AS reasoning"
    )


@query(
    "with p as (select doc_id, string_split(text, ' ') as w, text from documents),"
    " b as (select doc_id, case when length(text)>400 then left(text,400)||chr(10)||'[truncated]' else text end as body, case when len(w)>50 then list_append(w[1:50], '['||(len(w)-50)||' more items omitted]') else w end as l from p)"
    " select doc_id, body, array_to_string(l, ' ') as words from b"
)
def bounded_values(spark, folder):
    rows = read_table(spark, folder, "documents").selectExpr("doc_id", "text", "split(text, ' ') AS w")
    return rows.selectExpr("doc_id", f"{X.bounded_text('text', 400)} AS body", f"array_join({X.bounded_list('w')}, ' ') AS words")


@query(
    "with a as (select doc_id, text, octet_length(encode(text)) as bytes from documents), c as (select *, list_max(list_filter(range(50, 101), lambda n: octet_length(encode(left(text, n))) <= 100)) as n from a)"
    " select doc_id, case when bytes<=100 then text else left(text, n::int) end as head from c"
)
def byte_bounded_texts(spark, folder):
    """First hundred bytes of each document without a torn character."""
    return read_table(spark, folder, "documents").selectExpr("doc_id", f"{X.truncate_utf8('text', 100)} AS head")


@query("select page_id, left(lower(regexp_replace(regexp_replace(url, '[^\\w-]+', '_', 'g'), '^_+|_+$', '', 'g')), 80) as id from pages")
def clean_ids(spark, folder):
    return read_table(spark, folder, "pages").selectExpr("page_id", f"{X.clean_id('url')} AS id")


@query("select c_custkey, 'X-'||left(sha1('{\"p0\":\"'||c_name||'\",\"p1\":'||c_nationkey||'}'),12) as id from customer")
def stable_ids(spark, folder):
    return read_table(spark, folder, "customer").selectExpr("c_custkey", f"{X.stable_id('X-', 'c_name', 'c_nationkey')} AS id")


@query(
    "with l as (select conv_id, turn, string_split(text, chr(10)) as l from conversations)"
    " select conv_id, turn, array_to_string(list_filter(l, lambda x, i: i % 2 = 1), '') as body, len(l) as blocks from l"
)
def message_texts(spark, folder):
    """Text blocks of each message joined; every second line stands for a block of another kind."""
    rows = read_table(spark, folder, "conversations").selectExpr(
        "conv_id", "turn",
        "transform(split(text, '\\n'), (l, i) -> named_struct('type', if(i % 2 = 0, 'text', 'tool_use'), 'text', l)) AS blocks",
    )
    return rows.selectExpr("conv_id", "turn", f"{X.blocks_text('blocks')} AS body", "bigint(size(blocks)) AS blocks")


# Previews -------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, row_number() over (order by o_orderkey) as n, true as truncated from orders order by o_orderkey limit 20")
def table_preview(spark, folder):
    """First twenty orders (the preview is the feature)."""
    rows = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return P.table_preview(rows, ["o_orderkey"])


@query(
    "with r as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)),1)-1 as row_idx from documents),"
    " c as (select doc_id, row_idx, list_filter(string_split(line,' ')[1:80], lambda c: c<>'') as f from r where row_idx<10),"
    " s as (select doc_id, row_idx, len(f) as n, len(list_distinct(f)) as u, len(list_filter(f, lambda c: not regexp_full_match(c,'\\d*\\.?\\d*') or not regexp_matches(c,'\\d'))) as t from c),"
    " k as (select *, row_number() over (partition by doc_id order by n desc, u desc, t desc, row_idx) as rk from s)"
    " select doc_id as table_id, row_idx+1 as header_row from k where rk=1"
)
def header_inference(spark, folder):
    """Documents read as raw sheets: which of the first ten lines looks most like a header."""
    rows = read_table(spark, folder, "documents").selectExpr(
        "doc_id AS table_id", "posexplode(split(text, '\\n')) AS (row_idx, line)"
    ).selectExpr("table_id", "row_idx", "split(line, ' ') AS cells")
    return P.header_rows(rows).selectExpr("table_id", "bigint(header_row) AS header_row")


@query(
    "select event_id, octet_length(encode(props)) > 9 as truncated, left(props, 9) as preview, octet_length(encode(props)) <= 9 as valid_json from events"
)
def text_previews(spark, folder):
    rows = read_table(spark, folder, "events").selectExpr("event_id", "props AS text")
    return P.text_preview(rows, limit=9)


_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.][^/]*([.][^./]+)$', 1))"


@query(
    f"with {Q.PAGE_FILES}, e as (select page_id, {_EXT} as extension from pf) select page_id, extension, case when extension in ('.html','.htm','.js','.css','.xml','.txt','.php') then 'text'"
    " when extension='.pdf' then 'pdf' when extension in ('.zip','.gz') then 'archive' when extension in ('.png','.jpg') then 'image' else 'unsupported' end as kind from e"
)
def preview_kinds(spark, folder):
    files = Q.page_files(spark, folder).selectExpr("page_id", f"{F_.extension('path')} AS extension")
    return files.selectExpr("page_id", "extension", f"{P.preview_kind('extension')} AS kind")


# Retrieval ------------------------------------------------------------------------------------------


_UNIT = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]
_UNIT_SQL = "[" + ",".join(str(x) for x in _UNIT) + "]::double[]"


@query(
    f"select vec_id as chunk_id, label, round(list_cosine_similarity(embedding::double[], {_UNIT_SQL}), 6) as similarity from embeddings"
    " order by similarity desc, chunk_id limit 10"
)
def vector_top_k(spark, folder):
    """Ten chunks most similar to one query vector."""
    chunks = read_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return R.vector_top_k(chunks, _UNIT, 10).select("chunk_id", "label", "similarity")


@query(
    "with q as (select e.vec_id as query_id, embedding::double[] as qe from embeddings e join supplier on vec_id=s_suppkey),"
    " s as (select query_id, vec_id as chunk_id, round(list_cosine_similarity(embedding::double[], qe), 6) as similarity from embeddings, q where vec_id<>query_id),"
    " r as (select *, row_number() over (partition by query_id order by similarity desc, chunk_id) as rank from s)"
    " select query_id, rank, similarity from r where rank<=5"
)
def vector_top_k_many(spark, folder):
    """Five nearest chunks of each query; the vectors numbered like a supplier are the queries."""
    return R.vector_top_k_many(*chunks_and_queries(spark, folder), 5).select("query_id", "rank", "similarity")


def chunks_and_queries(spark, folder) -> tuple[DataFrame, DataFrame]:
    chunks = read_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    suppliers = read_table(spark, folder, "supplier").selectExpr("s_suppkey AS chunk_id")
    return chunks, chunks.join(suppliers, "chunk_id", "left_semi").selectExpr("chunk_id AS query_id", "embedding")


@query(
    "with q as (select count(*) as n from embeddings join supplier on vec_id=s_suppkey)"
    " select n * least(5, (select count(*) - 1 from embeddings)) as wanted, true as recalled from q"
)
def vector_probe_recall(spark, folder):
    """Whether the search by hyperplane lists finds nine in ten of the exact five neighbours of all queries."""
    chunks, queries = chunks_and_queries(spark, folder)
    exact = cut_lineage(R.vector_top_k_many(chunks, queries, 5))
    return R.vector_recall(exact, R.vector_top_k_probed(chunks, queries, 5)).selectExpr("wanted", "recall >= 0.9 AS recalled")


@query()
def vector_top_k_probed(spark, folder):
    """Five near chunks of each query from the lists nearest to it, by exact similarity."""
    return R.vector_top_k_probed(*chunks_and_queries(spark, folder), 5).select("query_id", "chunk_id", "rank", "similarity")


@query(
    f"with h as (select vec_id, label, row_number() over (order by round(list_cosine_similarity(embedding::double[], {_UNIT_SQL}), 6) desc, vec_id) as rank from embeddings)"
    " select string_agg('[来源 '||rank||']'||chr(10)||'标题：'||coalesce(nullif(source,''),'未知')||chr(10)||'相关性：'||label||chr(10)||'document_id：'||coalesce(doc_id::varchar,'null')||chr(10)||'chunk_id：'||vec_id||chr(10)||'正文：'||chr(10)||coalesce(text,''), chr(10)||chr(10)||'---'||chr(10)||chr(10) order by rank) as context"
    " from h left join documents on doc_id=vec_id where rank<=5"
)
def search_context(spark, folder):
    """Text for a reader from the five best chunks."""
    t = read_tables(spark, folder, ("embeddings", "documents"))
    hits = R.vector_top_k(t["embeddings"].withColumnRenamed("vec_id", "chunk_id"), _UNIT, 5).selectExpr(
        "chunk_id", "label", "row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank"
    )
    docs = t["documents"].selectExpr("doc_id AS chunk_id", "doc_id AS document_id", "source AS title", "text")
    return R.assemble_context(hits.join(docs, "chunk_id", "left").withColumn("similarity", F.col("label")))


@query(
    "with s as (select p_partkey, p_name, p_type, case when contains(lower(p_name),'red') then 30 when contains(lower(p_type),'red') then 10 else 0 end"
    " + case when contains(lower(p_name),'economy') then 30 when contains(lower(p_type),'economy') then 10 else 0 end as gain from part),"
    " h as (select *, gain + case when lower(p_name)='red economy' then 1000 else 0 end as score from s where gain>0)"
    " select p_partkey, score, (select count(*) from h) as total, case when 25 < (select count(*) from h) then 25 end as next_offset from h order by score desc, p_partkey limit 20 offset 5"
)
def term_search(spark, folder):
    entries = read_table(spark, folder, "part").selectExpr("p_partkey", "p_name AS name", "p_type AS description")
    hits = R.term_search(entries, "red Economy", offset=5, limit=20, ordinal="p_partkey")
    return hits.select("p_partkey", "score", "total", "next_offset")


@query(
    f"with {Q.PAGE_FILES}, n as (select page_id, regexp_extract(path,'([^/]*)$',1) as name, path from pf),"
    " t as (select *, case when lower(name)='25' then 0 when starts_with(lower(name),'25') then 1 when starts_with(lower(path),'25') then 2 when contains(lower(name),'25') then 3 when contains(lower(path),'25') then 4 else -1 end as tier from n)"
    " select page_id, path, tier from t where tier>=0"
)
def mention_search(spark, folder):
    files = Q.page_files(spark, folder).selectExpr("page_id", f"{F_.file_name('path')} AS name", "path")
    return R.mention_search(files, "25").select("page_id", "path", "tier")
