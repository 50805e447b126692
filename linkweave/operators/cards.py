"""Evidence cards: what tables, links, sentences and goals say, ranked and bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.config import Limits
from linkweave.functions import statements as S
from linkweave.functions.headers import ROLE_MARKERS, business_role, material_role
from linkweave.functions.text import casefold, cut, flat_text, normalize_name, plain_name, quote, quoted, stable_id, when
from linkweave.functions.values import heading_like
from linkweave.operators.links import lower_fold, name_anchors, text_pieces
from linkweave.operators.occurrences import with_row_number
from linkweave.session import cut_lineage, spread

CARD = ("id", "kind", "strength", "statement", "file", "locator", "facts", "snippet", "files")
STATEMENT_KINDS = (
    "goal_relation_statement", "document_relation_statement", "table_relation_statement", "material_topic_alignment",
)
STRENGTH_ORDER = ("direct", "structural", "corroborating", "contextual")


def make_cards(
    df: DataFrame, kind: str, strength: str, statement: str, file: str, locator: str, facts: str, snippet: str = "''",
    files: str = "", limits: Limits = Limits(),
) -> DataFrame:
    """Cards with an id that depends on nothing but their content. Arguments are expression text.

    `files` names all files a card speaks of, where they are more than `file`.
    """
    shaped = df.selectExpr(
        f"{kind} AS kind", f"{strength} AS strength",
        f"{cut(flat_text(statement), limits.statement_chars)} AS statement",
        f"{file} AS file", f"{locator} AS locator", f"{facts} AS facts",
        f"{cut(flat_text(snippet), limits.snippet_chars)} AS snippet", f"{files or f'array({file})'} AS files",
    )
    return shaped.selectExpr(
        stable_id("E-", "kind", "file", "locator", "facts", "statement", "snippet") + " AS id", *CARD[1:]
    )


# Statements of text -------------------------------------------------------------------------------


def scored_statements(segments: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(file, locator, text) -> one row per statement with its folded form and marker score."""
    # folded where it is split: a filter on the score would else fold the statement again for every marker
    each = f"transform({S.split_statements('text')}, s -> named_struct('statement', s, 'folded', {casefold('s')}))"
    return segments.selectExpr("file", "locator", *extra, f"inline({each})").selectExpr("*", f"{S.marker_score('folded')} AS score")


def best_statements(scored: DataFrame, keep: int = 40, extra: tuple[str, ...] = ()) -> DataFrame:
    """Best statements per file: score first, then locator and text; equal texts of a file count once.

    Both ranks are limits Spark applies inside each task, so a line repeated over a third of the input
    or a file with a third of all statements sends only its best rows on.
    """
    order = "score DESC, locator, statement"
    named = scored.where("score > 0").selectExpr("*", f"{plain_name('folded')} AS name").where("name <> ''")
    once = named.selectExpr("*", f"row_number() OVER (PARTITION BY file, name ORDER BY {order}) AS copy")
    ranked = once.where("copy = 1").selectExpr("*", f"row_number() OVER (PARTITION BY file ORDER BY {order}) AS rank")
    return ranked.where(f"rank <= {keep}").selectExpr(
        "file", "rank", "locator", "statement", "score", f"{S.relation_markers('folded')} AS markers", *extra
    )


def mention_scores(scored: DataFrame, names: DataFrame) -> DataFrame:
    """Adds to the score what other files' names give: 6 for the name itself, else 2 < overlap <= 6.

    names: (path, file_name, stem). Overlap needs three shared tokens, so a name with n tokens is found
    through its n-2 rarest ones; common tokens never drive the join. Statements are short, so they travel with their
    pieces: one pass finds all mentions, and only those are shuffled.
    """
    keyed = scored.selectExpr("*", "xxhash64(file, locator, statement) AS sid")
    anchors = name_anchors(names)
    name_tokens = names.where("char_length(file_name) >= 4").selectExpr(
        "path AS target", f"{S.relation_tokens('stem')} AS all_tokens"
    ).where("size(all_tokens) >= 3")
    spread = name_tokens.selectExpr("target", "all_tokens", "explode(all_tokens) AS token")
    counts = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = spread.join(counts, "token").selectExpr(
        "*", "row_number() OVER (PARTITION BY target ORDER BY n, token) AS r"
    ).where("r <= size(all_tokens) - 2").selectExpr("target", "'' AS folded_name", f"{TOKEN_MODE} AS mode", "token AS piece", "all_tokens")
    # written, so that Spark knows its size
    known = cut_lineage(anchors.selectExpr("*", "cast(NULL AS array<string>) AS all_tokens").unionByName(rare).distinct(), "names")
    pieces = text_pieces(known, "low") | {TOKEN_MODE: "tokens"}
    modes = [r["mode"] for r in known.select("mode").distinct().collect()]
    tagged = [f"transform({pieces[m]}, x -> named_struct('mode', {m}, 'piece', x))" for m in sorted(modes)]
    texts = keyed.selectExpr("file", "sid", f"{S.relation_tokens('statement')} AS tokens", f"{lower_fold('statement')} AS low")
    met = texts.selectExpr("*", f"inline(concat({', '.join(tagged)}))") if tagged else texts.selectExpr("*", "0 AS mode", "'' AS piece").limit(0)
    overlap = "least(6, size(array_intersect(tokens, all_tokens)))"
    gains = (
        met.join(known, ["mode", "piece"]).where("file <> target")
        .selectExpr("file", "sid", "target", f"if(mode = {TOKEN_MODE}, {overlap}, if(contains(low, folded_name), 6, 0)) AS gain").where("gain >= 3")
        .groupBy("file", "sid", "target").agg(F.max("gain").alias("gain"))
        .groupBy("file", "sid").agg(F.sum("gain").alias("gain"), F.expr("array_sort(collect_set(target)) AS mentioned"))
    )
    return keyed.join(cut_lineage(gains, "gains"), ["file", "sid"], "left").selectExpr(
        "* EXCEPT (sid, gain, mentioned, score)", "score + coalesce(gain, 0) AS score",
        "coalesce(mentioned, cast(array() as array<string>)) AS mentioned",
    )


TOKEN_MODE = 3
"""Names found through a token; the other modes are those of name_anchors."""


def table_segments(tables: dict[str, DataFrame], files: dict[str, str]) -> DataFrame:
    """(file, column, locator, text): the text cells of tables that may hold a statement. files: {table: its file}."""
    parts = []
    for table, df in sorted(tables.items()):
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not texts:
            continue
        tall = with_row_number(df).select("row_no", *texts).unpivot(["row_no"], texts, "column", "text").where("char_length(trim(text)) >= 6")
        parts.append(spread(tall).selectExpr(
            f"{quote(files[table])} AS file", "column", f"concat({quote(f'table:{table};row:')}, row_no, ';column:', column) AS locator", "text"
        ))
    return union_cards(*parts)


# What statement cards say.
STATEMENT_TEXT = "%s contains a localized relationship-bearing statement."
TABLE_STATEMENT_TEXT = "%s contains a localized relationship-bearing table statement."
TOPIC_TEXT = "%s contains a localized topic that aligns with another material."
OUTLINE_TEXT = "%s exposes a bounded structural outline for interpreting its business role."
GOAL_TEXT = (
    "The user-provided scenario description supplies purpose and vocabulary but cannot prove a data "
    "relationship by itself."
)
GOAL_STATEMENT_TEXT = (
    "The user-provided scenario description explicitly states a business relationship or condition."
)
FILE_TEXT = "%s is a %s source with %d table(s)."
SCHEMA_TEXT = (
    "%s / %s structurally resembles %s; column roles are grouped without reading data rows."
)
SIGNAL_TEXT = (
    "%s / %s co-locates business roles %s; this supports a material-level relationship but does not by "
    "itself determine chronology."
)
FIELD_TEXT = (
    "%s and %s have %d semantically aligned field correspondence(s) with exact bounded fingerprint "
    "evidence. This proves cross-material traceability, not business order or causation."
)


def statement_cards(best: DataFrame, from_table: bool = False) -> DataFrame:
    """Cards of ranked statements; those without a marker align topics."""
    kind = "table_relation_statement" if from_table else "document_relation_statement"
    text = TABLE_STATEMENT_TEXT if from_table else STATEMENT_TEXT
    mentioned = "mentioned" if "mentioned" in best.columns else "cast(array() as array<string>)"
    column = "'column', column, " if from_table else ""
    return make_cards(
        best,
        f"if(size(markers) > 0, '{kind}', 'material_topic_alignment')",
        "if(size(markers) > 0 AND score >= 5, 'direct', 'structural')",
        f"format_string(if(size(markers) > 0, {quote(text)}, {quote(TOPIC_TEXT)}), file)",
        "file", "locator",
        f"to_json(named_struct({column}'relation_markers', markers, 'mentioned_files', {mentioned}))",
        "statement",
    )


def outline_rows(scored: DataFrame, keep: int = 16, seen: int = 24) -> DataFrame:
    """Headings per file in reading order (`ord`), among statements without a score."""
    heads = scored.where(f"score = 0 AND {heading_like('statement')}")
    ranked = heads.selectExpr("*", "row_number() OVER (PARTITION BY file ORDER BY ord, statement) AS n").where(f"n <= {seen}")
    return ranked.groupBy("file").agg(
        F.expr(f"transform(array_sort(collect_list(if(n <= {keep}, struct(n, statement), NULL))), h -> h.statement) AS headings"),
        F.expr("min_by(locator, n) AS locator"),
        F.expr(f"greatest(count(1) - {keep}, 0) AS omitted"),
    )


def outline_cards(outlines: DataFrame) -> DataFrame:
    return make_cards(
        outlines, "'document_outline'", "'contextual'", f"format_string({quote(OUTLINE_TEXT)}, file)", "file", "locator",
        "to_json(named_struct('headings', headings, 'omitted_heading_count', omitted))",
    )


def goal_statements(lines: DataFrame, keep: int = 20) -> DataFrame:
    """(file, line_no, line) of goal texts -> their first relationship statements, equal texts once."""
    parts = lines.selectExpr("file", "line_no", f"posexplode({S.split_statements('line', commas=True)}) AS (p, statement)")
    scored = parts.selectExpr("*", f"{casefold('statement')} AS folded").selectExpr("*", f"{plain_name('folded')} AS name")
    kept = scored.selectExpr("*", f"{S.marker_score('folded')} AS score").where("score > 0")
    once = kept.selectExpr("*", "row_number() OVER (PARTITION BY file, name ORDER BY line_no, p) AS copy").where("copy = 1")
    ranked = once.selectExpr("*", "row_number() OVER (PARTITION BY file ORDER BY line_no, p) AS rank")
    return ranked.where(f"rank <= {keep}").selectExpr(
        "file", "rank", "line_no", "statement", "score", f"{S.relation_markers('folded')} AS markers"
    )


def goal_cards(lines: DataFrame) -> DataFrame:
    """Goal text card and one card per goal statement. Lines are those of the scenario section."""
    whole = lines.groupBy("file").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(line_no, line))), l -> l.line), '\\n') AS body")
    ).where("trim(body) <> ''")
    about = make_cards(
        whole, "'scenario_goal'", "'contextual'", quote(GOAL_TEXT), "file", "'description'",
        f"to_json(named_struct('description', {cut(flat_text('body'), 1200)}))",
    )
    said = make_cards(
        goal_statements(lines), "'goal_relation_statement'", "'direct'", quote(GOAL_STATEMENT_TEXT), "file",
        "concat('line:', line_no)", "to_json(named_struct('relation_markers', markers))", "statement",
    )
    return about.unionByName(said)


# Tables -------------------------------------------------------------------------------------------

ROLES = tuple(ROLE_MARKERS)


def column_roles(catalog: DataFrame) -> DataFrame:
    """Business role of every column of a catalog (table, position, name, key)."""
    plain = catalog.selectExpr("*", f"{normalize_name('name')} AS whole_key")
    return plain.selectExpr("* EXCEPT (whole_key)", f"{business_role('whole_key')} AS role")


def table_roles(roles: DataFrame) -> DataFrame:
    """One row per table: columns of each role and what the table resembles."""
    counts = [F.expr(f"count_if(role = '{r}') AS n_{r}") for r in ROLES]
    grouped = roles.groupBy("table").agg(F.count(F.lit(1)).alias("columns"), *counts)
    named = grouped.selectExpr("*", f"{normalize_name('table')} AS table_key")
    return named.selectExpr("* EXCEPT (table_key)", f"{material_role('table_key')} AS material_role")


def bounded_columns(roles: DataFrame, per_role: int = 8, total: int = 40) -> DataFrame:
    """At most eight columns per role and forty in all, roles in order of name."""
    first = roles.selectExpr("*", "row_number() OVER (PARTITION BY table, role ORDER BY position) AS in_role")
    kept = first.where(f"in_role <= {per_role}").selectExpr(
        "*", "row_number() OVER (PARTITION BY table ORDER BY role, position) AS n"
    )
    return kept.where(f"n <= {total}").select("table", "role", "n", "name")


def schema_cards(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """File, schema and process-signal cards. files: (table, file, extension, size, kind, row_count)."""
    roles = column_roles(catalog)
    described = table_roles(roles).join(files, "table")
    kept = bounded_columns(roles).groupBy("table").agg(
        F.expr("array_sort(collect_list(struct(role, n, name))) AS columns_by_role"), F.count(F.lit(1)).alias("shown")
    )
    schema = make_cards(
        described.join(kept, "table"), "'table_schema'", "'structural'",
        f"format_string({quote(SCHEMA_TEXT)}, file, table, material_role)", "file", "concat('table:', table, ';header')",
        "to_json(named_struct('table', table, 'estimated_rows', row_count, 'column_count', columns,"
        " 'inferred_material_role', material_role, 'columns_by_role', columns_by_role,"
        " 'omitted_column_count', columns - shown))",
    )
    active = roles.groupBy("table").agg(F.expr("array_sort(collect_set(role)) AS roles")).where("size(roles) >= 2")
    signal = make_cards(
        described.join(active, "table"), "'table_process_signal'", "'structural'",
        f"format_string({quote(SIGNAL_TEXT)}, file, table, array_join(roles, ', '))", "file",
        "concat('table:', table, ';header')",
        "to_json(named_struct('table', table, 'co_located_roles', roles, 'inferred_material_role', material_role))",
    )
    per_file = files.groupBy("file", "kind", "extension", "size").agg(F.count(F.lit(1)).alias("tables"))
    structure = make_cards(
        per_file, "'file_structure'", "'contextual'", f"format_string({quote(FILE_TEXT)}, file, kind, tables)", "file",
        "'file'", "to_json(named_struct('extension', extension, 'size_bytes', size, 'table_count', tables))",
    )
    return structure.unionByName(schema).unionByName(signal)


def field_cards(correspondences: DataFrame) -> DataFrame:
    """One card per pair of files with aligned columns (twenty at most are listed)."""
    grouped = correspondences.groupBy(
        "source", "target", "correspondences", "files_confidence", "files_evidence"
    ).agg(F.expr(
        "array_sort(collect_list(struct(rank, source_column, target_column, alignment, confidence, evidence_count))) AS items"
    ))
    return make_cards(
        grouped, "'field_relationship'", "'direct'",
        f"format_string({quote(FIELD_TEXT)}, source, target, correspondences)", "source", "concat('file:', target)",
        "to_json(named_struct('source_file', source, 'target_file', target, 'correspondences', items,"
        " 'omitted_correspondence_count', correspondences - size(items), 'confidence', files_confidence,"
        " 'evidence_count', files_evidence))",
        files="array(source, target)",
    )


# Selection ----------------------------------------------------------------------------------------


def union_cards(*streams: DataFrame) -> DataFrame:
    result = streams[0]
    for stream in streams[1:]:
        result = result.unionByName(stream, allowMissingColumns=True)
    return result


def strength_rank(x: str = "strength") -> str:
    return when(*[(f"{x} = '{s}'", str(i)) for i, s in enumerate(STRENGTH_ORDER)], otherwise="9")


def bound_cards(cards: DataFrame, max_cards: int = 1_000, required: str = "file_structure") -> DataFrame:
    """Unique cards; all of the required kind, and the best of the rest up to the cap.

    The rest is a top-n over the whole set, which Spark takes per task first.
    """
    unique = cards.dropDuplicates(["id"]).selectExpr("*", f"{strength_rank()} AS priority")
    must = unique.where(f"kind = '{required}'")
    room = must.agg(F.expr(f"greatest({max_cards} - count(1), 0) AS room"))
    rest = unique.where(f"kind <> '{required}'").orderBy("priority", "kind", "id").limit(max_cards)
    ranked = rest.selectExpr("*", "row_number() OVER (ORDER BY priority, kind, id) AS n")
    kept = ranked.where(F.col("n") <= room.scalar()).drop("n")
    return must.unionByName(kept)


def first_per_file(cards: DataFrame, kind: str, limit: int) -> DataFrame:
    """The card with the smallest id of each file, first files first."""
    first = cards.where(f"kind = '{kind}'").selectExpr("*", "row_number() OVER (PARTITION BY file ORDER BY id) AS n")
    return first.where("n = 1").drop("n").orderBy("file", "id").limit(limit)


def kind_histogram(cards: DataFrame) -> DataFrame:
    return cards.groupBy("kind").agg(F.count(F.lit(1)).alias("cards"))


def statement_ranks(cards: DataFrame, context: DataFrame) -> DataFrame:
    """Statement cards with their rank score: 4 per token shared with the context, plus strength and kind.

    context: rows (token), the tokens of the goals and of the file names.
    """
    rows = cards.where(f"kind IN ({quoted(STATEMENT_KINDS)})").selectExpr(
        "*", f"{S.relation_tokens('concat(snippet, ' + quote(' ') + ', statement)')} AS card_tokens"
    )
    rows = rows.withColumn("row_key", F.xxhash64("id", "file", "locator", "snippet", "statement"))
    words = rows.selectExpr("row_key", "explode(card_tokens) AS token").distinct()
    shared = words.join(context.select("token").distinct(), "token").groupBy("row_key").agg(F.count(F.lit(1)).alias("shared"))
    return rows.join(shared, "row_key", "left").selectExpr(
        "* EXCEPT (card_tokens, row_key, shared)",
        "4 * coalesce(shared, 0) + if(strength = 'direct', 3, 1) + if(kind = 'document_relation_statement', 2, 0) AS score",
    )


def synthesis_brief(cards: DataFrame, context: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The forty cards worth reading first, in order: goal, files, schemas, fields, signals, statements."""
    def part(df: DataFrame, stage: int, order: str) -> DataFrame:
        # every part is limited already; ranking it is a matter of a few dozen rows
        return df.selectExpr("*", f"{stage} AS stage", f"row_number() OVER (ORDER BY {order}) AS place").select(
            *CARD, "stage", "place"
        )

    by_file = "file, id"
    parts = [
        part(cards.where("kind = 'scenario_goal'").orderBy("file", "id").limit(1), 0, by_file),
        part(first_per_file(cards, "file_structure", limits.brief_cards), 1, by_file),
        part(first_per_file(cards, "table_schema", 16), 2, by_file),
        part(cards.where("kind = 'field_relationship'").orderBy("file", "id").limit(6), 3, by_file),
        part(first_per_file(cards, "table_process_signal", 6), 4, by_file),
        part(
            statement_ranks(cards, context).orderBy(F.desc("score"), "id").limit(limits.brief_statements), 5,
            "score DESC, id",
        ),
    ]
    chosen = union_cards(*parts).selectExpr("*", "row_number() OVER (PARTITION BY id ORDER BY stage, place) AS copy")
    ordered = chosen.where("copy = 1").selectExpr("*", "row_number() OVER (ORDER BY stage, place) AS n")
    return ordered.where(f"n <= {limits.brief_cards}").selectExpr("n", *CARD)


def compact_cards(cards: DataFrame) -> DataFrame:
    """Short view of cards for a reader with little room."""
    return cards.selectExpr(
        "id", "kind", "strength", f"{cut(flat_text('statement'), 280)} AS statement", "file", "locator",
        f"{cut(flat_text('snippet'), 240)} AS snippet",
    )


def evidence_page(
    cards: DataFrame, offset: int, limit: int, kinds=(), file: str = "", ids=(), order: tuple[str, ...] = ("id",),
) -> DataFrame:
    """One page of cards with `total` and `has_more`. Spark keeps offset+limit rows per task."""
    rows = cards
    if kinds:
        rows = rows.where(f"kind IN ({quoted(kinds)})")
    if file:
        rows = rows.where(f"array_contains(files, {quote(file)})" if "files" in rows.columns else f"file = {quote(file)}")
    if ids:
        rows = rows.where(f"id IN ({quoted(ids)})")
    offset, limit = max(0, offset), max(1, min(limit, 20))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.withColumn("total", total.scalar()).selectExpr("*", f"total > {offset + limit} AS has_more")
