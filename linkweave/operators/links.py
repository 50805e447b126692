"""Links between columns: value matches, their scores, and the relations they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.config import Limits
from linkweave.functions.headers import compatibility, compatibility_groups
from linkweave.functions.text import fingerprint, quote, safe_preview, when
from linkweave.functions.values import specificity
from linkweave.operators.occurrences import cell_locator, distinct_values, known_columns
from linkweave.operators.sketches import bottom_k
from linkweave.session import cut_lineage

# Explanations that links carry.
SEED_NOTE = "Exact normalized values match across compatible columns (column compatibility %.2f)."
PROBE_NOTE = "A bounded seed exactly matches this candidate column (column compatibility %.2f)."
PROFILE_NOTE = "Bounded column profiles contain %d exact shared fingerprint(s) (column compatibility %.2f)."

SIDE = ("file", "table", "column", "key", "kind", "base", "locator", "preview", "specificity")


def side(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
    """The columns that describe one end of a link, prefixed."""
    source = df if "file" in df.columns else df.withColumn("file", F.col("table"))
    return source.selectExpr("fingerprint", *[f"{c} AS {prefix}_{c}" for c in SIDE], *extra)


def verdict(confirmed: str) -> str:
    return f"if({confirmed}, 'confirmed', 'supported_hypothesis')"


SEED_CONFIDENCE = "round(least(0.99D, 0.82D + 0.12D * compat + 0.015D * spec), 3)"
SEED_VERDICT = verdict("(compat >= 0.95D AND spec >= 2) OR (compat >= 0.82D AND spec >= 3)")
PROFILE_CONFIDENCE = "round(least(0.97D, 0.78D + 0.12D * compat + 0.02D * least(shared, 4)), 3)"
PROFILE_VERDICT = verdict(
    "(compat >= 0.95D AND shared >= 2 AND spec >= 2) OR (compat >= 0.82D AND shared >= 3 AND spec >= 3)"
)


def column_overlap(profiles: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Pairs (s_, t_) of sample rows of different files that share a fingerprint, with compat and spec.

    The samples hold one row per (column, value), at most k per column, so a value that fills a third of
    a table is a single row here. Rows meet by fingerprint and by a label of compatibility, so a value that stands in thousands
    of columns makes a row only for those pairs of columns that agree. Two columns may share several labels; each label has a
    score of its own, and the pair is taken under the one that is its compatibility.
    """
    labelled = profiles.selectExpr("*", f"inline({compatibility_groups()})").where(f"score >= {threshold}")
    pairs = side(labelled, "s", "label", "score").join(side(labelled, "t", "label"), ["fingerprint", "label"]).where("s_file < t_file")
    scored = pairs.selectExpr("* EXCEPT (label)", f"{compatibility('s', 't')} AS compat").where("compat = score")
    return scored.selectExpr("* EXCEPT (score)", "least(s_specificity, t_specificity) AS spec")


def profile_links(profiles: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Links between columns whose samples overlap; the first shared fingerprints become evidence."""
    pair = "PARTITION BY s_file, s_table, s_column, t_file, t_table, t_column"
    counted = column_overlap(profiles).selectExpr(
        "*", f"count(1) OVER ({pair}) AS shared", f"bigint(row_number() OVER ({pair} ORDER BY fingerprint)) AS seq"
    )
    return counted.where(f"seq <= {limits.evidence_per_relation}").selectExpr(
        "*",
        f"{PROFILE_CONFIDENCE} AS confidence",
        f"{PROFILE_VERDICT} AS verdict",
        "'profiled_value_overlap' AS type",
        "'bottom_k_exact_overlap' AS evidence_kind",
        f"format_string({quote(PROFILE_NOTE)}, shared, compat) AS note",
    )


def compatible_groups(catalog: DataFrame) -> DataFrame:
    """Column compatibility as labels: (label, score, table, name); no pair is spelled out.

    Two columns of different tables agree by the best score among the labels they share.
    """
    return catalog.selectExpr("table", "name", f"inline({compatibility_groups()})").select(
        "label", "score", "table", "name"
    )


def reachable_columns(catalog: DataFrame, open_tables: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Columns (table, name) that still agree with a column of another, unscanned table.

    For each label only the smallest and largest open table are kept: another one exists unless both
    are the column's own table. Linear in the number of columns.
    """
    labels = compatible_groups(catalog).where(f"score >= {threshold}")
    targets = (
        labels.join(open_tables.select("table"), "table", "left_semi")
        .groupBy("label").agg(F.min("table").alias("low"), F.max("table").alias("high"))
    )
    return labels.join(targets, "label").where("low <> table OR high <> table").select("table", "name").distinct()


def seed_index(sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Bounded index of seed values. `sources` carries `ord`, the order in which they were met.

    The first `max_seed_values` fingerprints are kept and up to four sources of each.
    """
    unique = sources.dropDuplicates(["fingerprint", "file", "table", "column", "locator"])
    first = unique.groupBy("fingerprint").agg(F.min("ord").alias("first_ord"))
    # top-n by order: the limit is taken per task before the single merge
    admitted = first.orderBy("first_ord", "fingerprint").limit(limits.max_seed_values)
    ranked = unique.join(admitted, "fingerprint").selectExpr(
        "* EXCEPT (first_ord)", "row_number() OVER (PARTITION BY fingerprint ORDER BY ord, locator) AS rank"
    )
    return ranked.where(f"rank <= {limits.sources_per_seed_value}").drop("rank")


BROADCAST_SEED_ROWS = 200_000


def broadcast_seeds(seeds: DataFrame, limits: Limits) -> DataFrame:
    """Broadcast hint only where the index bound proves it small; else Spark picks the join."""
    if limits.max_seed_values * limits.sources_per_seed_value <= BROADCAST_SEED_ROWS:
        return F.broadcast(seeds)
    return seeds


def _seeded(matched: DataFrame, note: str) -> DataFrame:
    scored = matched.selectExpr(
        "*", f"{compatibility('s', 't')} AS agreement", "least(s_specificity, t_specificity) AS spec"
    ).where("agreement >= 0.70D OR spec >= 3")
    return scored.selectExpr("* EXCEPT (agreement)", "greatest(agreement, 0.78D) AS compat").selectExpr(
        "*",
        f"{SEED_CONFIDENCE} AS confidence",
        f"{SEED_VERDICT} AS verdict",
        "'seeded_value_link' AS type",
        "'exact_value_match' AS evidence_kind",
        f"format_string({quote(note)}, compat) AS note",
    )


def seed_seed_links(index: DataFrame, candidates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Links of each candidate with the indexed seeds met before it: four per value at most."""
    earlier = broadcast_seeds(side(index, "s", "ord AS s_ord"), limits)
    matched = side(candidates, "t", "ord AS seq").join(earlier, "fingerprint")
    return _seeded(matched.where("s_ord < seq AND s_file <> t_file"), SEED_NOTE)


def probe_seeds(cells: DataFrame, catalog: DataFrame, seeds: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Matches of scanned cells with seed values of other files, in scan order and under the match cap.

    Cells meet the seeds through a 64-bit hash; SHA-256 runs only for cells that hit, as the final check.
    A (table, value) stops counting after `max_matches_per_seed`: only its first cells can count, so a
    rank limit that Spark applies before the shuffle removes the rest of a hot value.
    """
    scanned = cells.join(known_columns(catalog), ["table", "column"]).selectExpr(
        "*", "table AS file", "xxhash64(value) AS probe_key"
    )
    index = broadcast_seeds(side(seeds, "s", "probe_key", "ord"), limits)
    hits = scanned.join(index, "probe_key").where(f"s_file <> file AND {fingerprint('value')} = fingerprint")
    described = hits.selectExpr(
        "* EXCEPT (value, probe_key)",
        f"{cell_locator()} AS locator",
        f"{safe_preview('kind', 'value')} AS preview",
        f"{specificity('value', 'kind')} AS specificity",
    )
    renamed = described.withColumnsRenamed({c: f"t_{c}" for c in SIDE})
    return cap_matches(_seeded(renamed, PROBE_NOTE).selectExpr("*", "row_no AS seq"), limits)


def cap_matches(matches: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Matches counted before a (table, value) reached its cap; the test comes before each cell."""
    value_order = "PARTITION BY t_table, fingerprint ORDER BY row_no, position"
    cap = limits.max_matches_per_seed
    first_cells = matches.selectExpr("*", f"dense_rank() OVER ({value_order}) AS cell_rank").where(f"cell_rank <= {cap}")
    counted = first_cells.selectExpr(
        "*",
        f"count(1) OVER ({value_order}) AS upto",  # a default frame takes in the whole cell
        "count(1) OVER (PARTITION BY t_table, fingerprint, row_no, position) AS own",
    )
    return counted.where(f"upto - own < {cap}").drop("cell_rank", "upto", "own")


def frontier(cells: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """Bottom-k of all values that stand in a row that matched."""
    rows = matches.select(F.col("t_table").alias("table"), "row_no").distinct()
    return bottom_k(distinct_values(cells.join(rows, ["table", "row_no"], "left_semi")), k)


def expandable_columns(
    catalog: DataFrame, open_tables: DataFrame, stats: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """Columns whose frontier may become seeds: they reach an open table and are not near-constant."""
    reach = reachable_columns(catalog, open_tables).withColumnRenamed("name", "column")
    return stats.join(F.broadcast(reach), ["table", "column"], "left_semi").where(
        f"ratio >= {limits.min_expansion_distinct_ratio}"
    )


def relation_id(source: str, target: str, kind: str, s_column: str, t_column: str) -> str:
    return f"concat('R-', left(sha1(concat_ws('\\0', {source}, {target}, {kind}, {s_column}, {t_column})), 12))"


def canonical(links: DataFrame) -> DataFrame:
    """The file that sorts first becomes the source; links within a file are dropped."""
    ends = []
    for name in ("file", "column", "locator", "preview", "specificity"):
        ends.append(f"if(s_file > t_file, t_{name}, s_{name}) AS source_{name}")
        ends.append(f"if(s_file > t_file, s_{name}, t_{name}) AS target_{name}")
    rest = ("fingerprint", "type", "confidence", "verdict", "evidence_kind", "note", "seq")
    rows = links.where("s_file <> t_file").selectExpr(*ends, *rest)
    return rows.selectExpr(
        "source_file", "target_file", "source_column", "target_column", "source_locator", "target_locator", *rest,
        relation_id("source_file", "target_file", "type", "source_column", "target_column") + " AS relation_id",
        "if(source_specificity >= target_specificity, source_preview, target_preview) AS value_preview",
        "if(least(source_specificity, target_specificity) >= 2, 'strong', 'corroborating') AS strength",
    )


def evidence_rows(links: DataFrame) -> DataFrame:
    """Canonical links with repeats of the same evidence removed (the first one met stays)."""
    same = "PARTITION BY relation_id, fingerprint, source_locator, target_locator ORDER BY seq, note"
    numbered = canonical(links).selectExpr("*", f"row_number() OVER ({same}) AS n")
    return numbered.where("n = 1").drop("n")


def relations(evidence: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per relation with counts and its best score; partial sums run before the shuffle."""
    grouped = evidence.groupBy(
        F.col("relation_id").alias("id"), F.col("source_file").alias("source"), F.col("target_file").alias("target"),
        "type", "source_column", "target_column",
    ).agg(
        F.max("confidence").alias("confidence"),
        F.expr("bool_or(verdict = 'confirmed') AS confirmed"),
        F.count(F.lit(1)).alias("evidence_count"),
        F.expr("min_by(note, struct(seq, fingerprint, source_locator, target_locator)) AS explanation"),
    )
    return grouped.selectExpr(
        "id", "source", "target", "type", "'undirected' AS direction", f"{verdict('confirmed')} AS verdict",
        "confidence", "source_column", "target_column", "explanation", "evidence_count",
        f"greatest(evidence_count - {limits.evidence_per_relation}, 0) AS omitted_evidence_count",
    )


def kept_evidence(evidence: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The first pieces of evidence of each relation, as rows."""
    order = "PARTITION BY relation_id ORDER BY seq, fingerprint, source_locator, target_locator"
    ranked = evidence.selectExpr("*", f"row_number() OVER ({order}) AS rank")
    return ranked.where(f"rank <= {limits.evidence_per_relation}").selectExpr(
        "relation_id", "rank", "evidence_kind AS kind", "source_locator", "target_locator",
        "source_column", "target_column", "value_preview", "fingerprint", "strength", "note",
    )


def field_correspondences(relation_rows: DataFrame, catalog: DataFrame, keep: int = 20) -> DataFrame:
    """Confirmed relations whose columns mean the same, best first, per pair of files.

    The catalog tells what the columns mean; whole-file duplicates need no column.
    """
    rows = relation_rows.where("verdict = 'confirmed'")
    for end in ("source", "target"):
        known = catalog.selectExpr(
            f"table AS {end}", f"name AS {end}_column", f"key AS {end}_key", f"kind AS {end}_kind", f"base AS {end}_base"
        )
        rows = rows.join(F.broadcast(known), [end, f"{end}_column"], "left")
    same_base = (
        "source_base <> '' AND source_base = target_base AND source_kind = target_kind AND source_kind <> 'other'"
    )
    alignment = when(
        ("source_key <> '' AND source_key = target_key", "'same_header'"),
        (same_base, "'same_semantic_base'"),
        ("type = 'exact_duplicate'", "'whole_file_duplicate'"),
    )
    pair = "PARTITION BY source, target"
    best = f"{pair}, source_column, target_column ORDER BY confidence DESC, id"
    aligned = rows.selectExpr("*", f"{alignment} AS alignment").where("alignment IS NOT NULL").selectExpr(
        "*",
        f"row_number() OVER ({best}) AS best",
        f"max(confidence) OVER ({pair}) AS files_confidence",
        f"sum(evidence_count) OVER ({pair}) AS files_evidence",
    )
    ranked = aligned.where("best = 1").selectExpr(
        "*",
        f"count(1) OVER ({pair}) AS correspondences",
        f"row_number() OVER ({pair} ORDER BY confidence DESC, source_column, target_column) AS rank",
    )
    return ranked.where(f"rank <= {keep}").select(
        "source", "target", "rank", "source_column", "target_column", "alignment", "confidence",
        "evidence_count", "correspondences", "files_confidence", "files_evidence",
    )


def duplicate_links(files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Files with equal digests: every copy is tied to the first path of its group.

    All pairs of a group follow from these ties, so a group of n copies costs n rows and not n squared.
    The first path is a plain minimum, combined before the shuffle; the join back can be split by AQE.
    """
    first = files.groupBy(digest).agg(F.min(path).alias("source"), F.count(F.lit(1)).alias("copies"))
    groups = first.where("copies > 1")
    return files.join(groups, digest).where(f"{path} <> source").selectExpr(
        relation_id("source", path, "'exact_duplicate'", "'whole-file'", "'whole-file'") + " AS id",
        "source", f"{path} AS target", "'exact_duplicate' AS type", "'confirmed' AS verdict",
        "1.0D AS confidence", f"{digest} AS fingerprint", "copies",
    )


TOKENS = "regexp_extract_all({}, '[a-z0-9]+', 0)"


def _anchors(names: DataFrame) -> DataFrame:
    """A piece of each name that any text with the name must show as a piece of its own.

    mode 0: a word with other characters on both sides, which is a whole word of the text;
    mode 1: the last word, which is at least the start of a word; mode 2: four characters of the name.
    """
    split = names.selectExpr(
        "*",
        f"{TOKENS.format('folded_name')} AS words",
        "folded_name rlike '^[a-z0-9]' AS starts",
        "folded_name rlike '[a-z0-9]$' AS ends",
    )
    inner = split.selectExpr(
        "*", "slice(words, int(starts) + 1, greatest(size(words) - int(starts) - int(ends), 0)) AS inner_words"
    )
    # of several such words the one that fewest names share, so that a word of many names drives no join
    candidates = inner.where("size(inner_words) > 0").selectExpr(
        "target", "folded_name", "explode(array_distinct(inner_words)) AS piece"
    )
    shared = candidates.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = candidates.join(shared, "piece").selectExpr(
        "*", "row_number() OVER (PARTITION BY target, folded_name ORDER BY n, char_length(piece) DESC, piece) AS r"
    ).where("r = 1").selectExpr("target", "folded_name", "0 AS mode", "piece")
    last_is_open = "size(words) > int(starts)"
    others = inner.where("size(inner_words) = 0").selectExpr(
        "target", "folded_name", f"if({last_is_open}, 1, 2) AS mode",
        f"if({last_is_open}, element_at(words, -1), left(folded_name, 4)) AS piece",
    )
    return rarest.unionByName(others)


def lower_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def name_anchors(names: DataFrame, min_chars: int = 4) -> DataFrame:
    """(target, folded_name, mode, piece): the pieces by which texts are held against names (path, file_name); see _anchors."""
    return cut_lineage(_anchors(
        names.where(f"char_length(file_name) >= {min_chars}").selectExpr("path AS target", f"{lower_fold('file_name')} AS folded_name")
    ))


FEW_PIECES = 64
"""So few pieces are looked for one by one; the parts of a text, which may be many more, are not listed then."""


def text_pieces(anchors: DataFrame, folded: str) -> dict[int, str]:
    """{mode: array of the parts of a text that may be the piece of a name}."""
    words = f"array_distinct({TOKENS.format(folded)})"
    pieces = {
        0: words,
        1: f"array_distinct(flatten(transform({words}, w -> transform(sequence(1, char_length(w)), n -> left(w, n)))))",
        2: f"array_distinct(transform(sequence(1, greatest(char_length({folded}) - 3, 1)), n -> substring({folded}, n, 4)))",
    }
    for mode in (1, 2):
        few = [r["piece"] for r in anchors.where(f"mode = {mode}").select("piece").distinct().limit(FEW_PIECES + 1).collect()]
        if 0 < len(few) <= FEW_PIECES:
            pieces[mode] = f"filter(array({', '.join(quote(x) for x in sorted(few))}), x -> contains({folded}, x))"
    return pieces


def explicit_references(texts: DataFrame, names: DataFrame, min_chars: int = 4) -> DataFrame:
    """Texts (path, locator, text) that hold the name of another file (names: path, file_name).

    Names and texts meet in an equi-join on an anchor piece and the whole name is then looked for in the
    text, so no text is held against every name. The search is exact.
    """
    anchors = name_anchors(names, min_chars)
    modes = {row["mode"] for row in anchors.select("mode").distinct().collect()}
    pieces = text_pieces(anchors, "folded")
    found = None
    rows = texts.selectExpr("path AS source", "locator", f"{lower_fold('text')} AS folded")
    for mode in sorted(modes):
        # a piece carries no text: candidates get theirs back once, for the final test
        hits = rows.selectExpr("source", "locator", f"explode({pieces[mode]}) AS piece").join(
            anchors.where(f"mode = {mode}").drop("mode"), "piece"
        ).where("source <> target").select("source", "locator", "target", "folded_name").distinct()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = rows.selectExpr("source", "locator", "source AS target", "'' AS folded_name").limit(0)
    found = found.distinct().join(rows, ["source", "locator"]).where("contains(folded, folded_name)")
    return found.selectExpr(
        "source", "target", "locator", "'explicit_reference' AS type", "0.99D AS confidence", "'confirmed' AS verdict"
    )
