"""Reductions of records: scopes, versions, merges, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.functions.text import contains_any, strip, when
from linkweave.operators.ordered import WIDTH, carried_asof, carried_sum


def owned_by(df: DataFrame, owner: str, column: str = "owner_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(owner))


def newest_first(df: DataFrame, column: str = "updated_at") -> DataFrame:
    return df.orderBy(F.desc(column))


def record_summaries(records: DataFrame, files: DataFrame, questions: DataFrame, packages: DataFrame) -> DataFrame:
    """Files, open questions and packages per record; each side is counted before it is joined."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("record_id").agg(F.count(F.lit(1)).alias(name))

    open_questions = questions.where("coalesce(status, 'open') = 'open'")
    return (
        records.join(counted(files, "file_count"), "record_id", "left")
        .join(counted(open_questions, "open_question_count"), "record_id", "left")
        .join(counted(packages, "package_count"), "record_id", "left")
        .fillna(0, ["file_count", "open_question_count", "package_count"])
    )


def number_versions(snapshots: DataFrame, key: str = "record_id", order: str = "seq", width: int = WIDTH) -> DataFrame:
    """Versions 1, 2, ... per record in order of a number that is unique within the record."""
    return carried_sum(snapshots, [key], order, "1", "version", width)


def version_as_of(versions: DataFrame, version: int) -> DataFrame:
    return versions.where(f"version = {version}")


def versions_at(requests: DataFrame, versions: DataFrame, key: str = "record_id", at: str = "at", values: tuple[str, ...] = ("version", "snapshot"), width: int = WIDTH) -> DataFrame:
    """Requests (key, at, ...) with the version of their record that was the newest then; `at` is a number in both frames."""
    return carried_asof(requests, versions, [key], at, [*values], width)


def rollback(versions: DataFrame, version: int, key: str = "record_id") -> DataFrame:
    """All versions plus a new newest one per record that holds the snapshot of an older one."""
    latest = versions.groupBy(key).agg(F.max("version").alias("latest"))
    restored = versions.where(f"version = {version}").join(latest, key).selectExpr(
        key, "snapshot", "latest + 1 AS version", f"concat('Rolled back to v', {version}) AS summary"
    )
    return versions.selectExpr(key, "snapshot", "version", "summary").unionByName(restored)


def merge_items(existing: DataFrame, incoming: DataFrame, key: list[str], fields: list[str], keep: int = 12) -> DataFrame:
    """Upsert: fields of the newest incoming patch that are not empty win; the first twelve titled items stay.

    Both sides carry `seq`, the position of an item or a patch. Patches of one item are folded first.
    """
    both = existing.selectExpr(*key, "0 AS side", "seq", *fields).unionByName(
        incoming.selectExpr(*key, "1 AS side", "seq", *fields)
    )
    folds = [
        F.expr(f"max_by({f}, struct(side, seq)) FILTER (WHERE coalesce({f}, '') <> '') AS {f}") for f in fields
    ]
    merged = both.groupBy(*key).agg(F.min(F.struct("side", "seq")).alias("place"), *folds)
    filled = merged.selectExpr(*key, "place", *[f"coalesce({f}, '') AS {f}" for f in fields]).where("title <> ''")
    owner = key[0]
    ranked = filled.selectExpr("*", f"row_number() OVER (PARTITION BY {owner} ORDER BY place, {key[-1]}) AS n")
    return ranked.where(f"n <= {keep}").select(*key, "n", *fields)


def last_by_name(entries: DataFrame, values: list[str], scope: list[str] | None = None) -> DataFrame:
    """One entry per name: the last one, at the position of the first."""
    keys = [*(scope or []), "name"]
    return entries.groupBy(*keys).agg(
        F.min("seq").alias("place"), F.expr(f"max_by(struct({', '.join(values)}), seq) AS e")
    ).select(*keys, "place", "e.*")


def first_by_name(entries: DataFrame, values: list[str], scope: list[str] | None = None) -> DataFrame:
    """One entry per non-blank name: the first one."""
    keys = [*(scope or []), "name"]
    named = entries.withColumn("name", F.expr(strip("name"))).where("name <> ''")
    return named.groupBy(*keys).agg(
        F.min("seq").alias("place"), F.expr(f"min_by(struct({', '.join(values)}), seq) AS e")
    ).select(*keys, "place", "e.*")


# Words of an answer that refuse or allow.
REJECT_WORDS = ("拒绝", "不允许", "reject", "deny", "do not run", "don't run")
APPROVE_WORDS = ("允许本次执行", "允许执行", "approve", "approved", "run once")


def decision(answer: str) -> str:
    """'approve' or 'reject' for a free-text answer; a refusal wins and silence refuses."""
    text = f"lower({answer})"
    return when(
        (contains_any(text, REJECT_WORDS), "'reject'"), (contains_any(text, APPROVE_WORDS), "'approve'"),
        otherwise="'reject'",
    )


def answers_to_resume(questions: DataFrame, keep: int = 12) -> DataFrame:
    """Answered questions not yet used, the newest twelve of each session, oldest first (`n`)."""
    ready = questions.where(
        f"status = 'answered' AND {strip('answer')} <> '' AND coalesce(continuation_run_id, '') = ''"
    )
    back = ready.selectExpr(
        "*", "row_number() OVER (PARTITION BY session_id ORDER BY answered_at DESC, question_id DESC) AS back"
    ).where(f"back <= {keep}")
    return back.selectExpr(
        "session_id", "row_number() OVER (PARTITION BY session_id ORDER BY answered_at, question_id) AS n",
        "question_id", f"{strip('answer')} AS answer", "answered_at",
    )


def open_questions(questions: DataFrame) -> DataFrame:
    return questions.where("coalesce(status, '') <> 'answered'")


def waiting_run(runs: DataFrame) -> DataFrame:
    """Newest run of each session that waits for its user."""
    return runs.where("status = 'waiting_for_user'").groupBy("session_id").agg(F.expr("max_by(run_id, seq) AS run_id"))


def missing_requirements(records: DataFrame, known: DataFrame) -> DataFrame:
    """Goal and description of records as requirements, where their text is not known yet."""
    texts = records.selectExpr(
        "record_id", f"stack(2, 'business_goal', {strip('goal')}, 'business_description', {strip('description')}) AS (source, text)"
    ).where("text <> ''")
    fresh = texts.join(known.select("record_id", "text").distinct(), ["record_id", "text"], "left_anti")
    return fresh.groupBy("record_id", "text").agg(F.max("source").alias("source"))


def usages_of_present_files(usages: DataFrame, files: DataFrame) -> DataFrame:
    """Usages without a source file, and those whose file is still there."""
    unset = usages.where("coalesce(source_file_id, '') = ''")
    present = usages.where("coalesce(source_file_id, '') <> ''").join(
        files.selectExpr("file_id AS source_file_id").distinct(), "source_file_id", "left_semi"
    )
    return unset.unionByName(present)


