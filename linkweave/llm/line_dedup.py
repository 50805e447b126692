"""Line dedup: long lines that many documents share stay in one of them, in SQL expressions only.

Lines are exploded as hashes of their normalised form, and the rows that hold each hash are counted with partial sums, so a
line that every document has is no hot key. The few hashes found often enough meet the lines again, with their positions, for an
exact count of distinct documents; what each text must lose is a list of positions, and the text is put together again from the
positions that are left. A text that loses nothing is never cut and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut_lineage


@dataclass(frozen=True)
class LineRules:
    min_chars: int = 40
    """Code points of a line's normalised form; shorter lines always stay."""
    min_documents: int = 5
    """Documents that must hold a line before it is dropped."""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stripped(x: str) -> str:
    """Without blanks and the characters 0x09 to 0x0D at both ends."""
    return f"trim(BOTH ' \\t\\n\\u000B\\f\\r' FROM {x})"


def folded(x: str) -> str:
    """A-Z to a-z and no other letter; `lower` is the quicker form of it where all characters are ASCII."""
    return f"IF(octet_length({x}) = char_length({x}), lower({x}), translate({x}, '{_UPPER}', '{_LOWER}'))"


def _hashed(documents: DataFrame, key: str, text: str, rules: LineRules) -> DataFrame:
    """(id, size, mark, lines): a text's identity within its id, and 128 bits a long line; NULL for short ones."""
    rows = documents.select(documents[key].alias("id"), F.coalesce(documents[text].cast("string"), F.lit("")).alias("whole"))
    rows = rows.select("id", *_identity("whole"), F.split("whole", "\n", -1).alias("lines"))
    rows = rows.withColumn("lines", F.expr(f"transform(lines, x -> {stripped('x')})"))
    rows = rows.withColumn("lines", F.expr(f"transform(lines, x -> IF(char_length(x) < {rules.min_chars}, NULL, {folded('x')}))"))
    both = "IF(x IS NULL, NULL, struct(xxhash64(x) AS a, xxhash64(1, x) AS b))"
    return rows.withColumn("lines", F.expr(f"transform(lines, x -> {both})"))


def _identity(text: str) -> tuple:
    return F.octet_length(text).alias("size"), F.xxhash64(text).alias("mark")


def repeated_lines(documents: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, mark, position, a, b, documents, keeper): each place of each line that enough documents hold.

    (a, b) is the line's hash, `documents` how many hold it and `keeper` the largest id among them. (id, size, mark) says which text.
    """
    rows = _hashed(documents, key, text, rules)
    each = rows.selectExpr("explode(array_distinct(filter(lines, x -> x IS NOT NULL))) AS x").select("x.*")
    # rows can't be fewer than documents, so nothing is lost; written, so that Spark knows its size before it joins
    often = cut_lineage(each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {rules.min_documents}").select("a", "b"), "lines")
    places = rows.selectExpr("id", "size", "mark", "posexplode(lines) AS (position, x)").where("x IS NOT NULL").selectExpr(
        "id", "size", "mark", "position", "x.a AS a", "x.b AS b"
    )
    found = cut_lineage(places.join(often, ["a", "b"]), "places")
    held = found.groupBy("a", "b").agg(
        (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("documents"), F.max("id").alias("keeper")
    )
    # written too: joined as an aggregate, a line with many places could not be split among tasks
    return found.join(cut_lineage(held.where(f"documents >= {rules.min_documents}"), "held"), ["a", "b"])


def deduplicated(documents: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, their text without the lines that stand elsewhere, with n_lines (before) and n_dropped; columns of these names are replaced.

    A line found in enough documents stays in the largest id that holds it, as often as it stands there. A NULL text is an empty
    one: one empty line. Rows of one id are one document, equal or not; rows of a NULL id are one too, below all others. Lines meet
    by 128 bits of hash, the texts of an id by their length and 64 bits. A text must fit a task.
    """
    lost = repeated_lines(documents, rules, key, text).where("NOT id <=> keeper").groupBy("id", "size", "mark").agg(
        F.collect_set("position").alias("lost")
    )
    lost = cut_lineage(lost.select(*[F.col(c).alias(f"__{c}") for c in lost.columns]), "lost")
    kept = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    whole = F.coalesce(documents[text].cast("string"), F.lit(""))
    rows = documents.select(*kept, whole.alias("__whole"))
    size, mark = _identity("__whole")
    same = F.col(key).eqNullSafe(F.col("__id")) & (size == F.col("__size")) & (mark == F.col("__mark"))
    rows = rows.join(lost, same, "left").withColumn("__lines", F.split("__whole", "\n", -1))
    left = "array_except(sequence(0, size(__lines) - 1), __lost)"
    joined = f"IF(__lost IS NULL, __whole, array_join(transform({left}, i -> get(__lines, i)), '\\n'))"
    return rows.select(
        *[F.expr(joined).alias(c) if c == text else F.col(c) for c in kept],
        F.expr("bigint(size(__lines))").alias("n_lines"), F.expr("bigint(coalesce(size(__lost), 0))").alias("n_dropped"),
    )
