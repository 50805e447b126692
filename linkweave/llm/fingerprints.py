"""Document fingerprints from closed syncmers, in SQL expressions only.

The words of a text are hashed, and every two neighbours make an inner substring. A k-mer of four words holds three of
them and is chosen if the least one lies at its front or its end; whether it is chosen depends on its own words
alone, so texts that share a stretch share the anchors in it wherever it stands. The fingerprint is the sorted list of the
64 smallest anchor hashes: likeness of two fingerprints estimates the Jaccard similarity of the anchor sets, and is exact
for texts with few anchors. Texts of fewer than 24 words also have anchors of their characters, so that short texts can
be compared in part as well. The two kinds are parts of a fingerprint, and two texts are compared by the kinds that both have: a
short one with one as long as the bound by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.session import cut_lineage

SIZE = 64
SHORT_WORDS = 24
_SPACES = "[ \\t-\\r]+"


def _edge(inner: str) -> str:
    """Whether the least of the three inner substrings that begin with the i-th, s, is the first or the last."""
    y, z = f"get({inner}, i + 1)", f"get({inner}, i + 2)"
    return f"(s <= least({y}, {z}) OR {z} <= least(s, {y}))"


def _chosen(inner: str, kmers: str) -> str:
    """Hashes of the chosen k-mers; kmers: how many there are."""
    return f"filter(transform({inner}, (s, i) -> IF(i < {kmers} AND {_edge(inner)}, xxhash64(s, get({inner}, i + 2)), NULL)), a -> a IS NOT NULL)"


def _inner(units: str) -> str:
    """Hashes of every two neighbours; the last has none after it and begins no k-mer."""
    return f"transform({units}, (u, i) -> xxhash64(u, get({units}, i + 1)))"


def _words(source: str) -> str:
    return f"transform(filter(split({source}, r'{_SPACES}'), x -> x <> ''), x -> xxhash64(x))"


PAD = "array(0L, 0L, 0L)"
"""Follows the words, so that each begins a k-mer and the shortest text has one."""


def _anchors(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Adds the array of anchor hashes of a text column."""
    w, c, s, t = (f"__{target}_{x}" for x in ("words", "chars", "inner", "small"))
    rows = rows.withColumn(w, F.expr(_words(source))).withColumn(s, F.expr(f"concat({w}, {PAD})")).withColumn(s, F.expr(_inner(s)))
    rows = rows.withColumn(c, F.expr(f"IF(size({w}) BETWEEN 1 AND {SHORT_WORDS - 1}, transform(split({source}, ''), x -> xxhash64(x, 1)), array())"))
    rows = rows.withColumn(t, F.expr(_inner(c)))
    found = f"struct({_chosen(s, f'size({w})')} AS words, {_chosen(t, f'(size({c}) - 3)')} AS chars)"
    return rows.withColumn(target, F.expr(found)).drop(w, c, s, t)


def sketched(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Adds the sketch of a text column: the SIZE smallest distinct anchors of its words, and those of its characters if it is
    short, as 32-bit numbers in rising order.

    NULL and blank texts have an empty sketch.
    """
    rows = _anchors(rows.withColumn("__text", F.coalesce(F.col(source), F.lit(""))), "__text", "__found")
    small = "slice(array_sort(array_distinct(transform(__found.{0}, x -> int(shiftright(x, 32))))), 1, " + str(SIZE) + ") AS {0}"
    return rows.withColumn(target, F.expr(f"struct({small.format('words')}, {small.format('chars')})")).drop("__text", "__found")


def fingerprint(sketch: str) -> Column:
    """A sketch as text: eight hexadecimal digits an anchor, those of characters after a point."""
    digits = "array_join(transform({0}, x -> lpad(lower(hex(x & 4294967295L)), 8, '0')), '')"
    words, chars = (digits.format(f"{sketch}.{kind}") for kind in ("words", "chars"))
    return F.expr(f"IF(size({sketch}.chars) = 0, {words}, concat({words}, '.', {chars}))")


def likeness(a: str, b: str) -> Column:
    """Estimated share of common anchors of two sketches, 0 to 1, by the kinds of anchors that both have; two empty ones are alike."""
    kinds = f"(size({a}.chars) > 0 AND size({b}.chars) > 0)"
    x, y = (f"IF({kinds}, array_union({s}.words, {s}.chars), {s}.words)" for s in (a, b))
    union = f"slice(array_sort(array_union({x}, {y})), 1, {SIZE})"
    return F.expr(
        f"CASE WHEN size({a}.words) = 0 AND size({b}.words) = 0 THEN 1D"
        f" ELSE size(array_intersect(array_intersect({union}, {x}), {y})) / size({union}) END"
    )


def positions(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, anchor, position): every word anchor of every text with the number of its first word, from 0. For matching."""
    rows = texts.select(texts[key].alias("__key"), F.coalesce(texts[text].cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__w", F.expr(_words("__text"))).withColumn("__s", F.expr(f"concat(__w, {PAD})")).withColumn("__s", F.expr(_inner("__s")))
    chosen = f"IF(i < size(__w) AND {_edge('__s')}, struct(xxhash64(s, get(__s, i + 2)) AS anchor, i AS position), NULL)"
    return rows.selectExpr(f"__key AS `{key}`", f"explode(filter(transform(__s, (s, i) -> {chosen}), a -> a IS NOT NULL)) AS a").select(key, "a.*")


def matches(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(left_key, right_key, shift, anchors): how many anchors two texts share at each shift of position.

    `left` and `right` come from positions(). An anchor that stands in many texts on both sides meets them all: `left` is
    a stated set of query texts.
    """
    pairs = left.select(F.col(key).alias("left_key"), "anchor", F.col("position").alias("p")).join(
        right.select(F.col(key).alias("right_key"), "anchor", F.col("position").alias("q")), "anchor"
    )
    return pairs.groupBy("left_key", "right_key", F.expr("q - p").alias("shift")).agg(F.count(F.lit(1)).alias("anchors"))


def following(ids: DataFrame, key: str) -> DataFrame:
    """(key, next): each distinct id and the next smaller one; after the smallest comes the largest. NULL ids are left out.

    Ids are dealt out by range; only one row a range is ordered as a whole.
    """
    ranges = cut_lineage(
        ids.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(F.col(key).desc()).withColumn("part", F.spark_partition_id()), "ids"
    )
    edges = ranges.groupBy("part").agg(F.max(key).alias("top"))
    # the part after a part's last id, in falling order of ids; the last part is followed by the first
    after = edges.selectExpr(
        "part", "coalesce(lead(top) OVER (ORDER BY top DESC), first(top) OVER (ORDER BY top DESC)) AS onward"
    )
    within = ranges.selectExpr(key, "part", f"lead({key}) OVER (PARTITION BY part ORDER BY {key} DESC) AS near")
    return within.join(after, "part").selectExpr(key, "coalesce(near, onward) AS next")


def edited_fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The last third of the edited text is the begin of the next document's (by falling id; after the last comes the first).
    Repeated rows give a row each; the next document of an id that has several texts is the one of the smallest text. Rows
    of a NULL id have no next document: their edited text lacks the last third, and near_next is NULL. NULL texts are empty.

    Texts are shuffled once, by id; what a document gives to the one before it is a third of a text at most.
    """
    rows = documents.select(
        documents[key].alias("id"), F.coalesce(documents[text].cast("string"), F.lit("")).alias("text")
    )
    alone = sketched(rows.where("id IS NULL"), "text", "sketch")
    # dealt out by id here, so that the rows and the heads made of them share one shuffle
    rows = rows.where("id IS NOT NULL")
    lengths = rows.groupBy("id").agg(F.max(F.length("text")).alias("chars"))
    rows = sketched(rows, "text", "sketch").repartition("id")
    onward = following(documents.select(documents[key].alias("id")), "id")
    give = onward.join(lengths, "id").select(F.col("id").alias("before"), F.col("next").alias("id"), F.expr("chars div 3").alias("most"))
    heads = rows.withColumn("turn", F.expr("row_number() OVER (PARTITION BY id ORDER BY text)")).where("turn = 1").join(give, "id").select(
        F.col("before").alias("id"), F.expr("left(text, int(most))").alias("head"), F.col("sketch").alias("next_sketch")
    )
    both = rows.join(heads, "id", "left").unionByName(alone, allowMissingColumns=True).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 3)), left(coalesce(head, ''), int(n_chars div 3)))"))
    both = sketched(both.drop("head"), "edited", "edited_sketch")
    return both.select(
        F.col("id").alias(key), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        F.when(F.col("next_sketch").isNotNull(), likeness("sketch", "next_sketch")).alias("near_next"),
    )
