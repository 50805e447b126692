"""One pass over the texts of a table: the statements that may be among the best of their file, and the first headings.

A task splits its texts, scores what holds a marker or a name, and keeps for each file the best statements with different names and
the first headings. Both merge exactly: what is among the best of the whole is among the best of its task. So what leaves a task is bounded
by the limits and the files it met, and no statement is scored twice for the cards of lines, of cells and of outlines.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.functions import statements as S
from linkweave.operators.links import lower_fold
from linkweave.operators.occurrences import with_row_number
from linkweave.session import spread

MANY_NAMES = 20_000
"""So many names of files are held by every task; more meet the statements in a join (cards.mention_scores), with the same result."""
FEW_PIECES = 512
"""So few pieces of names are looked for by one expression."""
CHUNK_CHARS = 1 << 20
"""Texts are worked on in chunks of about so many characters."""
SLICE_TEXTS = 64
HELD_FILES = 4096
"""A task that holds the statements of more files sends them on and starts afresh."""

SCHEMA = (
    "what string, file string, column string, locator string, ord long, statement string, folded string, score long, mentioned array<string>"
)
_FIELDS = pa.schema([
    ("what", pa.string()), ("file", pa.string()), ("column", pa.string()), ("locator", pa.string()), ("ord", pa.int64()),
    ("statement", pa.string()), ("folded", pa.string()), ("score", pa.int64()), ("mentioned", pa.list_(pa.string())),
])

_LINES = re.compile("\r\n|\n|\r")
_PARTS = re.compile(f"[^{S._STOPS}]*[{S._STOPS}]|[^{S._STOPS}]+")
_HEADING = r"^(?:#{1,6} |[0-9]+(?:\.[0-9]+)*[.)、 ]|[一二三四五六七八九十]+[、.]|[-*•] )"
_PLAIN = re.compile("[^a-z0-9一-鿿]+")
_WORDS = re.compile("[a-z0-9]{3,}")
_CHINESE = re.compile("[^一-鿿]+")
_ASCII = [[m for m in some if m.isascii()] for some in (S.RELATION_MARKERS, S.SEQUENCE_MARKERS, S.BRANCH_MARKERS)]
_ALL = [list(some) for some in (S.RELATION_MARKERS, S.SEQUENCE_MARKERS, S.BRANCH_MARKERS)]


def _any_of(texts) -> str:
    return "|".join(re.escape(t) for t in sorted(texts))


_MARKED = _any_of({m for some in _ALL for m in some})


def statements_of(text: str, limit: int = 320) -> Iterator[tuple[int, str]]:
    """(line number, statement): what split_statements says of each line, and so of the whole text."""
    for n, line in enumerate(_LINES.split(text.rstrip("\n")) if "\r" in text else text.rstrip("\n").split("\n"), 1):
        for part in _PARTS.findall(line):
            if len(part) >= 6:
                flat = " ".join(part.split())
                if len(flat) >= 6:
                    yield n, flat if len(flat) <= limit else flat[:limit] + "..."


def marker_score(folded: str) -> int:
    relation, sequence, branch = _ASCII if folded.isascii() else _ALL
    return (
        3 * sum(m in folded for m in relation) + 2 * any(m in folded for m in sequence) + 2 * any(m in folded for m in branch)
    )


def relation_tokens(text: str, folded: str) -> set[str]:
    found = set(_WORDS.findall(folded))
    if not text.isascii():
        chinese = _CHINESE.sub("", text)
        found.update(chinese[i:i + 2] for i in range(len(chinese) - 1))
    return found.difference(S.COMMON_TOKENS)


class Names:
    """Names of files as texts are held against them; see cards.mention_scores for what they add to a score.

    A name is looked for where a text holds four characters of it, those that fewest names share; a name of n tokens where it holds one of
    the n-2 that fewest share.
    """

    def __init__(self, names: list[tuple[str, str, list[str]]]):
        """names: (target, its folded name, tokens of its stem)."""
        grams = [{name[i:i + 4] for i in range(len(name) - 3)} for _, name, _ in names]
        counts = Counter(g for some in grams for g in some)
        self.pieces: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for (target, name, _), some in zip(names, grams, strict=True):
            self.pieces[min(some, key=lambda g: (counts[g], g)) if some else name].append((target, name))
        self.tokens = [(target, set(tokens)) for target, _, tokens in names if len(set(tokens)) >= 3]
        shared = Counter(t for _, tokens in self.tokens for t in tokens)
        self.rare: dict[str, list[int]] = defaultdict(list)
        for i, (_, tokens) in enumerate(self.tokens):
            for t in sorted(tokens, key=lambda t: (shared[t], t))[: len(tokens) - 2]:
                self.rare[t].append(i)
        self.pattern = _any_of(self.pieces) if len(self.pieces) <= FEW_PIECES else None

    def candidates(self, low: pa.Array) -> list[bool]:
        """Which texts may hold a name."""
        if not self.pieces and not self.rare:
            return [False] * len(low)
        if self.rare or self.pattern is None:
            return [True] * len(low)
        return pc.match_substring_regex(low, self.pattern).to_pylist()

    def gains(self, statement: str, folded: str, low: str) -> dict[str, int]:
        found: dict[str, int] = {}
        if self.pattern is not None:
            pieces = [p for p in self.pieces if p in low]
        else:
            pieces = self.pieces.keys() & {low[i:i + 4] for i in range(len(low) - 3)}
        for p in pieces:
            for target, name in self.pieces[p]:
                if name in low:
                    found[target] = 6
        if self.rare:
            tokens = relation_tokens(statement, folded)
            for i in {i for t in tokens & self.rare.keys() for i in self.rare[t]}:
                target, own = self.tokens[i]
                gain = min(6, len(tokens & own))
                if gain >= 3:
                    found[target] = max(gain, found.get(target, 0))
        return found


def known_names(names: DataFrame) -> Names | None:
    """names: (path, file_name, stem). None where a task should not hold them all."""
    rows = names.where("char_length(file_name) >= 4").selectExpr(
        "path", f"{lower_fold('file_name')} AS name", f"{S.relation_tokens('stem')} AS tokens"
    ).limit(MANY_NAMES + 1).collect()
    return Names([(r["path"], r["name"], r["tokens"] or []) for r in rows]) if len(rows) <= MANY_NAMES else None


@dataclass(slots=True)
class _Found:
    """A statement of a text that may become a card."""

    line: int
    statement: str
    folded: str
    score: int
    gains: dict[str, int]


def _examine(texts: list[str], names: Names) -> Iterator[tuple[list[_Found], list[tuple[int, str]]]]:
    """For each text its statements with a score or a name, and its headings: (line number, statement)."""
    at, lines, said = [0], [], []
    for text in texts:
        for n, statement in statements_of(text):
            lines.append(n)
            said.append(statement)
        at.append(len(said))
    joined = "\n".join(said)  # a statement holds no line break
    folded = joined.casefold().split("\n")
    low = folded if joined.isascii() else joined.lower().replace("ß", "ss").split("\n")
    marked = pc.match_substring_regex(pa.array(folded, pa.string()), _MARKED).to_pylist()
    named = names.candidates(pa.array(low, pa.string()))
    headed = pc.match_substring_regex(pa.array(said, pa.string()), _HEADING).to_pylist()
    for low_at, high_at in zip(at, at[1:]):
        found, heads = [], []
        for i in range(low_at, high_at):
            if marked[i] or named[i]:
                gains = names.gains(said[i], folded[i], low[i]) if named[i] else {}
                score = marker_score(folded[i]) if marked[i] else 0
                if score or gains:
                    found.append(_Found(lines[i], said[i], folded[i], score, gains))
            if headed[i] and not marked[i] and len(said[i]) <= 100:
                heads.append((lines[i], said[i]))
        yield found, heads


def _examined(values: pa.Array, names: Names) -> Iterator[tuple[int, list[_Found], list[tuple[int, str]]]]:
    """(place, statements, headings) of the texts that have any."""
    chunk, begin, size = [], 0, 0
    for at in range(0, len(values), SLICE_TEXTS):  # a batch of long texts is never held as Python's strings
        for i, text in enumerate(values.slice(at, SLICE_TEXTS).to_pylist(), at):
            chunk.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from ((begin + j, *x) for j, x in enumerate(_examine(chunk, names)) if x[0] or x[1])
                chunk, begin, size = [], i + 1, 0
    yield from ((begin + j, *x) for j, x in enumerate(_examine(chunk, names)) if x[0] or x[1])


class _Best:
    """The best statements of each file, the best of each name: those with the smallest keys."""

    def __init__(self, keep: int):
        self.keep = keep
        self.files: dict[str | None, tuple[dict[str, tuple], list]] = {}

    def add(self, file: str | None, column: str, locator: str | None, found: _Found) -> None:
        mentioned = sorted(t for t in found.gains if t != file) if file is not None and found.gains else []
        score = found.score + sum(found.gains[t] for t in mentioned)
        if not score:
            return
        held = self.files.get(file)
        if held is None:
            held = self.files[file] = ({}, [])
        kept, bound = held
        key = (-score, locator or "", found.statement)
        if bound and key >= bound[0]:
            return
        name = _PLAIN.sub("", found.folded)
        if not name or (name in kept and kept[name][0] <= key):
            return
        kept[name] = (key, column, locator, found, score, mentioned)
        if len(kept) > 4 * self.keep:
            best = sorted(kept.items(), key=lambda e: e[1][0])[: self.keep]
            kept.clear()
            kept.update(best)
            bound[:] = [best[-1][1][0]]

    def rows(self, what: str) -> list[tuple]:
        out = []
        for file, (kept, _) in self.files.items():
            for _, column, locator, found, score, mentioned in sorted(kept.values(), key=lambda e: e[0])[: self.keep]:
                out.append((what, file, column, locator, None, found.statement, found.folded, score, mentioned))
        self.files.clear()
        return out


class _Heads:
    """The first headings of each file in reading order."""

    def __init__(self, seen: int):
        self.seen = seen
        self.files: dict[str | None, tuple[list[tuple], list]] = {}

    def add(self, file: str | None, locator: str | None, ord: int | None, statement: str) -> None:
        kept, bound = self.files.setdefault(file, ([], []))
        key = (ord is not None, ord or 0, statement)
        if bound and key >= bound[0]:
            return
        kept.append((key, locator, ord))
        if len(kept) > 4 * self.seen:
            kept.sort(key=lambda e: e[0])
            del kept[self.seen:]
            bound[:] = [kept[-1][0]]

    def rows(self) -> list[tuple]:
        out = []
        for file, (kept, _) in self.files.items():
            for (_, _, statement), locator, ord in sorted(kept, key=lambda e: e[0])[: self.seen]:
                out.append(("head", file, None, locator, ord, statement, "", 0, []))
        self.files.clear()
        return out


def _passing(table: str, file: str, columns: list[str], lines: str | None, names: Names, keep: int, seen: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, said, heads = _Best(keep), _Best(keep), _Heads(seen)

        def sent() -> Iterator[pa.RecordBatch]:
            rows = cells.rows("cell") + said.rows("line") + heads.rows()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS, strict=True)], schema=_FIELDS)

        for batch in batches:
            numbers = batch.column("row_no")
            for i, column in enumerate(columns):
                coded = batch.column(f"t{i}").dictionary_encode()  # equal texts of a batch are looked at once
                codes = coded.indices
                at = {place: (found, first) for place, found, first in _examined(coded.dictionary, names)}
                if not at:
                    continue
                hit = pc.indices_nonzero(pc.fill_null(pc.is_in(codes, value_set=pa.array(list(at), codes.type)), False))
                some, rows = codes.take(hit).to_pylist(), numbers.take(hit).to_pylist()
                first_row: dict[int, str] = {}
                for code, row in zip(some, rows, strict=True):  # of equal cells the one whose locator sorts first
                    text = f"{row};"
                    if code not in first_row or text < first_row[code]:
                        first_row[code] = text
                for code, row in first_row.items():
                    for found in at[code][0]:
                        cells.add(file, column, f"table:{table};row:{row}column:{column}", found)
                if column == lines:
                    files, ids = (batch.column(c).take(hit).to_pylist() for c in ("file", "doc_id"))
                    for code, source, doc in zip(some, files, ids, strict=True):
                        found, first = at[code]
                        start = None if doc is None else f"doc:{doc};line:"
                        for f in found:
                            said.add(source, "", start and f"{start}{f.line}", f)
                        for line, statement in first:
                            heads.add(source, start and f"{start}{line}", None if doc is None else doc * 1_000_000 + line, statement)
                        if len(said.files) + len(heads.files) > HELD_FILES:
                            yield from sent()
        yield from sent()

    return run


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def scan_texts(
    df: DataFrame, table: str, file: str, names: Names, lines: tuple[str, str, str] | None = None, keep: int = 40, seen: int = 24,
) -> DataFrame | None:
    """The entries of one pass over all text cells of a table, as SCHEMA says; write them before use. None for a table without texts.

    what = 'cell': statements of `file`, for cards of tables. With `lines`, the columns that name a document's file, its id and its text,
    what = 'line' are statements and what = 'head' headings of the documents' files. Scores count what names add.
    """
    columns = text_columns(df)
    if not columns:
        return None
    # shorter cells hold no statement, and rows without a longer one don't leave the scan
    texts = [f"if(char_length(trim(`{c}`)) >= 6, make_valid_utf8(`{c}`), NULL) AS t{i}" for i, c in enumerate(columns)]
    documents = [f"make_valid_utf8(`{lines[0]}`) AS file", f"bigint(`{lines[1]}`) AS doc_id"] if lines else []
    longer = " OR ".join(f"char_length(trim(`{c}`)) >= 6" for c in columns)
    narrow = spread(with_row_number(df).where(longer).selectExpr("row_no", *documents, *texts))
    return narrow.mapInArrow(_passing(table, file, columns, lines[2] if lines else None, names, keep, seen), SCHEMA)
