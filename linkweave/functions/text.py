"""Text expressions.

Functions take and return Spark SQL expression text (`"value"`, `"lower(name)"`), so an operator hands
Spark one finished expression. All of it runs inside the JVM; only NFKC needs Python (`with_nfkc`).
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python sees it, inside ASCII and in full; Java's \s is narrower.
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# NFKC leaves strings of these characters as they are.
_COMPOSED = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ一-鿿]*$"


def raw(pattern: str) -> str:
    """A raw string literal; patterns that hold a quote use its escape."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\0", "\\0").replace("\n", "\\n") + "'"


def quoted(items) -> str:
    return ", ".join(quote(i) for i in items)


def replace_all(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {raw(pattern)}, {by})"


def when(*branches: tuple[str, str], otherwise: str = "NULL") -> str:
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"(CASE {body} ELSE {otherwise} END)"


def contains_any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(m)})" for m in markers) + ")"


def count_of(x: str, markers) -> str:
    return "(" + " + ".join(f"int(contains({x}, {quote(m)}))" for m in markers) + ")"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def with_nfkc(df: DataFrame, *columns: str) -> DataFrame:
    """NFKC form of text columns. Python changes only values with characters that NFKC could change; for all
    others it is handed NULL, but the Arrow exchange still takes in every row of a table with text columns."""
    changed = {}
    for name in columns:
        odd = ~F.col(f"`{name}`").rlike(_COMPOSED)
        changed[name] = F.when(odd, _nfkc(F.when(odd, F.col(f"`{name}`")))).otherwise(F.col(f"`{name}`"))
    return df.withColumns(changed) if changed else df


def _folding_table() -> dict[str, str]:
    """Characters whose case folding is not what lower-casing gives."""
    table = {}
    for point in range(0x80, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if char.casefold() != char.lower():
            table[char] = char.casefold()
    table["Σ"] = "σ"
    del table["ß"]  # common in German text, so it has a cheaper way below
    return table


_FOLDS = _folding_table()
_FOLD_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in _FOLDS) + "]"
_FOLD_JSON = quote(json.dumps(_FOLDS))


def casefold(x: str) -> str:
    """Full Unicode case folding; the per-character path runs only for texts that need it."""
    table = f"from_json({_FOLD_JSON}, 'map<string,string>')"
    slow = f"array_join(transform(split({x}, ''), c -> coalesce(try_element_at({table}, c), lower(c))), '')"
    # the first tests are cheap; the long class is tried only for texts outside of them
    odd = f"octet_length({x}) > char_length({x}) AND NOT {x} rlike {raw(_COMPOSED)} AND {x} rlike {raw(_FOLD_CLASS)}"
    return f"replace(CASE WHEN {odd} THEN {slow} ELSE lower({x}) END, 'ß', 'ss')"


def strip(x: str) -> str:
    return replace_all(x, f"^{SPACE}+|{SPACE}+$")


def stringify(x: str, dtype: T.DataType) -> str:
    """Text of a cell; a zero, a false and a null all read as empty."""
    if isinstance(dtype, T.StringType):
        return f"coalesce({x}, '')"
    if isinstance(dtype, T.BooleanType):
        return f"if({x}, 'True', '')"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        plain = f"rtrim('0', string(cast({x} as decimal(38,18))))"
        plain = f"if(endswith({plain}, '.'), concat({plain}, '0'), {plain})"
        wide = f"(abs({x}) >= 1e7 AND abs({x}) < 1e16) OR (abs({x}) >= 1e-4 AND abs({x}) < 1e-3)"
        return when((f"{x} IS NULL OR {x} = 0", "''"), (wide, plain), otherwise=f"string({x})")
    if isinstance(dtype, T.NumericType):
        return f"if({x} IS NULL OR {x} = 0, '', string({x}))"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"coalesce(to_json({x}), '')"
    return f"coalesce(string({x}), '')"


def normalize_value(x: str, ascii_only: bool = False) -> str:
    """Identity of a value: no white space, case folded. The text is in NFKC form already."""
    if ascii_only:
        return f"lower({replace_all(x, ASCII_SPACE + '+')})"
    return casefold(replace_all(x, SPACE + "+"))


def fingerprint(x: str) -> str:
    return f"sha2({x}, 256)"


def safe_preview(kind: str, x: str, limit: int = 72) -> str:
    """Masked form of a value: names are cut, e-mails keep their domain, the rest keep their ends."""
    size = f"char_length({x})"
    return when(
        (f"{kind} IN ('name', 'file_name', 'column')",
         f"concat(substring({x}, 1, {limit}), if({size} > {limit}, '...', ''))"),
        (f"{kind} = 'email' AND instr({x}, '@') > 0",
         f"concat(substring({x}, 1, if(instr({x}, '@') > 1, 1, 0)), '***', substring({x}, instr({x}, '@')))"),
        (f"{size} <= 4", f"repeat('*', {size})"),
        (f"{size} <= 10", f"concat(substring({x}, 1, 1), '***', right({x}, 1))"),
        otherwise=f"concat(left({x}, 4), '...', right({x}, 4))",
    )


def flat_text(x: str) -> str:
    """White space collapsed to single blanks."""
    return f"trim({replace_all(f'coalesce({x}, {quote(str())})', SPACE + '+', quote(' '))})"


def cut(x: str, limit: int) -> str:
    return f"if(char_length({x}) > {limit}, concat(left({x}, {limit}), '...'), {x})"


def normalize_name(x: str) -> str:
    """Letters and digits (Latin, CJK) of the folded text; an identity of headers and statements."""
    return plain_name(casefold(f"coalesce({x}, '')"))


def plain_name(folded: str) -> str:
    """normalize_name of a text that is case-folded already."""
    return replace_all(folded, "[^a-z0-9一-鿿]+")


def stable_id(prefix: str, *parts: str) -> str:
    fields = ", ".join(f"'p{i}', {p}" for i, p in enumerate(parts))
    return f"concat({quote(prefix)}, left(sha1(to_json(named_struct({fields}))), 12))"


MASK = "********"


def redact_values(x: str, secrets) -> str:
    """Each known secret replaced by a mask, longest first so that no part of one survives."""
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        x = f"replace({x}, {quote(secret)}, '{MASK}')"
    return x


# Fixed value: key names whose values are secrets.
SENSITIVE_WORD = "(?i:authorization|api[_-]?key|access[_-]?token|token|secret|password|credential|bearer)"
SENSITIVE_KEY = f"^{SENSITIVE_WORD}$"


def redact_map(x: str, key_pattern: str = SENSITIVE_KEY) -> str:
    return f"transform_values({x}, (k, v) -> if(k rlike {raw(key_pattern)}, '{MASK}', v))"


def strip_thinking(x: str) -> str:
    return strip(replace_all(replace_all(x, "(?is)<think>.*?</think>"), "(?is)</?think>"))


def reasoning_parts(x: str) -> str:
    """Texts inside think blocks, in order; an unclosed block runs to the end."""
    found = f"regexp_extract_all({x}, {raw('(?is)<think>(.*?)(?:</think>|$)')}, 1)"
    return f"filter({found}, part -> part <> '')"


def bounded_text(x: str, limit: int = 4000) -> str:
    return f"if(char_length({x}) > {limit}, concat(left({x}, {limit}), '\\n[truncated]'), {x})"


def bounded_list(x: str, limit: int = 50, text_limit: int = 4000) -> str:
    kept = f"transform(slice({x}, 1, {limit}), v -> {bounded_text('v', text_limit)})"
    more = f"array(concat('[', string(size({x}) - {limit}), ' more items omitted]'))"
    return f"if(size({x}) > {limit}, concat({kept}, {more}), {kept})"


def truncate_utf8(x: str, limit: int) -> str:
    """First `limit` bytes of the UTF-8 form, without a torn last character."""
    # the byte after a clean cut does not continue a character (10xxxxxx); a character has four at most
    branches = []
    for back in range(min(4, limit + 1)):
        n = limit - back
        following = f"hex(substring(encode({x}, 'UTF-8'), {n + 1}, 1))"
        branches.append((f"NOT {following} rlike '^[89AB]'", f"decode(substring(encode({x}, 'UTF-8'), 1, {n}), 'UTF-8')"))
    return when((f"octet_length({x}) <= {limit}", x), *branches)


def clean_id(x: str) -> str:
    return f"left({casefold(replace_all(replace_all(x, '(?U)[^\\w-]+', quote('_')), '^_+|_+$'))}, 80)"


def filled(x: str) -> str:
    """Trimmed text, or NULL where nothing is left."""
    return f"nullif({strip(x)}, '')"


def blocks_text(x: str) -> str:
    """Text of the text blocks of a message, joined."""
    kept = f"filter({x}, b -> b.type IN ('text', 'output_text'))"
    return f"array_join(transform({kept}, b -> coalesce(b.text, '')), '')"
