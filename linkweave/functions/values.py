"""Rules for cell values, and the entities a text holds. Expression text in, expression text out."""

from __future__ import annotations

from linkweave.config import HeaderRules, ValueRules
from linkweave.functions.headers import header_base, header_key, header_kind
from linkweave.functions.text import (
    fingerprint,
    normalize_value,
    quoted,
    raw,
    replace_all,
    safe_preview,
    when,
)

# Words that stand for "no value".
EMPTY_WORDS = ("null", "none", "n/a", "na", "true", "false", "未知", "无")
# White space is removed before this test, so a date with a blank before its time passes as a value.
DATE_LIKE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[tT\s].*)?$"


def valid_join_value(x: str, kind: str, rules: ValueRules = ValueRules()) -> str:
    """True for a normalised value that may link two columns."""
    return (
        f"({kind} <> 'other' AND {x} <> '' AND char_length({x}) <= {rules.max_chars}"
        f" AND {x} NOT IN ({quoted(EMPTY_WORDS)}) AND NOT {x} rlike {raw(DATE_LIKE)}"
        f" AND NOT ({kind} IN ('id', 'code', 'reference', 'phone') AND char_length({x}) < {rules.min_digits}"
        f" AND {x} rlike {raw(r'^\p{Nd}+$')})"
        f" AND NOT ({kind} = 'name' AND char_length({x}) < {rules.min_name_chars}))"
    )


def specificity(x: str, kind: str) -> str:
    """3 for values that are nearly unique by form, down to 1 for short common ones."""
    mixed = f"({x} rlike {raw(r'\p{L}')} AND {x} rlike {raw(r'\p{Nd}')})"
    return when(
        (f"{kind} IN ('email', 'phone', 'url', 'uuid')", "3"),
        (f"{kind} IN ('id', 'code', 'reference', 'labeled_value')",
         f"if(char_length({x}) >= 8 OR {mixed}, 3, 2)"),
        otherwise=f"if(char_length({x}) >= 8, 2, 1)",
    )


# Entity patterns.
UUID = r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![0-9a-f])"
EMAIL = r"(?iU)(?<![\w.+-])[\w.+-]{1,64}@[a-z0-9-]+(?:\.[a-z0-9-]+)+(?![\w.-])"
PHONE = r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)"
URL = r"(?iU)https?://[^\s<>\"']{6,300}"
LABELED = r"(?U)([A-Za-z一-鿿][A-Za-z0-9_一-鿿 -]{1,30})\s*[:：#]\s*([A-Za-z0-9][A-Za-z0-9_./-]{3,80})"
TRAILING = r"[.,;:!?，。；：！？)]+$"


def text_entities(x: str) -> str:
    """Array of (source_kind, label, value): e-mails, phones, links, UUIDs and labelled values of a text.

    `describe_entities` turns the exploded rows into kinds, fingerprints and previews.
    """

    def found(pattern: str, group: int, needs: str) -> str:
        # a cheap test for what every match must hold spares most texts the pattern
        return f"if({needs}, regexp_extract_all({x}, {raw(pattern)}, {group}), cast(array() AS array<string>))"

    def plain(kind: str, pattern: str, needs: str) -> str:
        value = normalize_value(replace_all("m", TRAILING), ascii_only=True)
        return (
            f"transform({found(pattern, 0, needs)},"
            f" m -> named_struct('source_kind', '{kind}', 'label', '{kind}', 'value', {value}))"
        )

    marked = f"(contains({x}, ':') OR contains({x}, '：') OR contains({x}, '#'))"
    pairs = (
        f"zip_with({found(LABELED, 1, marked)}, {found(LABELED, 2, marked)},"
        f" (l, v) -> named_struct('source_kind', 'label', 'label', l, 'value', {normalize_value('v', ascii_only=True)}))"
    )
    parts = [
        plain("uuid", UUID, f"contains({x}, '-')"), plain("email", EMAIL, f"contains({x}, '@')"),
        plain("phone", PHONE, f"contains({x}, '1')"), plain("url", URL, f"contains({x}, '://')"), pairs,
    ]
    return f"concat({', '.join(parts)})"


def describe_entities(df, rules: HeaderRules = HeaderRules()):
    """Adds kind, base, fingerprint, preview and specificity to rows of (source_kind, label, value)."""
    labeled = "source_kind = 'label'"
    keyed = df.selectExpr("*", f"if({labeled}, {header_key('label', rules)}, source_kind) AS key")
    kinds = keyed.selectExpr("*", f"{header_kind('key', rules)} AS header_kind")
    return kinds.selectExpr(
        "*",
        when((f"NOT {labeled}", "source_kind"), ("header_kind = 'other'", "'labeled_value'"), otherwise="header_kind")
        + " AS kind",
        f"if({labeled}, {header_base('key', 'header_kind', rules)}, source_kind) AS base",
        f"{fingerprint('value')} AS fingerprint",
    ).selectExpr(
        "* EXCEPT (header_kind, source_kind)",
        f"{safe_preview('kind', 'value')} AS preview",
        f"{specificity('value', 'kind')} AS specificity",
    )


def record_like_name(x: str) -> str:
    """True for a name that looks like a value or a code rather than a concept."""
    packed = replace_all(x, r"(?U)\s+")
    digits = f"char_length({replace_all(packed, r'(?U)[^\d]+')})"
    return (
        f"(trim({x}) = '' OR trim({x}) rlike {raw(r'^[0-9][0-9,./:\- ]*$')}"
        f" OR trim({x}) rlike {raw(r'(?i)^[0-9a-f]{8}-[0-9a-f-]{27,}$')}"
        f" OR (char_length({packed}) >= 9 AND {digits} >= 0.5D * char_length({packed}))"
        f" OR (char_length({packed}) >= 10 AND {digits} > 0 AND {packed} rlike {raw(r'^[A-Za-z0-9_.:/\-]+$')}))"
    )


def heading_like(x: str) -> str:
    pattern = r"^(?:#{1,6}\s+|\d+(?:\.\d+)*[.)、\s]|[一二三四五六七八九十]+[、.]|[-*•]\s+)"
    return f"(char_length(trim({x})) BETWEEN 2 AND 100 AND trim({x}) rlike {raw(pattern)})"
