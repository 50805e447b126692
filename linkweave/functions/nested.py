"""Rules for nested values: a walk over the type of a column writes one expression for all its levels, whatever their number."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from linkweave.functions.text import MASK, SENSITIVE_WORD, bounded_list, bounded_text, quote, raw


def _step(x: str, name: str) -> str:
    return f"{x}.`{name.replace('`', '``')}`"


def _masked(x: str, dtype: T.DataType) -> str:
    """The mask in place of a text; other values that must not be seen become NULL."""
    return f"if({x} IS NULL, NULL, '{MASK}')" if isinstance(dtype, T.StringType) else f"cast(NULL AS {dtype.simpleString()})"


def redacted(x: str, dtype: T.DataType, parent: str = "", depth: int = 0) -> str:
    """A value of any depth with its secrets masked.

    Below `headers` every value is one; a text is one if its key names a secret, below `env` also if the key has such a name in it.
    Lists hand the key they stand under down to their elements.
    """
    parent = parent.lower()
    if isinstance(dtype, T.ArrayType):
        return f"transform({x}, e{depth} -> {redacted(f'e{depth}', dtype.elementType, parent, depth + 1)})"
    if isinstance(dtype, T.StructType):
        parts = []
        for field in dtype.fields:
            at = _step(x, field.name)
            named = re.search(SENSITIVE_WORD, field.name) if parent == "env" else re.fullmatch(SENSITIVE_WORD, field.name)
            secret = parent == "headers" or (isinstance(field.dataType, T.StringType) and named)
            parts.append(f"{quote(field.name)}, {_masked(at, field.dataType) if secret else redacted(at, field.dataType, field.name, depth)}")
        return f"if({x} IS NULL, NULL, named_struct({', '.join(parts)}))"
    if isinstance(dtype, T.MapType):
        k, v = f"k{depth}", f"v{depth}"
        if parent == "headers":
            return f"transform_values({x}, ({k}, {v}) -> {_masked(v, dtype.valueType)})"
        if isinstance(dtype.valueType, T.StringType):
            pattern = SENSITIVE_WORD if parent == "env" else f"^(?:{SENSITIVE_WORD})$"
            inner = f"if({k} rlike {raw(pattern)}, {_masked(v, dtype.valueType)}, {v})"
        else:
            ways = {p: redacted(v, dtype.valueType, p, depth + 1) for p in ("headers", "env", "")}
            inner = f"CASE lower({k}) WHEN 'headers' THEN {ways['headers']} WHEN 'env' THEN {ways['env']} ELSE {ways['']} END"
        return f"transform_values({x}, ({k}, {v}) -> {inner})"
    return x


def bounded(x: str, dtype: T.DataType, limit: int = 50, text_limit: int = 4000, depth: int = 0) -> str:
    """A value of any depth with long texts cut and long lists ended by a note of how many are left out.

    The note is a text, so a list of other things becomes one of their JSON texts, if it is that long or not.
    """
    if isinstance(dtype, T.StringType):
        return bounded_text(x, text_limit)
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StringType):
            return f"if({x} IS NULL, NULL, {bounded_list(x, limit, text_limit)})"
        inner = bounded(f"e{depth}", dtype.elementType, limit, text_limit, depth + 1)
        element = f"to_json({inner})" if isinstance(dtype.elementType, (T.StructType, T.MapType, T.ArrayType)) else f"string({inner})"
        kept = f"transform(slice({x}, 1, {limit}), e{depth} -> {element})"
        more = f"array(concat('[', string(size({x}) - {limit}), ' more items omitted]'))"
        return f"if(size({x}) > {limit}, concat({kept}, {more}), {kept})"
    if isinstance(dtype, T.StructType):
        parts = [f"{quote(f.name)}, {bounded(_step(x, f.name), f.dataType, limit, text_limit, depth)}" for f in dtype.fields]
        return f"if({x} IS NULL, NULL, named_struct({', '.join(parts)}))"
    if isinstance(dtype, T.MapType):
        return f"transform_values({x}, (k{depth}, v{depth}) -> {bounded(f'v{depth}', dtype.valueType, limit, text_limit, depth + 1)})"
    return x
