"""Chat records of many layouts as canonical turns, and their training format.

A record's layout is told by its schema fingerprint: the hash of its nested field paths, without fields that say
nothing of the conversation. Each registered layout is a declarative mapping, SQL text that makes (role, text) turns.
Turns are formatted by SQL expressions one by one, so a conversation of any length is never one value; what has to be read
in order (a digest over a conversation) streams over sorted rows with a constant amount of state.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
# Names of fields that make up a layout, and of roles.
KNOWN = (
    "turn", "role", "text", "messages[].role", "messages[].content", "conversations[].from", "conversations[].value", "prompt", "response",
    "completion", "instruction", "input", "output", "question", "answer", "system",
)
ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}


def layout_fingerprint(paths) -> str:
    """Hash of a set of nested field paths; those that are not part of a conversation don't count."""
    return hashlib.sha1("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


def schema_paths(schema: T.DataType, before: str = "") -> list[str]:
    """Nested field paths of a schema: `a`, `a.b` in a struct, `a[].b` in an array of structs."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{before}.{f.name}" if before else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, before + "[]")
    return [before]


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', CAST({text} AS string))"


def _from(items: str, role: str, text: str) -> str:
    return f"transform({items}, m -> {_turn(f'm.{role}', f'm.{text}')})"


def _asked(question: str, answer: str, system: str | None = None) -> str:
    turns = [_turn("'user'", question), _turn("'assistant'", answer)]
    return f"array({', '.join(([_turn(chr(39) + 'system' + chr(39), system)] if system else []) + turns)})"


_INSTRUCTED = "IF(coalesce(input, '') = '', instruction, concat(instruction, '\\n\\n', input))"
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].role", "messages[].content"), _from("messages", "role", "content")),
    "from and value": (("conversations[].from", "conversations[].value"), _from("conversations", "from", "value")),
    "prompt and response": (("prompt", "response"), _asked("prompt", "response")),
    "prompt and completion": (("prompt", "completion"), _asked("prompt", "completion")),
    "system, prompt and response": (("system", "prompt", "response"), _asked("prompt", "response", "system")),
    "instruction and output": (("instruction", "output"), _asked("instruction", "output")),
    "instruction, input and output": (("instruction", "input", "output"), _asked(_INSTRUCTED, "output")),
    "question and answer": (("question", "answer"), _asked("question", "answer")),
}
BY_FINGERPRINT = {layout_fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}
ROW_LAYOUT = layout_fingerprint(("turn", "role", "text"))
JSON_FIELDS = (
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, prompt string, "
    "response string, completion string, instruction string, input string, output string, question string, answer string, system string"
)


def _role(role: str) -> str:
    """A role by its usual name; unknown ones in lower case, NULL as the empty role."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items())
    return f"CASE lower(coalesce({role}, '')) {cases} ELSE lower(coalesce({role}, '')) END"


def _exploded(records: DataFrame, key: str, turns: str) -> DataFrame:
    return records.selectExpr(f"`{key}` AS conv_id", f"posexplode({turns}) AS (turn, t)").selectExpr(
        "conv_id", "bigint(turn) AS turn", f"{_role('t.role')} AS role", "coalesce(t.text, '') AS text"
    )


def canonical_turns(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from a frame of one layout: rows a turn, or a layout of LAYOUTS.

    The mapping is chosen by the fingerprint of the frame's schema; an unknown one is an error that names its paths. Rows a
    turn are canonical but for NULLs and keep their roles; other layouts get roles by their usual names. NULL texts are empty, further columns are left out, repeated rows stay repeated.
    """
    paths = [p for p in schema_paths(records.schema) if p != key]
    found = layout_fingerprint(paths)
    if found == ROW_LAYOUT:
        return records.selectExpr(f"`{key}` AS conv_id", "bigint(turn) AS turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    if found not in BY_FINGERPRINT:
        raise ValueError(f"no layout for the fields {sorted(set(paths) & set(KNOWN))}")
    return _exploded(records, key, LAYOUTS[BY_FINGERPRINT[found]][1])


def record_fingerprint(record: str) -> Column:
    """Fingerprint of a JSON record: its keys, with those of the first element where a value is a list of objects."""
    known = ", ".join(f"'{p}'" for p in KNOWN)
    nested = " , ".join(
        f"transform(coalesce(json_object_keys(get_json_object({record}, '$.{field}[0]')), array()), k -> concat('{field}[].', k))"
        for field in ("messages", "conversations")
    )
    paths = f"concat(coalesce(json_object_keys({record}), array()), {nested})"
    return F.expr(f"sha1(array_join(array_sort(array_intersect(array_distinct({paths}), array({known}))), '\\n'))")


def canonical_records(records: DataFrame, key: str = "conv_id", record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(turns, unmatched) of JSON records of mixed layouts: each record is mapped by its own fingerprint.

    Records that are NULL, malformed or of no registered layout come back in `unmatched` (key, record, fingerprint).
    """
    named = records.select(F.col(key), F.col(record), record_fingerprint(record).alias("fingerprint"))
    turns = "CASE fingerprint " + " ".join(f"WHEN '{f}' THEN {LAYOUTS[n][1]}" for f, n in BY_FINGERPRINT.items()) + " END"
    read = named.withColumn("__fields", F.from_json(record, JSON_FIELDS)).select(key, "fingerprint", "__fields.*")
    known = list(BY_FINGERPRINT)
    unmatched = named.where(F.coalesce(~F.col("fingerprint").isin(known), F.lit(True)))
    return _exploded(read.where(F.col("fingerprint").isin(known)), key, turns), unmatched


# A control string can't stand in an escaped text: `<` and `|` get one backslash more between them than they had.
ESCAPE = ("<(\\\\*)\\|", "<$1\\\\|")
UNESCAPE = re.compile(r"<\\(\\*)\|")
ROLE_ESCAPES = re.compile(r"\\(n|\\)")
FORMATTED = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def _escaped(text: str) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def unescaped_role(role: str) -> str:
    """A role as it was: line ends and backslashes are escaped in roles, beside control strings."""
    return unescaped(ROLE_ESCAPES.sub(lambda m: "\n" if m[1] == "n" else "\\", role))


def formatted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_from, loss_to): each turn as `<|im_start|>role\\ntext<|im_end|>\\n`, and the half-open range
    of its code points that are trained on (the assistant's texts; else empty, from 0 to 0).

    In roles a line feed is written as `\\n` and a backslash twice, so that they can be read back. Joined in turn order,
    the pieces of a conversation are its training text.
    """
    role = F.replace(F.replace(_escaped("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    rows = turns.select("conv_id", "turn", "role", role.alias("__role"), _escaped("text").alias("__text"))
    begin = F.length("__role") + len(START) + 1
    loss = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "turn", F.concat(F.lit(START), "__role", F.lit("\n"), "__text", F.lit(END + "\n")).alias("formatted"),
        F.when(loss, begin).otherwise(0).alias("loss_from"), F.when(loss, begin + F.length("__text")).otherwise(0).alias("loss_to"),
    )


@dataclass
class _Reading:
    """What has been read of one conversation."""

    turns: int = 0
    chars: int = 0
    loss_chars: int = 0

    def __post_init__(self):
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_from: int, loss_to: int) -> None:
        self.chars += len(formatted)
        trained = unescaped(formatted[loss_from:loss_to])
        self.loss_chars += len(trained)
        self.loss.update(trained.encode())
        for role, text in FORMATTED.findall(formatted):
            self.turns += 1
            self.text.update(f"{unescaped_role(role)}\n{unescaped(text)}\n".encode())


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) as read from formatted pieces.

    Rows go to a partition by conversation and are sorted there by turn (ties by the piece itself); the reader holds two
    digests and one batch, so a conversation of a third of all turns needs no more memory than a short one. SHA-256 can
    only be taken in order, so such a conversation is one task's stream.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        def done() -> tuple:
            return (at, now.turns, now.text.hexdigest(), now.loss_chars, now.loss.hexdigest(), now.chars)

        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")]
            for conv, formatted, loss_from, loss_to in zip(*columns, strict=True):
                if now is None or conv != at:
                    if now is not None:
                        rows.append(done())
                    at, now = conv, _Reading()
                now.add(formatted, loss_from, loss_to)
            if rows:
                yield out(rows)
        if now is not None:
            yield out([done()])

    dealt = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "formatted", "loss_from", "loss_to")
    return dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
