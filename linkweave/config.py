"""Limits, marker lists and value rules. Every operator takes these as parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Bounds that are part of the results (sample sizes, evidence kept, page sizes)."""

    seed_cell_budget: int = 100_000
    seed_file_bytes: int = 8 * 1024 * 1024
    seed_values_per_column: int = 256
    max_seed_values: int = 20_000
    sources_per_seed_value: int = 4
    max_text_seeds: int = 2_000
    profile_size: int = 128
    frontier_values_per_column: int = 128
    min_expansion_distinct_ratio: float = 0.01
    max_matches_per_seed: int = 50
    bootstrap_rows: int = 1_000
    evidence_per_relation: int = 12
    cards_per_file: int = 40
    max_cards: int = 1_000
    brief_cards: int = 40
    brief_statements: int = 8
    snippet_chars: int = 320
    statement_chars: int = 480
    preview_rows: int = 20
    preview_columns: int = 80
    preview_text_bytes: int = 2 * 1024 * 1024
    page_size: int = 20
    history_chars: int = 32_000
    message_chars: int = 12_000
    graph_nodes: int = 10
    graph_edges: int = 14
    graph_branches: int = 3


# Header markers, tested as substrings of the normalised header, in this order.
@dataclass(frozen=True)
class HeaderRules:
    email: tuple[str, ...] = ("email", "邮箱", "邮件地址")
    phone: tuple[str, ...] = ("phone", "mobile", "tel", "手机号", "联系电话", "电话")
    url: tuple[str, ...] = ("url", "uri", "网址", "链接")
    id: tuple[str, ...] = ("identifier", "uuid", "编号", "号码", "主键", "外键", "id")
    code: tuple[str, ...] = ("code", "编码", "代码")
    reference: tuple[str, ...] = (
        "parent", "source", "target", "from", "to", "父", "上级", "来源", "目标", "引用", "关联",
    )
    name: tuple[str, ...] = ("name", "title", "名称", "标题")
    header_prefix: str = ""
    """Regex removed from the start of a raw header before it is read ('' keeps the header whole)."""


@dataclass(frozen=True)
class ValueRules:
    min_digits: int = 6
    max_chars: int = 256
    min_name_chars: int = 3


JOIN_KINDS = ("id", "code", "email", "phone", "url", "reference", "name")

WAREHOUSE_HEADERS = HeaderRules(
    id=("identifier", "uuid", "编号", "号码", "主键", "外键", "key", "id"),
    header_prefix="^[a-z]{1,2}_",
)
"""Rules for star-schema tables: `*key` columns are ids and `c_`-style prefixes are ignored."""

WAREHOUSE_VALUES = ValueRules(min_digits=1)
"""Small surrogate keys are real join values in a warehouse."""
