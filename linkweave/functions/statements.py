"""Sentences that state a relationship: splitting, tokens, markers and scores.

Expression text in, expression text out.
"""

from __future__ import annotations

from linkweave.functions.text import SPACE, casefold, contains_any, cut, flat_text, quoted, raw, replace_all

# Words that state a relationship.
RELATION_MARKERS = (
    "requires", "required by", "depends on", "based on", "according to", "produces",
    "generates", "submits", "approves", "rejects", "triggers", "before", "after",
    "if ", "then", "uses", "contains", "belongs to", "results in", "maps to", "sends",
    "receives", "updates", "returns", "validates", "transforms", "flows to", "followed by",
    "依赖", "需要", "依据", "根据", "生成", "产生", "提交", "审批", "审核", "拒绝",
    "触发", "之前", "之后", "如果", "使用", "包含", "属于", "导致", "映射",
    "发送", "接收", "更新", "返回", "校验", "验证", "转换", "流转", "进入", "输出",
    "定位", "选择", "决定", "调用", "获取",
    "不得", "禁止", "必须", "应当", "不可", "重复收费", "同时收取", "对应", "违规",
    "异常", "判断", "筛查", "核查", "匹配", "must", "shall", "cannot", "may not",
)
# Words that state an order.
SEQUENCE_MARKERS = (
    "triggers", "before", "after", "then", "followed by", "flows to", "returns",
    "触发", "之前", "之后", "随后", "然后", "流转", "进入", "返回",
)
# Words that state a condition.
BRANCH_MARKERS = (
    "if ", "otherwise", "else", "when", "unless", "approve", "reject",
    "如果", "否则", "当", "除非", "审批", "审核", "拒绝", "通过", "不通过",
)
# Tokens too common to align two materials.
COMMON_TOKENS = (
    "xlsx", "csv", "table", "重复", "复收", "收费", "同时", "收取", "费用", "规则", "结果", "明细",
)

_STOPS = ".!?。！？；;"


def split_statements(x: str, commas: bool = False, limit: int = 320) -> str:
    """Array of statements of six characters or more; `commas` also splits at commas."""
    stops = _STOPS + "，," if commas else _STOPS
    parts = f"split({x}, {raw('(?<=[' + stops + '])' + chr(92) + 's*|[' + chr(92) + 'r' + chr(92) + 'n]+')})"
    # most parts have single blanks only, which stay as they are
    odd = f"contains(p, '  ') OR p rlike {raw(SPACE.replace(chr(92) + 'x20', chr(92) + 'x1f'))}"
    flat = f"filter(transform({parts}, p -> if({odd}, {flat_text('p')}, trim(p))), p -> char_length(p) >= 6)"
    return f"transform({flat}, p -> {cut('p', limit)})"


def relation_tokens(x: str) -> str:
    """Distinct words of three characters or more and pairs of neighbouring CJK characters."""
    chinese = replace_all(x, "[^一-鿿]+")
    size = f"char_length({chinese})"
    pairs = (
        f"if({size} > 1, transform(sequence(1, greatest({size} - 1, 1)), i -> substring({chinese}, i, 2)),"
        " cast(array() as array<string>))"
    )
    words = f"regexp_extract_all({casefold(x)}, '[a-z0-9]{{3,}}', 0)"
    return f"array_except(array_union({words}, {pairs}), array({quoted(COMMON_TOKENS)}))"


def relation_markers(folded: str, limit: int = 12) -> str:
    """Sorted markers present in a case-folded statement."""
    return f"slice(array_sort(filter(array({quoted(RELATION_MARKERS)}), m -> contains({folded}, m))), 1, {limit})"


def _present(folded: str, markers: tuple[str, ...]) -> str:
    """How many of the markers a statement holds. A list and one test of it, for a sum of a hundred tests makes a method that the JVM does
    not compile; markers beyond ASCII are looked for only in statements beyond ASCII."""
    plain, other = ([m for m in markers if m.isascii() is ascii_only] for ascii_only in (True, False))
    found = [f"size(filter(array({quoted(some)}), m -> contains({folded}, m)))" for some in (plain, other) if some]
    if other:
        found[-1] = f"if(octet_length({folded}) > char_length({folded}), {found[-1]}, 0)"
    return "(" + " + ".join(found) + ")"


def marker_score(folded: str) -> str:
    """Three for each relation marker, two for any order word, two for any condition word."""
    return (
        f"(3 * {_present(folded, RELATION_MARKERS)} + 2 * int({_present(folded, SEQUENCE_MARKERS)} > 0)"
        f" + 2 * int({_present(folded, BRANCH_MARKERS)} > 0))"
    )


def ordering_signal(folded: str) -> str:
    """True where a statement holds an order or a condition word."""
    return contains_any(folded, SEQUENCE_MARKERS + BRANCH_MARKERS)
