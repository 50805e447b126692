"""What a column header says: its kind, its base word, its business role, and how two headers agree.

Expression text in, expression text out; header text is in NFKC form already.
"""

from __future__ import annotations

import re

from linkweave.config import HeaderRules
from linkweave.functions.text import (
    contains_any,
    count_of,
    normalize_name,
    quote,
    quoted,
    replace_all,
    when,
)

KEYED = ("id", "code", "reference")
CONTACT = ("email", "phone", "url")


def header_key(header: str, rules: HeaderRules = HeaderRules()) -> str:
    """Comparable form of a header."""
    if rules.header_prefix:
        header = replace_all(header, rules.header_prefix)
    return normalize_name(header)


def header_kind(key: str, rules: HeaderRules = HeaderRules()) -> str:
    """Kind of a header key; the first rule that matches wins."""
    refers = contains_any(key, rules.reference)
    return when(
        (contains_any(key, rules.email), "'email'"),
        (contains_any(key, rules.phone), "'phone'"),
        (contains_any(key, rules.url), "'url'"),
        (f"{contains_any(key, rules.id)} AND {refers}", "'reference'"),
        (contains_any(key, rules.id), "'id'"),
        (contains_any(key, rules.code), "'code'"),
        (refers, "'reference'"),
        (contains_any(key, rules.name), "'name'"),
        otherwise="'other'",
    )


def header_base(key: str, kind: str, rules: HeaderRules = HeaderRules()) -> str:
    """What is left of a header key without the markers of its kind."""

    def without(markers) -> str:
        return replace_all(key, "|".join(re.escape(m) for m in markers))

    def peeled(markers) -> str:
        text = key
        for marker in sorted(markers, key=len, reverse=True):
            text = f"replace({text}, {quote(marker)}, '')"
        return text

    return when(
        (f"{kind} = 'email'", without(rules.email)),
        (f"{kind} = 'phone'", without(rules.phone)),
        (f"{kind} = 'url'", without(rules.url)),
        (f"{kind} IN ('id', 'reference') AND {contains_any(key, rules.id)}", peeled(rules.id)),
        (f"{kind} = 'code'", peeled(rules.code)),
        (f"{kind} = 'name'", peeled(rules.name)),
        otherwise=key,
    )


def compatibility(left: str, right: str) -> str:
    """How well two columns agree by header alone, 0 to 1; `left` and `right` prefix key, kind, base."""
    lk, ld, lb = (f"{left}_{c}" for c in ("key", "kind", "base"))
    rk, rd, rb = (f"{right}_{c}" for c in ("key", "kind", "base"))
    return when(
        (f"{lk} <> '' AND {lk} = {rk}", "1.0D"),
        (f"{lb} <> '' AND {lb} = {rb}", "0.96D"),
        (f"{ld} = {rd} AND {ld} IN ({quoted(CONTACT)})", "0.95D"),
        (f"{ld} = {rd} AND {ld} IN ({quoted(KEYED)})", "0.82D"),
        (f"{ld} IN ({quoted(KEYED)}) AND {rd} IN ({quoted(KEYED)})", "0.72D"),
        (f"{ld} = 'name' AND {rd} = 'name' AND {lb} <> '' AND {rb} <> ''", "0.76D"),
        otherwise="0.0D",
    )


def compatibility_groups(key: str = "key", kind: str = "kind", base: str = "base") -> str:
    """Array of (label, score): two columns agree by the best score among labels they share."""
    entries = (
        (f"{key} <> ''", f"concat('header:', {key})", 1.0),
        (f"{base} <> ''", f"concat('base:', {base})", 0.96),
        (f"{kind} IN ({quoted(CONTACT)})", f"concat('kind:', {kind})", 0.95),
        (f"{kind} IN ({quoted(KEYED)})", f"concat('kind:', {kind})", 0.82),
        (f"{kind} IN ({quoted(KEYED)})", "'keyed'", 0.72),
        (f"{kind} = 'name' AND {base} <> ''", "'kind:name'", 0.76),
    )
    items = ", ".join(f"if({c}, named_struct('label', {label}, 'score', {s}D), NULL)" for c, label, s in entries)
    return f"filter(array({items}), e -> e IS NOT NULL)"


# Role markers of headers; ties go to the role named first.
ROLE_MARKERS: dict[str, tuple[str, ...]] = {
    "actor": (
        "actor", "user", "customer", "patient", "employee", "owner", "operator", "provider",
        "person", "member", "organization", "department", "staff", "角色", "用户", "客户",
        "患者", "人员", "职工", "操作人", "经办人", "机构", "组织", "部门", "医生", "员工",
    ),
    "time": (
        "date", "time", "year", "month", "day", "created", "updated", "start", "end",
        "日期", "时间", "年度", "月份", "创建", "更新", "开始", "结束", "发生时间",
    ),
    "state": (
        "status", "state", "result", "outcome", "flag", "enabled", "valid", "状态", "结果",
        "结论", "标志", "是否", "有效", "阶段", "进度",
    ),
    "input": (
        "input", "request", "application", "source", "form", "payload", "origin", "输入",
        "请求", "申请", "来源", "表单", "原始", "入参", "材料",
    ),
    "output": (
        "output", "response", "report", "receipt", "notice", "输出", "响应", "报告", "回执",
        "通知", "清单", "结果",
    ),
    "rule": (
        "rule", "policy", "condition", "threshold", "limit", "ratio", "standard", "config",
        "规则", "政策", "条件", "阈值", "限额", "比例", "标准", "配置", "口径",
    ),
    "decision": (
        "approve", "approval", "audit", "review", "reject", "decision", "verify", "check",
        "审批", "审核", "复核", "拒绝", "判定", "校验", "检查", "通过",
    ),
    "measure": (
        "amount", "price", "quantity", "count", "rate", "score", "total", "cost", "fee",
        "金额", "价格", "数量", "次数", "比例", "分值", "总额", "成本", "费用",
    ),
}


def business_role(key: str) -> str:
    """Role with the most markers in a header key; 'object' where no marker fits."""
    counts = {role: count_of(key, markers) for role, markers in ROLE_MARKERS.items()}
    # array_position finds the first role that reaches the maximum, which settles ties
    scores = f"array({', '.join(counts.values())})"
    roles = f"array({quoted(counts)})"
    pick = f"element_at({roles}, int(array_position(s, array_max(s))))"
    return f"element_at(transform(array({scores}), s -> if(array_max(s) = 0, 'object', {pick})), 1)"


# Words that mark a table as rule material.
RULE_MATERIAL = ("rule", "policy", "规则", "政策", "配置")


def material_role(names: str) -> str:
    """Role of a whole table from `n_<role>`, the number of columns it has of each role."""
    return when(
        (contains_any(names, RULE_MATERIAL), "'rule_or_policy_material'"),
        ("n_decision > 0", "'decision_or_validation_record'"),
        ("n_output > 0 AND n_state > 0", "'result_or_outcome_record'"),
        ("n_measure > 0 AND n_state > 0", "'transaction_or_outcome_record'"),
        ("n_time > 0 AND (n_actor > 0 OR n_state > 0)", "'event_or_activity_record'"),
        ("n_input > 0", "'input_or_request_material'"),
        ("n_rule >= 3", "'rule_or_policy_material'"),
        ("n_measure > 0", "'measurement_or_transaction_record'"),
        otherwise="'business_object_record'",
    )
