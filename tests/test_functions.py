"""Golden values of text, header, value and statement expressions."""

import unicodedata

from pyspark.sql import types as T

from linkweave.config import HeaderRules, ValueRules
from linkweave.functions import statements as S
from linkweave.functions import text as X
from linkweave.functions.headers import business_role
from linkweave.functions.values import (
    describe_entities,
    heading_like,
    record_like_name,
    specificity,
    text_entities,
    valid_join_value,
)
from linkweave.sources.catalog import column_meaning, unique_headers


def one(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).selectExpr(*exprs).collect()]


def test_header_kinds(spark):
    want = {
        "Email": ("email", ""), "Mobile No": ("phone", "no"), "profile_url": ("url", "profile"),
        "order_id": ("id", "order"), "parent_id": ("reference", "parent"), "dept code": ("code", "dept"),
        "source": ("reference", "source"), "product name": ("name", "product"), "amount": ("other", "amount"),
        "": ("other", ""), "客户编号": ("id", "客户"), "customer_id": ("reference", "customer"),
    }
    df = spark.createDataFrame([(h,) for h in want], "name string")
    got = {r["name"]: (r["kind"], r["base"]) for r in column_meaning(df).collect()}
    assert got == want


def test_header_rules_are_parameters(spark):
    df = spark.createDataFrame([("c_custkey",)], "name string")
    rules = HeaderRules(id=("key", "id"), header_prefix="^[a-z]{1,2}_")
    row = column_meaning(df, rules).first()
    assert (row["key"], row["kind"], row["base"]) == ("custkey", "id", "cust")


def test_repeated_headers(spark):
    rows = [("t", i, h) for i, h in enumerate(["a", "a", " ", "a"])]
    df = spark.createDataFrame(rows, "table string, position int, header string")
    first = [r["query_name"] for r in unique_headers(df).orderBy("position").collect()]
    second = [r["query_name"] for r in unique_headers(df, 2).orderBy("position").collect()]
    assert first == ["a", "a_1", "column_3", "a_2"]
    assert second == ["a", "a_2", "column_3", "a_3"]


def test_join_values(spark):
    cases = [
        ("id", "12345", False), ("id", "123456", True), ("name", "ab", False), ("id", "2024-01-01T10:00", False),
        ("id", "2024-01-01 10:00", True), ("code", "N/A", False), ("other", "x", False), ("id", "", False),
        ("id", "x" * 257, False), ("code", "未知", False),
    ]
    rows = one(spark, [c[:2] for c in cases], "kind string, raw string", "kind", f"{X.normalize_value('raw')} AS v")
    valid = one(spark, rows, "kind string, v string", valid_join_value("v", "kind"))
    assert [v[0] for v in valid] == [c[2] for c in cases]
    assert one(spark, [("id", "7")], "kind string, v string", valid_join_value("v", "kind", ValueRules(min_digits=1))) == [(True,)]


def test_specificity(spark):
    cases = [("id", "1234567", 2), ("id", "12345678", 3), ("id", "a1", 3), ("name", "abcdefgh", 2), ("name", "abc", 1), ("email", "a", 3)]
    got = one(spark, [c[:2] for c in cases], "kind string, v string", specificity("v", "kind"))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_previews(spark):
    cases = [
        ("name", "x" * 80, "x" * 72 + "..."), ("email", "ann@x.org", "a***@x.org"), ("email", "@x.org", "***@x.org"),
        ("id", "abcd", "****"), ("id", "abcdefgh", "a***h"), ("id", "abcdefghijkl", "abcd...ijkl"), ("id", "", ""),
    ]
    got = one(spark, [c[:2] for c in cases], "kind string, v string", X.safe_preview("kind", "v"))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_folding_is_pythons(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁn", "İstanbul", "ŉ", "MASSE", "ſ", "ẞ", "Éa", "规则A"]
    got = one(spark, [(w,) for w in words], "w string", X.casefold("w"))
    assert [g[0] for g in got] == [w.casefold() for w in words]


def test_nfkc_then_fold(spark):
    words = ["Ａｂ　１２", "ﬁ x", "é", "plain Text", "²"]
    df = X.with_nfkc(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    got = [r[0] for r in df.selectExpr(X.normalize_value("w")).collect()]
    assert got == ["".join(unicodedata.normalize("NFKC", w).split()).casefold() for w in words]


def test_numbers_read_as_python_prints_them(spark):
    values = [0.0, 1.5, 12345678.0, 12345678.25, 0.0005, -3.0, 1e15, 112946.26]
    got = one(spark, [(v,) for v in values], "v double", X.stringify("v", T.DoubleType()))
    assert [g[0] for g in got] == ["" if v == 0 else str(v) for v in values]
    assert one(spark, [(0,), (7,)], "v long", X.stringify("v", T.LongType())) == [("",), ("7",)]


def test_utf8_cut(spark):
    text = "aé规😀b"
    for limit in range(0, 12):
        got = one(spark, [(text,)], "t string", X.truncate_utf8("t", limit))[0][0]
        assert got == text.encode()[:limit].decode("utf-8", errors="ignore")


def test_thinking_markup(spark):
    rows = one(spark, [("a<think>x</THINK>b<think>y",)], "t string", X.strip_thinking("t"), X.reasoning_parts("t"))
    assert rows == [("aby", ["x", "y"])]


def test_secrets(spark):
    assert one(spark, [("tok abc123 abc",)], "t string", X.redact_values("t", ["abc", "abc123"])) == [("tok ******** ********",)]
    got = one(spark, [({"API-key": "s", "user": "u"},)], "m map<string,string>", X.redact_map("m"))[0][0]
    assert got == {"API-key": "********", "user": "u"}


def test_bounded_values(spark):
    got = one(spark, [("x" * 5, [str(i) for i in range(4)])], "t string, l array<string>", X.bounded_text("t", 3), X.bounded_list("l", 2))
    assert got == [("xxx\n[truncated]", ["0", "1", "[2 more items omitted]"])]


def test_statements(spark):
    text = "If A then B. C produces D; short"
    parts = one(spark, [(text,), ("结算依据规则。",)], "t string", S.split_statements("t"))
    assert parts == [(["If A then B.", "C produces D;"],), (["结算依据规则。"],)]
    scores = one(spark, [("if a then b.",), ("c produces d;",), ("结算依据规则。",)], "f string", S.marker_score("f"))
    assert [s[0] for s in scores] == [10, 3, 3]
    assert one(spark, [("if a then b.",)], "f string", S.relation_markers("f")) == [(["if ", "then"],)]


def test_tokens(spark):
    got = one(spark, [("Rates CSV 2024 结算依据",)], "t string", f"array_sort({S.relation_tokens('t')})")[0][0]
    assert got == sorted(["rates", "2024", "结算", "算依", "依据"])


def test_entities(spark):
    text = "id 123e4567-e89b-12d3-a456-426614174000, A.B@x.org, 13812345678 https://x.org/a). Order No: AB-1234"
    df = spark.createDataFrame([(text,)], "t string").selectExpr(f"inline({text_entities('t')})")
    rows = {(r["kind"], r["value"]) for r in describe_entities(df).collect()}
    assert {
        ("uuid", "123e4567-e89b-12d3-a456-426614174000"), ("email", "a.b@x.org"), ("phone", "13812345678"),
        ("url", "https://x.org/a"),
    } <= rows
    assert ("labeled_value", "ab-1234") in rows


def test_name_and_heading_tests(spark):
    names = ["12/34", "123e4567-e89b-12d3-a456-426614174000", "ab12345678", "Order intake", "", "X-1234567"]
    assert [r[0] for r in one(spark, [(n,) for n in names], "n string", record_like_name("n"))] == [True, True, True, False, True, True]
    lines = ["## Intake", "1. First", "- item", "plain", "#", "一、总则"]
    assert [r[0] for r in one(spark, [(n,) for n in lines], "n string", heading_like("n"))] == [True, True, True, False, False, True]


def test_business_roles(spark):
    heads = ["customername", "createdate", "status", "approvalresult", "totalamount", "foo", "orderdate"]
    assert [r[0] for r in one(spark, [(h,) for h in heads], "h string", business_role("h"))] == [
        "actor", "time", "state", "state", "measure", "object", "time",
    ]


def test_vector_search_of_many_queries(spark):
    """Exact in blocks, whatever their number, with ties by id; buckets find nine in ten of the same."""
    import numpy as np

    from linkweave.operators import search as R

    turn = np.random.default_rng(3)
    centres = turn.standard_normal((12, 16))
    x = np.vstack([centres[k % 12] + 0.6 * turn.standard_normal(16) for k in range(600)])
    x[40:60] = x[40]  # equal vectors
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, embedding array<double>").repartition(5)
    chunks = chunks.unionByName(spark.createDataFrame([(999, None)], chunks.schema))
    queries = chunks.where("chunk_id % 4 = 0").selectExpr("chunk_id AS query_id", "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 600, 4):
        s = np.round(unit @ unit[q], 6)
        want[q] = [(int(c), float(s[c])) for c in np.lexsort((np.arange(600), -s)) if c != q][:7]
    for block in (R.BLOCK_QUERIES, 20):
        R.BLOCK_QUERIES, kept = block, R.BLOCK_QUERIES
        exact = R.vector_top_k_many(chunks, queries, 7)
        got = {}
        for r in exact.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["similarity"]))
        R.BLOCK_QUERIES = kept
        assert got == want
    probed = R.vector_top_k_probed(chunks, queries, 7, rules=R.HyperplaneRules(bucket=16))
    found = R.vector_recall(exact, probed).first()
    assert found["wanted"] == 7 * 150 and found["recall"] >= 0.9
    assert R.vector_top_k_many(chunks, queries.limit(0), 7).count() == R.vector_top_k_probed(chunks.limit(0), queries, 7).count() == 0


def test_probed_lists_are_dealt_out(spark):
    """A list of very many equal vectors is spread over parts, a query goes to all parts of the lists it looks into, and no pair is a row."""
    import numpy as np

    from linkweave.operators import search as R

    turn = np.random.default_rng(5)
    x = np.vstack([np.tile(turn.standard_normal(8), (900, 1)), turn.standard_normal((300, 8))])
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, embedding array<double>").repartition(3)
    queries = chunks.where("chunk_id % 50 = 0").selectExpr("chunk_id AS query_id", "embedding")
    R.BLOCK_CHUNKS, kept = 200, R.BLOCK_CHUNKS
    plan = R.hyperplane_plan(R._vectors(chunks, "chunk_id"), R._vectors(queries, "query_id"), 5, R.HyperplaneRules())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = plan.chunk_parts(unit, np.arange(len(x)))
    row, part = plan.query_parts(unit[::50])
    assert np.bincount(parts).max() <= 2 * 200 and plan.sizes.sum() == len(x)
    assert len(row) <= len(unit[::50]) * len(np.unique(parts)) and len(set(zip(row, part))) == len(row)
    got = {}
    for r in R.vector_top_k_probed(chunks, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["similarity"]))
    R.BLOCK_CHUNKS = kept
    for q in range(0, 900, 50):  # copies of one vector, ties by id
        assert got[q] == [(c, 1.0) for c in range(6) if c != q][:5]
    assert set(got) == set(range(0, 1200, 50))


def test_probed_recall_of_vectors_without_structure(spark):
    """Vectors in no groups at all: the lists looked into still hold nine in ten of the exact neighbours."""
    import numpy as np

    from linkweave.operators import search as R

    x = np.random.default_rng(9).standard_normal((4000, 64))
    chunks = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4)
    queries = chunks.where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "embedding")
    rules = R.HyperplaneRules(bucket=16)
    found = R.vector_recall(R.vector_top_k_many(chunks, queries, 5), R.vector_top_k_probed(chunks, queries, 5, rules=rules)).first()
    assert found["wanted"] == 1000 and found["recall"] >= 0.9


def test_memory_of_a_meeting_is_bounded():
    """A full block of queries and part of chunks is worked out in steps: less than 150 MB, whatever their number."""
    import tracemalloc

    import numpy as np

    from linkweave.operators import search as R

    x = np.random.default_rng(2).standard_normal((20_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    q, c, s = R._nearest(np.arange(1024), x[:1024], np.arange(20_000), x, 5, lambda low, high: None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and (np.bincount(q) == 5).all()
    for n in (0, 77, 1023):
        scores = np.round(x @ x[n], 6)
        assert list(zip(c[q == n], s[q == n])) == [(k, scores[k]) for k in np.lexsort((np.arange(20_000), -scores)) if k != n][:5]


def plain(value):
    """Rows and maps as dictionaries, for comparison."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def test_nested_secrets_and_bounds(spark):
    """The walk over the type against plain recursion over the values, four levels deep, with NULLs at each."""
    import re

    from linkweave.functions.nested import bounded, redacted

    word = re.compile("authorization|api[_-]?key|access[_-]?token|token|secret|password|credential|bearer", re.IGNORECASE)

    def mask(value, parent=""):
        if isinstance(value, dict):
            if parent.lower() == "headers":
                return {k: None if v is None or not isinstance(v, str) else "********" for k, v in value.items()}
            return {
                k: "********" if isinstance(v, str) and (word.fullmatch(k) or (parent.lower() == "env" and word.search(k))) else mask(v, k)
                for k, v in value.items()
            }
        return [mask(v, parent) for v in value] if isinstance(value, list) else value

    def cut(value):
        if isinstance(value, str):
            return value if len(value) <= 5 else value[:5] + "\n[truncated]"
        if isinstance(value, dict):
            return {k: cut(v) for k, v in value.items()}
        if isinstance(value, list):
            return [cut(v) for v in value[:2]] + ([f"[{len(value) - 2} more items omitted]"] if len(value) > 2 else [])
        return value

    schema = (
        "v struct<name:string, TOKEN:string, headers:struct<a:string, n:int>, env:map<string,string>, deep:map<string,map<string,string>>,"
        " list:array<struct<password:string, x:int, inner:struct<secret:array<string>, api_key:string, Env:struct<my_token:string, lang:string>>>>>"
    )
    inner = {"secret": ["long text one", "b", "c", "d"], "api_key": "k", "Env": {"my_token": "t", "lang": "en"}}
    rows = [
        {"name": "some long name", "TOKEN": "t", "headers": {"a": "x", "n": None}, "env": {"MY_SECRET_1": "s", "LANG": "de", "Z": None},
         "deep": {"headers": {"q": "r"}, "ENV": {"x_password": "p"}, "other": {"bearer": "b", "free": "a long text"}, "none": None},
         "list": [{"password": "p", "x": 1, "inner": inner}, {"password": None, "x": 2, "inner": None}, None]},
        {"name": None, "TOKEN": None, "headers": None, "env": None, "deep": {}, "list": []},
    ]
    df = spark.createDataFrame([(r,) for r in rows], schema)
    got = [plain(r[0]) for r in df.selectExpr(redacted("v", df.schema["v"].dataType)).collect()]
    assert got == [mask(r) for r in rows]
    texts = df.selectExpr("v.name", "v.env", "v.deep", "get(v.list, 0).inner AS inner")
    for name, wanted in (("name", [r["name"] for r in rows]), ("env", [r["env"] for r in rows]), ("deep", [r["deep"] for r in rows]), ("inner", [inner, None])):
        out = texts.selectExpr(f"{bounded(name, texts.schema[name].dataType, 2, 5)} AS b").collect()
        assert [plain(r[0]) for r in out] == [cut(w) for w in wanted]
    many = spark.createDataFrame([([1, 2, 3],), ([1],), (None,)], "v array<int>")
    assert [r[0] for r in many.selectExpr(bounded("v", many.schema["v"].dataType, 2)).collect()] == [["1", "2", "[1 more items omitted]"], ["1"], None]
