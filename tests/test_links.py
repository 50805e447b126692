"""Links, relations, caps, components and forests on small inputs, against hand results or brute force."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave.config import Limits
from linkweave.operators import cards as C
from linkweave.operators import graph as G
from linkweave.operators import links as L
from linkweave.operators import sketches as K
from linkweave.operators.occurrences import describe_values, distinct_values, occurrences
from linkweave.plans import discovery as D
from linkweave.session import cut_lineage, fresh_folder
from linkweave.sources import files as X
from linkweave.sources.catalog import join_columns, schema_catalog


def stored(spark, rows, schema):
    out = fresh_folder(spark, "fixture")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(out)
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def shop(spark):
    crm = [(f"CUST-000{i}", f"p{i}@x.org") for i in range(5)]
    orders = [(f"ORD-{i:05d}", f"cust-000{i}", "P1@x.org" if i == 1 else f"z{i}@y.org") for i in range(3)]
    return {
        "crm": stored(spark, crm, "customer_id string, email string"),
        "orders": stored(spark, orders, "order_id string, customer_id string, buyer_email string"),
    }


def test_profile_relations(spark, shop):
    rows = {(r["source_column"], r["target_column"]): r for r in D.profile_relations(spark, shop).collect()}
    ids, mail = rows["customer_id", "customer_id"], rows["email", "buyer_email"]
    assert (ids["verdict"], ids["confidence"], ids["evidence_count"]) == ("confirmed", 0.96, 3)
    assert (mail["verdict"], mail["confidence"], mail["evidence_count"]) == ("supported_hypothesis", 0.914, 1)


def test_seeded_relations(spark, shop):
    result = D.discover(spark, shop)
    rows = {(r["type"], r["source_column"], r["target_column"]): r for r in result["relations"].collect()}
    assert rows["seeded_value_link", "customer_id", "customer_id"]["confidence"] == 0.985
    assert rows["seeded_value_link", "email", "buyer_email"]["confidence"] == 0.979
    assert rows["seeded_value_link", "email", "buyer_email"]["verdict"] == "confirmed"


def test_relation_ids_do_not_depend_on_order(spark, shop):
    swapped = {"orders": shop["orders"].orderBy(F.desc("order_id")), "crm": shop["crm"]}
    swapped["orders"] = stored(spark, [tuple(r) for r in swapped["orders"].collect()], shop["orders"].schema)
    a = {(r["id"], r["confidence"]) for r in D.profile_relations(spark, shop).collect()}
    b = {(r["id"], r["confidence"]) for r in D.profile_relations(spark, swapped).collect()}
    assert a == b


def test_match_cap_on_a_hot_value(spark):
    seeds_table = stored(spark, [("HOTVALUE-1",)], "order_id string")
    big = stored(spark, [("HOTVALUE-1",) for _ in range(60)] + [(f"COLD-{i:06d}",) for i in range(40)], "order_id string")
    tables = {"small": seeds_table, "wide": big}
    catalog = schema_catalog(spark, tables)
    columns = join_columns(catalog)
    seeds = describe_values(distinct_values(occurrences({"small": seeds_table}, {"small": columns["small"]})), catalog)
    index = L.seed_index(seeds.selectExpr("*", "table AS file", "fingerprint AS ord"))
    cells = occurrences({"wide": big}, {"wide": columns["wide"]})
    matches = L.probe_seeds(cells, catalog, index)
    assert matches.count() == 50
    assert matches.agg(F.max("row_no")).first()[0] == 50
    row = L.relations(L.evidence_rows(matches)).first()
    assert (row["evidence_count"], row["omitted_evidence_count"]) == (50, 38)
    near = L.frontier(cells, matches, 128)
    assert near.count() == 1


def test_bottom_k_of_parts(spark):
    values = [f"VALUE-{i:06d}" for i in range(3000)]
    df = stored(spark, [(v,) for v in values], "order_id string")
    catalog = schema_catalog(spark, {"t": df})
    cells = occurrences({"t": df}, join_columns(catalog))
    plain = {r["fingerprint"] for r in K.bottom_k(distinct_values(cells), 32).collect()}
    quick = {r["fingerprint"] for r in K.sampled_bottom_k(cells, K.cardinality(cells), 32).collect()}
    import hashlib

    want = set(sorted(hashlib.sha256(v.lower().encode()).hexdigest() for v in values)[:32])
    assert plain == quick == want
    low = cells.sparkSession.createDataFrame([("t", "order_id", 9e9)], "table string, column string, distinct double")
    # an estimate that is far too high cuts off too much; the short column is then done in full
    assert {r["fingerprint"] for r in K.sampled_bottom_k(cells, low, 32).collect()} == want


def test_large_tables_get_more_tasks_for_distinct_values(spark, monkeypatch):
    df = stored(spark, [(f"VALUE-{i % 4000:06d}", "COMMON-1") for i in range(9000)], "order_id string, item_code string")
    columns = join_columns(schema_catalog(spark, {"t": df}))
    cells = occurrences({"t": df}, columns)
    plain = {tuple(r) for r in distinct_values(cells).collect()}
    profile = {tuple(r) for r in K.column_profile(cells, 16).collect()}
    monkeypatch.setattr("linkweave.operators.occurrences.TASK_BYTES", 1 << 10, raising=False)
    dealt = distinct_values(cells)
    assert dealt.select(F.spark_partition_id()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {tuple(r) for r in dealt.collect()} == plain and len(plain) == 4001
    assert {tuple(r) for r in K.column_profile(cells, 16).collect()} == profile
    assert {(r["column"], r["nonempty"], r["distinct"]) for r in K.cardinality(cells, exact=True).collect()} == {("order_id", 9000, 4000), ("item_code", 9000, 1)}


def test_sketch_is_close(spark):
    df = stored(spark, [(f"VALUE-{i:06d}",) for i in range(5000)], "order_id string")
    cells = occurrences({"t": df}, join_columns(schema_catalog(spark, {"t": df})))
    assert abs(K.cardinality(cells).first()["distinct"] - 5000) < 5000 * 0.25


def kruskal(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    chosen = set()
    for key, a, b, c in sorted(edges, key=lambda e: (-e[3], e[0])):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[rb] = ra
            chosen.add(key)
    groups = {}
    for node in list(parent):
        groups.setdefault(find(node), set()).add(node)
    return chosen, {node: min(group) for group in groups.values() for node in group}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_forest_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(f"e{i:03d}", f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}", rng.randrange(5) / 10) for i in range(32)]
    edges += [(f"h{i:03d}", "hub", f"leaf{i:02d}", 0.5) for i in range(20)]
    edges = [e for e in edges if e[1] != e[2]]
    df = cut_lineage(spark.createDataFrame(edges, "id string, source string, target string, confidence double"))
    chosen, labels = kruskal(edges)
    assert {r["node"]: r["component"] for r in G.components(df).collect()} == labels
    assert {r["id"] for r in G.spanning_forest(df).collect()} == chosen


def test_components_shed_the_edges_of_dense_parts(spark, monkeypatch):
    """After the first round hardly any edge of a dense part is left, and a long path takes few rounds."""
    rng = random.Random(6)
    dense = [(f"p{rng.randrange(400)}", f"s{rng.randrange(20)}") for _ in range(6000)]
    path = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(200)]
    loose = [("alone", "alone"), (None, "half"), ("half", "half")]
    written = []

    def counted(df, name="step"):
        out = cut_lineage(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", counted)
    df = cut_lineage(spark.createDataFrame(dense + path + loose, "source string, target string"))
    got = {r["node"]: r["component"] for r in G.components(df).collect()}
    first = min(min(e) for e in dense)
    want = {n: first for e in dense for n in e} | {n: "w000" for e in path for n in e} | {"alone": "alone", None: None, "half": "half"}
    assert got == want
    assert sum(n > 3000 for n in written) <= 1 and len(written) <= 40


def test_chains(spark):
    rows = [("R-1", "a", "b", 0.9), ("R-2", "b", "c", 0.8), ("R-3", "a", "c", 0.7), ("R-4", "x", "y", 0.9)]
    df = cut_lineage(spark.createDataFrame(rows, "id string, source string, target string, confidence double"))
    parts = G.chains(df)
    assert {(r["first_file"], r["files"], r["relation_count"]) for r in parts["summary"].collect()} == {("a", 3, 3), ("x", 2, 1)}
    assert {r["relation_id"] for r in parts["core"].collect()} == {"R-1", "R-2", "R-4"}
    import hashlib

    def digest(files):  # four lanes of each name's SHA-256, added up
        names = [hashlib.sha256(f.encode()).hexdigest() for f in files]
        lanes = [str(sum(int(n[15 * k : 15 * k + 15], 16) for n in names)) for k in range(4)]
        return hashlib.sha256("\n".join([str(len(files)), *lanes]).encode()).hexdigest()

    assert {r["chain_id"] for r in parts["summary"].collect()} == {"C-" + digest(f)[:12] for f in (["a", "b", "c"], ["x", "y"])}


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "path string, sha256 string")
    assert {(r["source"], r["target"], r["copies"]) for r in L.duplicate_links(df).collect()} == {("a", "b", 3), ("a", "d", 3)}


def test_explicit_references_against_brute_force(spark):
    names = ["Rates.csv", "a.c", "notes.txt", "规则.xlsx", "long report 2024.pdf", "abcd", "规则说明", "x_y_z.md"]
    texts = [
        "see rates.CSV and notes.txt", "prerates.csvx", "依据规则.xlsx 和规则说明", "the Long Report 2024.pdf", "xabcdx", "a.c", "x_y_z.md?", "none",
    ]
    n = spark.createDataFrame([(f"f/{i}", x) for i, x in enumerate(names)], "path string, file_name string")
    t = spark.createDataFrame([(f"t/{i}", "l", x) for i, x in enumerate(texts)], "path string, locator string, text string")
    got = {(r["source"], r["target"]) for r in L.explicit_references(t, n).collect()}
    want = {
        (f"t/{i}", f"f/{j}") for i, x in enumerate(texts) for j, y in enumerate(names) if len(y) >= 4 and y.casefold() in x.casefold()
    }
    assert got == want


def test_mention_scores(spark):
    scored = spark.createDataFrame(
        [("doc", "line:1", "monthly sales report by region then done", "", 3), ("doc", "line:2", "see rates.csv", "", 0)],
        "file string, locator string, statement string, folded string, score int",
    )
    names = spark.createDataFrame(
        [("d/monthly sales report region.csv", "monthly sales report region.csv", "monthly sales report region"), ("rates.csv", "rates.csv", "rates"), ("doc", "doc", "doc")],
        "path string, file_name string, stem string",
    )
    got = {r["locator"]: (r["score"], r["mentioned"]) for r in C.mention_scores(scored, names).collect()}
    assert got == {"line:1": (7, ["d/monthly sales report region.csv"]), "line:2": (6, ["rates.csv"])}


def test_reachable_columns(spark):
    rows = [("a", "order_id"), ("b", "order_id"), ("c", "amount"), ("c", "amount2")]
    from linkweave.sources.catalog import column_meaning

    catalog = column_meaning(spark.createDataFrame(rows, "table string, name string"))
    opened = spark.createDataFrame([("b",)], "table string")
    assert {tuple(r) for r in L.reachable_columns(catalog, opened).collect()} == {("a", "order_id")}


def test_global_rank(spark):
    words = [f"w{random.Random(i).randrange(10**6):06d}-{i}" for i in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r["w"]: r["n"] for r in X.global_rank(df, ["w"], "n").collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(words))}


def test_card_bounds(spark):
    rows = [(f"f{i}", "file_structure", "contextual") for i in range(3)] + [(f"c{i}", "k", s) for i, s in enumerate(["contextual", "direct", "structural", "direct"])]
    cards = spark.createDataFrame(rows, "id string, kind string, strength string")
    assert {r["id"] for r in C.bound_cards(cards, 5).collect()} == {"f0", "f1", "f2", "c1", "c3"}
    assert {r["id"] for r in C.bound_cards(cards, 2).collect()} == {"f0", "f1", "f2"}


def test_limits_are_parameters():
    assert Limits(profile_size=5).profile_size == 5


# What the first build got wrong ---------------------------------------------------------------------


def test_text_seeds_probe_other_tables(spark):
    notes = stored(spark, [(f"please write to user{k}@mail.example.org soon",) for k in range(20)], "remark string")
    people = stored(spark, [(f"user{k}@mail.example.org", k) for k in range(400)], "email string, amount int")
    rules = D.Rules(limits=Limits(seed_cell_budget=100))
    result = D.discover(spark, {"notes": notes, "people": people}, rules)
    found = result["relations"].where("type = 'seeded_value_link'").collect()
    assert len(found) == 1 and {found[0]["source"], found[0]["target"]} == {"notes", "people"}
    row = result["coverage"].first()
    assert (row["tables"], row["completed"], row["readable"]) == (2, 1, 1)
    # the pieces kept are those of the first rows, by number
    kept = result["evidence"].where("type = 'seeded_value_link'").orderBy("seq").limit(12).collect()
    assert [int(r["seq"].split("/")[2]) for r in kept] == list(range(1, 13))


def test_discovery_without_join_columns(spark):
    tables = {n: stored(spark, [(1.5,), (2.5,)], "amount double") for n in ("a", "b")}
    assert D.discover(spark, tables)["relations"].count() == 0


def test_late_json_keys_are_kept(spark, tmp_path):
    from linkweave.sources.files import read_json_lines

    lines = [f'{{"a": {k}}}' for k in range(149)] + ['{"a": 1, "late": 2}', "not json"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = read_json_lines(spark, str(tmp_path / "x.jsonl"))
    assert rows.columns == ["row_no", "a", "late"] and rows.count() == 150 and rows.where("late = 2").count() == 1
    assert read_json_lines(spark, str(tmp_path / "x.jsonl"), sample=100).columns == ["row_no", "a"]


def test_a_value_of_many_columns_meets_by_label(spark):
    """Only columns that agree make a row, once a pair, by the best of the labels they share."""
    kinds = [("id", f"k{n}", f"b{n}") for n in range(40)] + [("other", f"o{n}", f"p{n}") for n in range(40)] + [("id", "k1", "b1"), ("name", "n", "b"), ("name", "m", "b")]
    rows = [(f"t{n:02}", f"c{n}", key, kind, base, "l", "p", 3, "f" * 64) for n, (kind, key, base) in enumerate(kinds)]
    df = spark.createDataFrame(rows, "table string, column string, key string, kind string, base string, locator string, preview string, specificity int, fingerprint string")
    got = {(r["s_table"], r["t_table"]): r["compat"] for r in L.column_overlap(df).collect()}
    assert L.column_overlap(df).count() == len(got)

    def agreement(a, b):
        (ka, ha, ba), (kb, hb, bb) = kinds[a], kinds[b]
        return 1.0 if ha == hb else 0.96 if ba == bb else 0.82 if ka == kb == "id" else 0.76 if ka == kb == "name" else 0.0

    want = {(f"t{a:02}", f"t{b:02}"): agreement(a, b) for a in range(len(kinds)) for b in range(a + 1, len(kinds))}
    assert got == {pair: x for pair, x in want.items() if x >= 0.72}


def test_statements_are_folded_once(spark):
    """The filter on the score must not fold a statement again for each marker."""
    segments = spark.createDataFrame([("f", "l", "It depends on the order. Nothing here at all.")], "file string, locator string, text string")
    best = C.best_statements(C.scored_statements(segments))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("CASE WHEN") <= 4
    assert [r["statement"] for r in best.collect()] == ["It depends on the order."]


def test_mentions_shuffle_no_statement(spark):
    """Few names: a statement meets them where it is read, and what is found is the same as for many names."""
    texts = ["see orders csv for more", "the Orders CSV file", "nothing to see here", "a log of logs, alpha beta gamma"]
    segments = spark.createDataFrame([(f"f{i}", "l", t) for i, t in enumerate(texts)], "file string, locator string, text string")
    names = [("orders csv", "orders csv", "orders"), ("logs", "logs", "alpha beta gamma"), ("f0", "more", "more")]
    others = [(f"x{i}", f"zq{i:04d}", "none") for i in range(80)]  # more four-letter pieces than are looked for one by one
    found = []
    for rows in (names, names + others):
        named = spark.createDataFrame(rows, "path string, file_name string, stem string")
        scored = C.mention_scores(C.scored_statements(segments), named)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        found.append({r["file"]: r["mentioned"] for r in scored.collect()})
    assert found[0] == found[1] == {"f0": ["orders csv"], "f1": ["orders csv"], "f2": [], "f3": ["logs"]}
