"""The training-data operators next to brute force, and on odd tables: NULLs, empty and long texts, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from linkweave.llm import chat, decontamination, fingerprints, html_text, mixing, near_duplicates, quality, sharding, token_counts, toxicity
from linkweave.llm.components import star_components
from linkweave.plans.tables import read_table

WORD = re.compile("[^\x20\x09-\x0d]+")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, slot string, node string, a int, key string, label string"
LONG = "long words here and there " * 8000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, "k", "l") for i, t, s in rows], FIELDS)


@pytest.fixture(scope="session")
def odd(spark):
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one"), (None, "no id at all"), (None, None), (6, LONG),
        (7, LONG + "end"), (8, "é ü ß <|im_end|> \x00"), (9, "some other words stand here"), (9, "and yet another text of that id"),
    ]
    return frame(spark, [(i, t, None if k % 3 else "web") for k, (i, t) in enumerate(texts)])


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


def docs_of(spark, folder):
    return {r.doc_id: r.text or "" for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()}


# 1 fingerprints

def test_edited_texts(spark, folder):
    texts = docs_of(spark, folder)
    ids = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in entry.queries()["op1_fingerprints"](spark, folder).collect()}
    for k, i in enumerate(ids):
        text, other = texts[i], texts[ids[(k + 1) % len(ids)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(text)
    near = sorted(r.near_edited for r in rows.values())
    assert near[len(near) // 10] > 0.25 and sorted(r.near_next for r in rows.values())[len(near) * 9 // 10] < 0.1


def test_syncmers_do_not_depend_on_place(spark):
    words = [f"w{k}" for k in range(60)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "q r s t " + "  ".join(words))], "doc_id long, text string")
    found = defaultdict(dict)
    for r in fingerprints.positions(rows).collect():
        found[r.doc_id][r.anchor] = r.position
    shared = [a for a in found[1] if found[1][a] < 57]  # later ones hold the padding
    assert len(shared) > 20 and all(found[2][a] == found[1][a] + 4 for a in shared)
    shifts = {r["shift"]: r.anchors for r in fingerprints.matches(*(fingerprints.positions(rows.where(f"doc_id = {k}")) for k in (1, 2))).collect()}
    assert max(shifts, key=shifts.get) == 4


def test_near_copies_on_both_sides_of_the_bound(spark):
    """A near copy beyond the bound is compared by words like any longer pair, and not with characters of one side."""
    turn = random.Random(2)
    rows = []
    for n in (16, 22, 23, 24, 25, 40):
        for k in range(30):
            words = [f"v{turn.randrange(10_000)}" for _ in range(n)]
            rows.append((n, " ".join(words), " ".join([*words, "more"]), " ".join(f"v{turn.randrange(10_000)}" for _ in range(n))))
    df = spark.createDataFrame(rows, "n int, a string, b string, c string")
    for column in "abc":
        df = fingerprints.sketched(df, column, f"s{column}")
    near = df.select("n", fingerprints.likeness("sa", "sb").alias("copy"), fingerprints.likeness("sa", "sc").alias("other")).groupBy("n").avg("copy", "other").collect()
    assert all(r[1] > 0.6 and r[2] < 0.1 for r in near)
    by = {r[0]: r[1] for r in near}
    assert abs(by[23] - by[24]) < 0.1 and abs(by[24] - by[25]) < 0.1
    texts = df.select(fingerprints.fingerprint("sa").alias("f"), "a").collect()
    assert len({r.f for r in texts}) == len({r.a for r in texts})


def test_fingerprints_of_odd_rows(spark, odd, empty):
    rows = fingerprints.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count() and fingerprints.edited_fingerprints(empty).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[4][0].fingerprint == by[4][1].fingerprint == by[5][0].fingerprint != ""
    assert by[1][0].fingerprint == by[2][0].fingerprint == by[3][0].fingerprint == ""
    assert all(r.near_next is None for r in by[None]) and all(0 <= r.near_edited <= 1 for r in rows)


# 2 and 3 classifiers

@pytest.mark.parametrize("query, label, folds, out, threshold", [("op2_toxicity", "toxic", 4, 2, 0.3), ("op3_quality", "quality", 3, 1, 0.5)])
def test_held_out_accuracy(spark, query, label, folds, out, threshold):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r[label] for r in read_table(spark, folder, "labels").collect()}
    rows = entry.queries()[query](spark, folder).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) and r.predicted == (r.score >= threshold)
    judged = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in judged if y == v] for v in (1, 0))
    assert sum(g > b for g in good for b in bad) / len(good) / len(bad) > 0.75


@pytest.mark.parametrize("score, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd, empty, score, label):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (5, 1), (None, 1), (6, 0), (99, 1)], f"doc_id long, {label} int")
    rows = score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1 and not any(r.held_out for r in rows if r.doc_id is None)
    assert score(empty, labels).count() == 0 and {r.score for r in score(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.good_documents(odd, labels.withColumnRenamed(label, "quality"))
    assert kept.columns == odd.columns


def test_ftrl_equals_a_plain_loop():
    turn, rules = random.Random(1), toxicity.FtrlRules(alpha=0.3, l1=1.5, epochs=2)
    rows = [sorted(turn.sample(range(12), turn.randrange(7))) for _ in range(60)]
    labels = [int(0 in r or turn.random() < 0.2) for r in rows]
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= rules.l1:
            return 0.0
        return (math.copysign(rules.l1, z[k]) - z[k]) / ((rules.beta + n[k] ** 0.5) / rules.alpha + rules.l2)

    order = np.random.default_rng(0)
    for _ in range(rules.epochs):
        for k in order.permutation(len(rows)):
            present = [*rows[k], 12]
            w = {i: weight(i) for i in present}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i in present:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / rules.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = toxicity.ftrl([np.array(r, int) for r in rows], np.array(labels, float), 12, rules)
    assert np.allclose(got, [weight(k) for k in range(13)]) and (got == 0).any() and (got != 0).any()


def test_non_negative_risk_gradient(monkeypatch):
    """The steps of fit_quality are those of the risk's slope, on both sides of a negative part of zero."""
    random_rows = np.random.default_rng(4)
    positive, unlabelled = random_rows.normal(0.5, 1, (30, 5)), random_rows.normal(0, 1, (50, 5))
    for prior in (0.05, 0.95):  # the negative part is above zero, then below
        seen = {}

        def once(net, rules, gradients):
            seen.update(net=net, gradients=[g.copy() for g in gradients()])

        monkeypatch.setattr(quality, "_descend", once)
        quality.fit_quality(positive, unlabelled, quality.PuRules(), prior)
        net = seen["net"]
        p, u = net.standard(positive), net.standard(unlabelled)

        def risk():
            sp, su = (1 / (1 + np.exp(-net.forward(x)[1])) for x in (p, u))
            negative = su.mean() - prior * sp.mean()
            return (prior * (1 - sp).mean() + negative if negative >= 0 else -negative), negative

        assert (risk()[1] >= 0) == (prior == 0.05)
        for part, gradient in zip(net.parts, seen["gradients"], strict=True):
            for at in list(np.ndindex(part.shape))[:6]:
                was, h = part[at], 1e-5
                part[at] = was + h
                above = risk()[0]
                part[at] = was - h
                below = risk()[0]
                part[at] = was
                assert abs((above - below) / (2 * h) - gradient[at]) < 1e-6


def test_ids_that_repeat_teach_once(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    labels = read_table(spark, folder, "labels")
    hot = docs.where(docs.doc_id < 12).crossJoin(spark.range(400)).select("doc_id", "text")
    from linkweave.llm.sampling import one_text_each

    for score in (toxicity.toxicity, quality.quality):
        plain = {r.doc_id: r.score for r in score(docs, labels).collect()}
        rows = score(docs.unionAll(hot), labels).collect()
        assert len(rows) == docs.count() + hot.count()
        assert all(abs(r.score - plain[r.doc_id]) < 1e-9 for r in rows)
    one = one_text_each(docs.unionAll(hot), ["doc_id"])
    assert one.count() == docs.count()
    # tasks drop repeated rows before the exchange
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# 4 decontamination

def test_edited_copies_are_found(spark):
    turn = random.Random(3)
    words = [f"term{k}" for k in range(400)]
    items = {k: [turn.choice(words) for _ in range(30)] for k in range(8)}
    plain = lambda n: " ".join(turn.choice(words) for _ in range(n))
    rows, want = [], set()
    for k, item in items.items():
        changed = [w for j, w in enumerate(item) if j % 9 != 4]  # left out
        swapped = [w if j % 7 != 3 else "other" for j, w in enumerate(item)]
        for text in (item, changed, swapped):
            rows.append((len(rows), f"{plain(40)} {' '.join(text).upper()}, {plain(40)}", "s"))
            want.add((len(rows) - 1, k))
    rows += [(100 + k, plain(300), "s") for k in range(20)] + [(200 + k, " ".join(items[0]), "hot") for k in range(60)]
    want |= {(200 + k, 0) for k in range(60)}
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(90, None), (91, ""), (None, "x")], "item_id long, text string")
    docs = frame(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == want
    small = decontamination.LeakRules(block_words=100)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench, small).collect()} == want
    assert {r.doc_id for r in decontamination.decontaminated(docs, bench).collect()} == set(range(100, 120))


def test_seeds_meet_every_alignment_above_the_score(spark):
    """Copies with every n-th word changed, left out or doubled by another: found wherever a full alignment scores enough."""
    import numpy as np

    turn, rules = random.Random(6), decontamination.LeakRules()
    words = [f"w{k}" for k in range(5000)]
    some = lambda n: [turn.choice(words) for _ in range(n)]
    items = {k: some(turn.choice((12, 20, 30, 45))) for k in range(12)}
    docs, texts = [], []
    for item in items.values():
        for n in range(2, 10):
            for how in ("changed", "left", "added"):
                body = []
                for j, w in enumerate(item):
                    hit = j % n == n - 1
                    body += [turn.choice(words)] if hit and how == "changed" else [] if hit and how == "left" else [w, turn.choice(words)] if hit else [w]
                texts.append(some(30) + body + some(30))
                docs.append((len(docs), " ".join(texts[-1]), "s"))
    codes = {w: k for k, w in enumerate(words)}
    code = lambda text: np.array([codes[w] for w in text])
    want = {
        (d, k) for d, text in enumerate(texts) for k, item in items.items()
        if decontamination.align(code(item), code(text), rules)[0] >= rules.least_score * rules.match * len(item)
    }
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 200


def test_short_and_long_items(spark):
    long = [f"l{k}" for k in range(600)]
    bench = [(1, "alpha beta gamma delta eps"), (2, "common"), (3, " ".join(long)), (4, "two words"), (5, "one two three four")]
    docs = [
        (1, "x alpha beta gamma y", "s"), (2, "x alpha beta gamma delta eps y", "s"), (3, "a common word", "s"),
        (4, "before " + " ".join(long[100:370]) + " after", "s"), (5, "before " + " ".join(long[100:115]) + " after", "s"),
        (6, "just two words here", "s"), (7, "one two three four", "s"), (8, "one two three five", "s"),
    ]
    bench, docs = spark.createDataFrame(bench, "item_id long, text string"), frame(spark, docs)
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert found == {(2, 1), (3, 2), (4, 3), (6, 4), (7, 5)}
    assert {r.doc_id for r in decontamination.decontaminated(docs, bench).collect()} == {1, 3, 5, 6, 8}


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "some other words stand here"), (1, "some other words stand here"), (2, "one")], "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontamination.leaks(odd, bench).collect()]
    assert sorted(found) == [(4, 2), (4, 2), (5, 2), (9, 1), (9, 1)]
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(odd, bench.limit(0)).count() == 0
    assert decontamination.decontaminated(odd, bench.limit(0)).count() == odd.count()


def test_alignment_score():
    import numpy as np

    def slow(a, b, rules):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (rules.match if x == y else rules.mismatch), h[i - 1][j] + rules.gap, h[i][j - 1] + rules.gap)
        return max(map(max, h))

    turn, rules = random.Random(1), decontamination.LeakRules()
    for _ in range(60):
        a, b = ([turn.randrange(5) for _ in range(turn.randrange(1, 14))] for _ in range(2))
        assert decontamination.align(np.array(a), np.array(b), rules)[0] == slow(a, b, rules)


# 5 and 6 sharding, mixing

def test_lookup_table():
    table = sharding.lookup_table()
    counts = [table.count(s) for s in range(len(sharding.SHARDS))]
    assert len(table) == sharding.SLOTS and max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a < len(sharding.SHARDS) - 1)
    assert moved < len(table) // 4
    with pytest.raises(ValueError):
        sharding.lookup_table(("a", "b"), 100)


def test_sharding_of_odd_rows(spark, odd, empty):
    rows = sharding.sharded(odd).collect()
    assert len(rows) == odd.count() and len({r.shard for r in rows if r.doc_id == 4}) == 1 and sharding.sharded(empty).count() == 0


def test_pfair_stays_within_a_block():
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 7.3, "b": 0.2, "c": 2.9, "d": 0.01}, {"x": 1}, {f"s{k}": k + 1 for k in range(40)}):
        parts = mixing.whole_weights(weights, 500)
        schedule = mixing.pfair_period(parts)
        seen = dict.fromkeys(parts, 0)
        assert len(schedule) == sum(parts.values()) == 500
        for slot, (s, j) in enumerate(schedule, 1):
            assert j == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] - a * slot / 500) < 1 for x, a in parts.items())


@pytest.mark.parametrize("blocks", [
    {"hot": 560, "warm": 44, "cool": 41, "one": 1, "few": 3}, {f"s{k:02}": 5 + 7 * k for k in range(32)}, {f"s{k:03}": 3 + k for k in range(400)},
])
def test_stretches_stay_within_a_block(blocks):
    """In each stretch, a source that has blocks left is never one block off its share of the slots, however many sources there are."""
    rules = mixing.MixRules()
    plan = mixing.planned({s: n**0.5 for s, n in blocks.items()}, blocks, rules)
    names = sorted(blocks)
    slots = defaultdict(list)
    for r in plan.slots.to_pylist():
        slots[r["__stretch"]].append(r)
    shares = {s["__code"]: {x["stretch"]: x for x in s["__stretches"]} for s in plan.shares.to_pylist()}
    at = {}
    for code, name in enumerate(names):
        place = {(r["__stretch"], r["__nth"]): r for k in shares[code] for r in slots[k] if r["__code"] == code}
        for block in range(blocks[name]):
            x = [x for x in shares[code].values() if x["first"] <= block][-1]
            turn, nth = divmod(block - x["first"], x["parts"])
            r = place[x["stretch"], nth]
            slot = turn * r["__period"] + r["__slot"]
            assert slot not in at
            at[slot] = (name, block)
            base = min(y["__slot"] for y in slots[x["stretch"]])
            # before and after this block
            share = x["parts"] * (slot - base) / r["__period"]
            assert abs(block - x["first"] - share) < 1 and abs(block - x["first"] + 1 - share - x["parts"] / r["__period"]) < 1
    assert len(at) == sum(blocks.values())


def test_mixture(spark, odd, empty):
    rows = frame(spark, [(k, "t", "big" if k % 3 else "small") for k in range(3000)])
    rules = mixing.MixRules(bucket_rows=100)
    out = mixing.mixed(rows, {"big": 1, "small": 3}, rules).collect()
    assert len(out) == 3000 and len({r.position for r in out}) == 3000
    mix = sorted((r for r in out if r.in_mix), key=lambda r: r.position)
    assert sum(r.source == "small" for r in mix) == 1000
    for n in range(64, len(mix), 64):
        assert abs(sum(r.source == "small" for r in mix[:n]) - 0.75 * n) <= 2 * rules.block_rows
    assert mixing.mixed(odd).count() == odd.count() and mixing.mixed(empty).count() == 0
    assert {r.in_mix for r in mixing.mixed(odd, {}).collect()} == {False}


@pytest.mark.parametrize("have", [{"hot": 9000, "warm": 700, "cool": 650, "one": 1, None: 1}, {f"s{k:02}": 40 + 16 * k for k in range(40)}])
def test_mixture_keeps_every_row(spark, have):
    import corpus_pipeline as pipeline

    names = [s for s, n in have.items() for _ in range(n)]
    docs = frame(spark, [(k, "t", s) for k, s in enumerate(names)])
    rows = sorted(mixing.mixed(docs).collect(), key=lambda r: r.position)
    assert len({r.position for r in rows}) == len(rows) == len(names) and all(r.in_mix for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(len(names)))
    assert len({r.slot for r in rows}) == sum(-(-n // 16) for n in have.values())
    # block by block: sources that have blocks left get their share of the slots since the last of them ran out
    left = {s: -(-n // 16) for s, n in have.items()}
    seen, slots = dict.fromkeys(left, 0), 0
    block_of = {r.slot: (r.source, r.block) for r in rows}
    taken = dict.fromkeys(left, 0)
    for slot in sorted(block_of):
        s, j = block_of[slot]
        assert j == taken[s]
        taken[s] += 1
        seen[s] += 1
        slots += 1
        live = [x for x in left if taken[x] < left[x]]
        total = sum(have[x] ** 0.5 for x in left if taken[x] < left[x] or seen[x])
        assert all(abs(seen[x] - have[x] ** 0.5 / total * slots) < 2 + slots * len(left) / 1000 for x in live)
        if taken[s] == left[s]:
            seen, slots = dict.fromkeys(left, 0), 0
    kept = pipeline.keep_mixture(spark, docs, "").collect()
    assert [r.doc_id for r in kept] == [r.doc_id for r in rows]


# 7 near duplicates

def components_by_hand(texts, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in texts.items():
        words = WORD.findall((text or "").translate(low))
        sets[i] = set(zip(*(words[k:] for k in range(width)))) if len(words) >= width else ({tuple(words)} if words else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_by_hand(spark, width):
    turn = random.Random(width)
    base = [f"w{turn.randrange(900)}" for _ in range(120)]
    texts = {}
    for k in range(220):  # a group whose members are about as alike as the threshold
        words = list(base)
        for _ in range(turn.randrange(0, 9 if width == 2 else 4)):
            words[turn.randrange(len(words))] = f"x{turn.randrange(10**6)}"
        texts[k] = " ".join(words)
    for k in range(220, 300):
        texts[k] = " ".join(f"w{turn.randrange(900)}" for _ in range(turn.randrange(0, 40)))
    texts |= {300 + k: "The Same Text again and again" for k in range(40)}
    docs = frame(spark, [(i, t, "s") for i, t in texts.items()])
    for rules in (near_duplicates.NearRules(words=width), near_duplicates.NearRules(words=width, block=16)):
        rows = near_duplicates.near_duplicates(docs, rules).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == components_by_hand(texts, width)
    kept = {r.doc_id for r in near_duplicates.distinct_documents(docs, near_duplicates.NearRules(words=width)).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    rows = near_duplicates.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and near_duplicates.near_duplicates(empty).count() == 0
    at = {r.doc_id: r.component_id for r in rows}
    assert (at[1], at[2], at[3], at[4], at[5], at[6], at[7], at[None]) == (1, 2, 3, 4, 4, 6, 6, None)
    ids = [r.doc_id for r in near_duplicates.distinct_documents(odd).collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, 4, None, None, 6, 8, 9], key=str)


def test_texts_of_one_id_hang_together(spark):
    one, two, other = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = frame(spark, [(3, one, "s"), (5, one, "s"), (5, two, "t"), (7, two, "s"), (8, two + " more", "s"), (9, other, "s")])
    rows = near_duplicates.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {
        (3, 3, True), (5, 3, False), (7, 3, False), (8, 3, False), (9, 9, True)
    }
    assert sorted(r.doc_id for r in near_duplicates.distinct_documents(docs).collect()) == [3, 9]


def test_star_components(spark):
    turn = random.Random(5)
    pairs = [(turn.randrange(300), turn.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (None, 3)]
    top = list(range(2000))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs[:-1]:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    rows = star_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {x: find(x) for a, b in pairs[:-2] if a != b for x in (a, b)} and len({r.node for r in rows}) == len(rows)


# 8 to 10 pages, tokens, chats

PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><nav><a href="/">Home</a></nav></header>'
    '<div class="ad">Buy now, buy here.</div><article><h1>Title &eacute;&amp;</h1><p>First  para\nwith <a href=1>a link</a>, and&nbsp;more text. It goes on.'
    '<p><b>Second para.<br></b> It is longer; and has a &lt;sign&gt;.<script>var x="<p>no</p>";</script><!-- <p>no --><form>Name <input></form>'
    '<ul><li>one<li>two</ul></article><section id="comments"><p>Great read, thanks a lot for it.</p></section><footer>&copy; me</footer></body></html>'
)


def test_main_text():
    want = "Title é&\nFirst para with a link, and more text. It goes on.\nSecond para. It is longer; and has a <sign>.\none\ntwo"
    assert html_text.main_text(PAGE) == want
    for page, text in ((None, ""), ("", ""), ("just text", "just text"), ("<p>a</p><p>b", "a\nb"), ("<script>x", ""), ('a < b <p "', 'a < b <p "')):
        assert html_text.main_text(page) == text
    assert len(html_text.main_text("<article>" + "<p>word, word.</p>" * 20000)) == 20000 * 12 - 1


@pytest.mark.parametrize("page, text", [
    ("<div id=content><p>First, long text.</p><p>Second.</p></div><div id=comments><p>Great read.</p></div>", "First, long text.\nSecond."),
    ("<div role=main><p>First, long text.</p><p>Second.</p></div><div role=complementary><p>Great read.</p></div>", "First, long text.\nSecond."),
    ("<article><p>First, long text.</p><p hidden>Not shown.</p><p>Second.</p></article>", "First, long text.\nSecond."),
    ("<article><p>First, long text.</p><p style='display:none'>Not shown.</p><p aria-hidden=true>Nor this.</p></article>", "First, long text."),
    ("<div id=content><p>First, long text.</p></div><div id=pane><p>Another text, as long.</p></div>", "First, long text."),
    ("<article><p id=p1>First, long text.</p><p id=p2>Second.</p><h2 id=h>And</h2></article>", "First, long text.\nSecond.\nAnd"),
])
def test_noise_is_left_out_block_by_block(page, text):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text


ARTICLE = "<h2>On things</h2><p>First, long text of an article.</p><p>Second, with more.</p>"
ARTICLE_TEXT = "On things\nFirst, long text of an article.\nSecond, with more."


@pytest.mark.parametrize("page, text", [
    *((f"<div {names}>{ARTICLE}</div><div><p>Elsewhere.</p></div>", ARTICLE_TEXT) for names in (
        "class='post category-legal'", "class='entry tag-social'", "id='content' class='side-by-side'", "class='story search'", "role=main class=notice",
    )),
    (f"<div class='side-by-side'><div id=content>{ARTICLE}</div></div><div><p>Elsewhere.</p></div>", ARTICLE_TEXT),
    (f"<main><div class='layout side-by-side'><article>{ARTICLE}</article></div><p>Small.</p></main>", ARTICLE_TEXT + "\nSmall."),
    # noise beside an article stays noise
    (f"<article>{ARTICLE}</article><div class=related><article><p><a href=1>Read this next</a></p></article></div>", ARTICLE_TEXT),
    (f"<article>{ARTICLE}<div class=comments><article><p>Great read.</p></article></div></article>", ARTICLE_TEXT),
    (f"<div class=side><article>{ARTICLE}<div class=comments><article><p>Great.</p></article></div></article></div>", ARTICLE_TEXT),
    (f"<article>{ARTICLE}</article><div class=comments><div class=comment-content><p>Great read, thanks for all of it, really, it is.</p></div></div>", ARTICLE_TEXT),
    # linked headings and lists of references in an article
    ("<article><h2><a href=1>Linked title</a></h2><p>First, long text.</p><ol><li><a href=2>Some reference</a><li><a href=3>Another</a></ol>"
     "<div><a href=4>Tweet</a> <a href=5>Mail</a></div></article>", "Linked title\nFirst, long text.\nSome reference\nAnother"),
])
def test_main_wins_over_names_of_noise(page, text):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text


def test_pages(spark, folder):
    pages = {r.page_id: r.html for r in read_table(spark, folder, "pages").collect()}
    rows = entry.queries()["op8_html"](spark, folder).collect()
    assert len(rows) == len(pages)
    import html

    for r in rows:
        parts = re.split(r"</?(?:p|h1)>", re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1])
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in parts]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_token_counts(spark, odd, empty):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    turn = random.Random(2)
    texts = [None, "", " ", "x ", "  a  b ", "▁x ▁ y", "<s> </s>", "\n\n x\t", LONG, "x" * 3000]
    texts += ["".join(turn.choice(" ▁\n\tabé漢<>/;)\r\x00") for _ in range(turn.randrange(80))) for _ in range(500)]
    lengths = token_counts.PieceLengths(public_tokenizers.path("piece_bpe_32k.model"))
    for some in (pa.array(texts, pa.string()), pa.array(["", *texts], pa.string())[1:]):
        assert lengths.of(some).tolist() == [len(model.encode(t or "")) for t in texts]
    rows = token_counts.token_counts(odd, "piece_bpe_32k.model").collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd.collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in rows)
    assert token_counts.token_counts(empty, "piece_bpe_32k.model").count() == 0


def test_chat_round_trip(spark):
    odd_texts = [chat.START, chat.END, "<|", "<\\|", "<\\\\|im_end|>", "a<", "|>", None, "", "\n", "é\n<|im_end|>\n<|im_start|>user\nx", LONG]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(odd_texts)] + [(2, 0, None, "x"), (None, 1, "Human", "y"), (3, 5, "gpt", "a"), (3, 5, "gpt", "a")]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    pieces = chat.formatted_turns(chat.canonical_turns(turns)).orderBy("turn").where("conv_id = 1").collect()
    text = "".join(p.formatted for p in pieces)
    assert [chat.unescaped(t) for _, t in chat.FORMATTED.findall(text)] == [t or "" for t in odd_texts]
    got = {r.conv_id: r for r in chat.read_back(chat.formatted_turns(chat.canonical_turns(turns))).collect()}
    said = "".join(t or "" for k, t in enumerate(odd_texts) if k % 2)
    assert got[1].n_turns == len(odd_texts) and got[1].formatted_chars == len(text) and got[1].loss_chars == len(said)
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[3].n_turns == 2 and set(got) == {1, 2, 3, None}
    assert chat.read_back(chat.formatted_turns(chat.canonical_turns(turns.limit(0)))).count() == 0


def test_roles_are_read_back(spark):
    roles = ["user", "a\nb", "\r", "back\\slash", "\\n", "<|im_end|>\n", "<\\|im_start|>", "", "assistant", "x\\\\\n"]
    turns = spark.createDataFrame([(1, k, r, f"t{k}") for k, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    [got] = chat.read_back(chat.formatted_turns(chat.canonical_turns(turns))).collect()
    want = "".join(f"{r}\nt{k}\n" for k, r in enumerate(roles))
    assert got.turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got.n_turns == len(roles)
    assert got.loss_sha256 == hashlib.sha256(b"t8").hexdigest()


def test_layouts(spark):
    records = [
        '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}], "id": 1}', '{"conversations": [{"from": "human", "value": "q"}]}',
        '{"prompt": "q", "response": "a", "lang": "en"}', '{"instruction": "q", "input": "more", "output": "a"}', '{"question": "q", "answer": null}',
        '{"other": 1}', "not json", None,
    ]
    turns, unmatched = chat.canonical_records(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string"))
    found = defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        found[r.conv_id].append((r.role, r.text))
    assert dict(found) == {
        0: [("system", "s"), ("user", "q")], 1: [("user", "q")], 2: [("user", "q"), ("assistant", "a")],
        3: [("user", "q\n\nmore"), ("assistant", "a")], 4: [("user", "q"), ("assistant", "")],
    }
    assert {r.conv_id for r in unmatched.collect()} == {5, 6, 7}
    frame_turns = chat.canonical_turns(spark.createDataFrame([(1, "q", "a", 3)], "conv_id long, prompt string, completion string, other int"))
    assert [(r.turn, r.role, r.text) for r in frame_turns.collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, x int"))


# the pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.01"
    docs = read_table(spark, folder, "documents")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, folder)
        rows = {r.doc_id: r for r in out.collect()}
        assert set(rows) <= set(before) and rows, name
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns and all(before[i] == r for i, r in rows.items())
        if name == "quality":
            labels = {r.doc_id: r.quality for r in read_table(spark, folder, "labels").collect()}
            good = [i for i in before if labels.get(i) == 1]
            assert sum(i in rows for i in good) > 0.95 * len(good)
        elif name == "near_duplicates":
            want = components_by_hand({i: r.text for i, r in before.items()}, 5)
            assert set(rows) == {i for i, (_, c) in want.items() if i == c}
        elif name == "decontamination":
            items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in read_table(spark, folder, "benchmark").collect()]
            holds = {i for i, r in before.items() if any(x in " ".join(re.findall(r"[^\W_]+", r.text.lower())) for x in items)}
            assert set(rows) == set(before) - holds
        elif name == "mixing":
            assert len(rows) > 0.5 * len(before)
        else:
            assert set(rows) == set(before)
        docs = spark.createDataFrame(out.select(docs.columns).collect(), docs.schema)


def test_shards_keep_the_order_of_the_mixture(spark):
    """What the mixing stage has ordered, the sharding stage numbers, from files and from rows in memory, and each shard holds in that order."""
    import corpus_pipeline as pipeline

    from linkweave.session import cut_lineage

    docs = frame(spark, [(k, "t", ("a", "b", None)[k % 17 // 7]) for k in range(700)])
    want = [r.doc_id for r in sorted(mixing.mixed(docs).collect(), key=lambda r: r.position)]
    kept = pipeline.keep_mixture(spark, docs, "")
    for rows in (cut_lineage(kept), spark.createDataFrame(kept.collect(), docs.schema)):
        placed = pipeline.place(spark, rows, "").collect()
        assert [r.doc_id for r in sorted(placed, key=lambda r: r.position)] == want
        assert sorted(r.position for r in placed) == list(range(700))
        assert [(r.shard, r.position) for r in placed] == sorted((r.shard, r.position) for r in placed)


@pytest.mark.parametrize("name", ["op5_sharding", "op7_near_duplicates", "op10_chat"])
def test_queries_match_sql(spark, folder, name):
    import duckdb

    df = entry.queries()[name](spark, folder)
    rows = sorted(str(tuple(r)) for r in df.collect())
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert rows == sorted(map(str, db.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()))


# 8 again: names within an article, and pages that never close what they open

def test_names_within_an_article_are_hints():
    page = (
        '<html><body><nav><a href=x>Home</a></nav><article><h2 id="search-and-rescue">Search and rescue</h2><p>Text one, two.</p>'
        '<h2 id="tags">Tags</h2><section id="related-work"><h3>Related work</h3><p>Others did this too, in part.</p></section>'
        '<p class="social">A social matter.</p><section class="related-reading"><a href=1>One more</a> <a href=2>Two more</a></section>'
        '<p class="advert">Buy now.</p><div class="comments"><p>First!</p></div></article><footer>Imprint</footer></body></html>'
    )
    assert html_text.main_text(page).split("\n") == [
        "Search and rescue", "Text one, two.", "Tags", "Related work", "Others did this too, in part.", "A social matter."
    ]


def test_malformed_pages_take_linear_time():
    import time

    def seconds(page):
        start = time.process_time()
        html_text.main_text(page)
        return time.process_time() - start

    for make in (
        lambda n: "<xa " * n, lambda n: "<xa " * n + "'>", lambda n: "<article>" + "<div><p>x" * n, lambda n: "<div>" * n + "text" + "</div>" * n,
        lambda n: "<p><table><td>" + "<div>" * n, lambda n: "<ul>" + "<li>a" * n, lambda n: "<b x='" * n, lambda n: "</p>" * n + "<p>" * n,
    ):
        few, many = seconds(make(8_000)), seconds(make(64_000))
        assert many < 24 * max(few, 0.02)  # eight times as much, not sixty-four
    assert html_text.main_text("<article>" + "<div>" * 50_000 + "<p>deep text</p>").endswith("deep text")
    assert html_text.main_text("<article><p>a < b and <q c='d > e</p><p>f</p></article>").endswith("f")


def test_extraction_of_odd_tables(spark):
    rows = [(1, None, "u", "t"), (2, "", None, "t"), (3, "<article><p>One, two.</p></article>", "u", "t"), (3, "<article><p>One, two.</p></article>", "u", "t"), (None, "<p>x" * 9_000, "u", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = html_text.extracted(pages).collect()
    assert len(got) == 5 and sorted((r.page_id, r.text) for r in got if r.page_id) == [(1, ""), (2, ""), (3, "One, two."), (3, "One, two.")]
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extracted(pages.limit(0)).count() == 0
