"""Manifest, resampling and line dedup next to brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from linkweave.llm import line_dedup, merkle, resampling
from linkweave.llm.crc_spans import REACH, crc32_spans
from linkweave.plans.tables import read_table

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, score string, n_lines string, rank int, a int, id int, lines string"
LONG = "long words here and there, " * 8000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if k % 4 == 1 else "en", s, None if k % 5 == 2 else len(t or ""), "x", "y", "z", 7, 8, 9, "l") for k, (i, t, s) in enumerate(rows)], FIELDS)


@pytest.fixture(scope="module")
def odd(spark):
    line = "  One line of MORE than forty characters, É kept\t"
    texts = [
        (1, None), (2, ""), (3, "\n\n"), (4, "one"), (4, "one"), (5, f"a\n{line}\nb\n{line}"), (None, f"{line}\nno id"), (None, None), (6, LONG),
        (7, line), (8, line.lower().strip().replace("é", "É")), (9, f"{line}\r\nand \x0b"), (10, f"{line}\n{line}"), (10, f"{line}\nother text of that id"),
        (11, "short"), (11, line[:30]), (12, "é" * 300 + " " + "ü" * 400 + " end " + "w " * 30), (13, "Ünder ß <|x|> \x00 A-b" + " word" * 30),
    ]
    return frame(spark, [(i, t, None if k % 3 else f"s{k % 2}é") for k, (i, t) in enumerate(texts)])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 manifest

def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows, fanout=16):
    """rows: (doc_id, source, lang, n_chars, text) -> for each, sorted: (doc_id, leaf, subroot, root, [siblings])."""

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i - i % fanout : i - i % fanout + fanout]
            out.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            i //= fanout
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(field, r)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(groups[s])]) for s in names}
    top = up([trees[s][-1][0] for s in names])
    return [
        (key if there else None, leaf, trees[s][-1][0], top[-1][0], path(trees[s], i) + path(top, q))
        for q, s in enumerate(names) for i, (there, key, leaf) in enumerate(sorted(groups[s]))
    ]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("fanout, levels", [(2, 1), (3, 2), (16, 3)])
def test_manifest_equals_brute_force(spark, folder, odd, fanout, levels):
    turn = random.Random(fanout)
    many = frame(spark, [(k, f"t{k}", f"s{min(turn.randrange(40), 9)}") for k in range(211)])
    for docs in (odd, many):
        got = [
            (r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof])
            for r in merkle.manifest(docs, carry=("lang", "leaf"), fanout=fanout, levels=levels).collect()
        ]
        want = brute_manifest([tuple(r) for r in docs.select(*merkle.FIELDS).collect()], fanout)
        assert order(got) == order(want)


def test_tampering_is_seen(spark, folder):
    docs = {r.doc_id: tuple(r) for r in read_table(spark, folder, "documents").select(*merkle.FIELDS).collect()}
    rows = {r.doc_id: r for r in entry.queries()["op11_merkle"](spark, folder).collect()}
    want = {r[0]: r for r in brute_manifest(list(docs.values()))}
    assert len(rows) == len(docs) == len(want)
    for i, r in rows.items():
        _, leaf, subroot, root, proof = want[i]
        text = docs[i][4]
        if zlib.crc32(str(i).encode()) % 5 == 0:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        at = sha("".join(map(field, (*docs[i][:4], text))))
        for before, after in proof:
            at = sha(before + at + after)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, sha("".join(b + a for b, a in proof)))
        assert r.folded_root == at and r.verified == (at == root) == (text == docs[i][4])
    assert {r.verified for r in rows.values()} == {True, False}


def test_manifest_of_odd_tables(spark, odd, empty):
    from pyspark.sql import functions as F

    checked = merkle.tamper_checked(odd, F.col("text"))
    assert checked.count() == odd.count() and checked.where("NOT verified").count() == 0
    assert merkle.tamper_checked(empty, F.col("text")).count() == 0
    one = merkle.manifest(odd.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].proof == [] and one[0].leaf == one[0].subroot == one[0].root
    assert merkle.manifest(odd, carry=("lang", "rank")).columns == ["doc_id", "lang", "rank", "leaf", "subroot", "root", "proof"]


# 12 resampling

def test_checksums_of_spans():
    turn = np.random.default_rng(5)
    data = turn.integers(0, 256, 400_000).astype(np.uint8)
    size = np.concatenate([turn.integers(0, 3 * REACH, 500), [0, 1, REACH - 1, REACH, REACH + 1, 2 * REACH, 65_536, 99_999]])
    start = turn.integers(0, 300_000, len(size))
    assert crc32_spans(data, start, start + size).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size, strict=True)]
    assert len(crc32_spans(data[:0], start[:0], start[:0])) == 0


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scores(docs, target):
    """docs: [(id, text)] -> {(id, n_features, weight, score, rank)} as a counter."""

    def buckets(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    here, there = s.total() + 10_000, t.total() + 10_000
    rows = []
    for i, text in docs:
        found = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * here / ((s[b] + 1.0) * there))) for b in found)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, len(words_of(text)) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = 5 * len(able) // 100
    out = Counter((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able))
    out.update((*r[:4], None) for r in rows if not r[4])
    return out


def test_resampling_equals_brute_force(spark, folder, odd):
    target = read_table(spark, folder, "benchmark")
    docs = [(r.doc_id, r.text) for r in read_table(spark, folder, "documents").select("doc_id", "text").collect()]
    texts = [r.text for r in target.collect()]
    got = Counter(tuple(r) for r in entry.queries()["op12_resampling"](spark, folder).collect())
    want = brute_scores(docs, texts)
    assert got == want and sum(r[4] is not None for r in got) == sum(5 for _ in range(len([d for d in docs if len(words_of(d[1])) >= 20]))) // 100
    crowd = odd
    for _ in range(4):
        crowd = crowd.unionByName(odd)
    got = Counter(tuple(r) for r in resampling.scored(crowd, target, carry=()).collect())
    assert got == brute_scores([(r.doc_id, r.text) for r in crowd.select("doc_id", "text").collect()], texts)


def test_resampling_prefers_the_target(spark, folder, odd, empty):
    """Documents with a target's words are drawn before others; all columns come back as they were."""
    rows = [(k, " ".join(f"{'wanted' if k % 20 == 0 else 'plain'}{(k * 7 + j) % 50}" for j in range(40)), "s") for k in range(400)]
    target = spark.createDataFrame([(" ".join(f"wanted{j % 50}" for j in range(500)),)], "text string")
    drawn = resampling.resampled(frame(spark, rows), target)
    assert drawn.columns == frame(spark, rows).columns and sorted(r.doc_id for r in drawn.collect()) == list(range(0, 400, 20))
    assert drawn.schema == frame(spark, rows).schema
    nothing = resampling.scored(empty, target)
    assert nothing.count() == 0 and resampling.resampled(empty, target.limit(0)).count() == 0
    scored = resampling.scored(odd, target.limit(0))
    assert scored.count() == odd.count() and scored.columns == [c for c in odd.columns if c not in ("score", "rank")] + ["n_features", "weight", "score", "rank"]


# 13 line dedup

def brute_lines(docs, least=5):
    """docs: [(id, text)] -> counter of (id, n_lines, n_dropped, kept text)."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least}
    out = Counter()
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines_equal_brute_force(spark, folder, odd):
    for docs in (read_table(spark, folder, "documents"), odd):
        rows = line_dedup.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert Counter(tuple(r) for r in rows) == brute_lines([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(r.n_dropped for r in rows)  # the odd table's shared line


def test_lines_at_the_bounds(spark, empty):
    """Forty characters count, thirty-nine don't; four documents keep a line, five don't; one document's own repeats don't count."""
    forty, short, four, own = "é" * 40, "x" * 39, "y" * 50, "z" * 60
    rows = [(k, f"{forty}\n {short}\n{'' if k == 4 else four}\n{own if k == 0 else k}" + f"\n{own}" * (5 if k == 0 else 0), "s") for k in range(5)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    for k, text, _ in rows:
        assert got[k].text == (text if k == 4 else text.removeprefix(forty + "\n")) and got[k].n_dropped == (k != 4)
    out = line_dedup.deduplicated(empty)
    assert out.count() == 0 and out.columns == [c for c in empty.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
