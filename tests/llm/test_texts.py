"""Operators on whole texts against brute force, and on odd and empty tables."""

import collections
import hashlib
import random
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def brute_bytes(rows, n):
    count = collections.Counter(t.encode()[i : i + n] for _, t in rows for i in range(len(t.encode()) - n + 1))
    out = []
    for d, t in rows:
        b, gone = t.encode(), np.zeros(len(t.encode()) + 1, bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2] if len(b) else [])).sum()) if len(b) else 0, kept))
    return out


def key(x):
    return repr(x)


def test_suffix_dedup(spark, odd, empty):
    from peerskill.llm.suffix_dedup import repeated, suffix_dedup

    for n in (40, 400):
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(odd, n).collect()]
        assert sorted(got, key=key) == sorted(brute_bytes(rows_of(odd), n), key=key)
    assert suffix_dedup(empty).count() == 0
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(3000)) * 2
    starts = np.arange(len(data) - 64)
    seen = collections.Counter(data[i : i + 64] for i in starts)
    assert repeated(data, starts, 64).tolist() == [i for i in starts if seen[data[i : i + 64]] > 1]


def brute_words(rows, k):
    first = {}
    for d, t in rows:
        w = WORD.findall(t)
        for i in range(len(w) - k + 1) if d is not None else ():
            x = tuple(w[i : i + k])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, t in rows:
        w, gone = WORD.findall(t), set()
        for i in range(len(w) - k + 1) if d is not None else ():
            if first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substring_dedup(odd, empty):
    from peerskill.llm.substring_dedup import substring_dedup

    got = [tuple(r) for r in substring_dedup(odd).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows_of(odd), 13), key=key)
    assert substring_dedup(empty).count() == 0


def test_fingerprints(odd, empty):
    from peerskill.llm.fingerprint import fingerprints

    got = fingerprints(odd).collect()
    rows = sorted(((d, t) for d, t in rows_of(odd) if d is not None), key=lambda x: -x[0])
    ids = sorted({d for d, _ in rows}, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    edited = {
        (d, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest())
        for d, t in rows for e, n in rows if e in (d, after[d])
    }
    for r in got:
        assert r.doc_id is None or (r.doc_id, r.edited_sha256) in edited
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {}
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.n_chars)), sorted(rows_of(odd), key=lambda r: (r[0] or 0, len(r[1]))), strict=True):
        by.setdefault(t, set()).add(r.fingerprint)
    assert all(len(v) == 1 for t, v in by.items() if "of that id" not in t and "of a repeated" not in t)
    assert fingerprints(empty).count() == 0


def test_statistics_rules_and_classifier(spark, odd, empty):
    from peerskill.llm import boosted, quality_rules
    from peerskill.llm.stats import COUNTS, counts

    texts = [t for _, t in rows_of(odd)] + ["a b\na b\n\n a b\nc # d e f g # d e f g"]
    got = counts([t.encode() for t in texts])
    assert sorted(got) == sorted(COUNTS)
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        again = {j + k for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(set(w)))
        assert tuple(int(got[c][i]) for c in [*COUNTS[:5], "n_distinct_words"]) == want
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(13)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd, odd.count()), (empty, 0)):
        assert quality_rules.quality_rules(docs, labels).count() == n
        assert boosted.quality_classifier(docs, labels.limit(0)).count() == n
        assert quality_rules.clean_documents(docs, labels).columns == docs.columns
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    bad = ((x[:, 0] > 1) & (x[:, 2] < 0)) | (x[:, 3] < -1.5)
    rules = quality_rules.learn(x, bad, list("abcd"))
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= np.logical_and.reduce([(x[:, "abcd".index(n)] >= t) if op == ">=" else (x[:, "abcd".index(n)] < t) for n, op, t in r.tests])
    assert (hit == bad).mean() > 0.97
    forest = boosted.fit(x[:2000], ~bad[:2000])
    assert ((forest.score(x[2000:]) >= 0.5) == ~bad[2000:]).mean() > 0.95
    assert boosted.fit(np.zeros((0, 4)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0.5, 0.5]


def test_near_duplicates(spark, odd, empty):
    from peerskill.llm.near_dedup import near_duplicates, without_near_duplicates

    rng = random.Random(5)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice((3, 8, 120)))] for _ in range(12)]
    docs = []
    for i in range(260):
        w = list(base[0] if i % 3 == 0 else base[rng.randrange(12)])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in docs for w in [t.lower().split()]}
    label = {d: d for d in sets}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for more in ({}, {"leaf": 4, "levels": 2, "group_elements": 400}):  # the second: deep trees, and groups confirmed in blocks
        assert {r.doc_id: r.component_id for r in near_duplicates(df, **more).collect()} == label
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7} and {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4, 5, 6}
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    kept = [r.doc_id for r in without_near_duplicates(odd).collect()]
    assert kept.count(None) == 2 and kept.count(3) == 0 and kept.count(12) == 1 and kept.count(8) == 0
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_among_frequent_lines(spark):
    """Texts of 12 lines out of 60: nodes stay large for many levels, and planted pairs that differ in one word must still meet."""
    from peerskill.llm.near_dedup import near_duplicates

    rng = random.Random(8)
    lines = [" ".join(f"l{i}w{j}" for j in range(8)) for i in range(60)]
    docs = []
    for i in range(700):
        own = " ".join(rng.sample(lines, 12)).split()
        docs.append((2 * i, " ".join(own)))
        own[rng.randrange(40, 50)] = f"x{i}"
        docs.append((2 * i + 1, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, trees=2, leaf=16, levels=1).collect()}
    assert sum(got[d] == d - d % 2 for d in got) >= 0.99 * len(got)


def test_near_duplicates_that_met_at_a_pivot_do_not_branch_again(spark, monkeypatch):
    """Below the first level only nodes are judged in which more than a few classes did not meet at one pivot before."""
    from pyspark.sql import functions as F

    from peerskill.llm import near_dedup as N

    rng = random.Random(11)
    base, line = [f"b{i}" for i in range(150)], [f"c{i}" for i in range(12)]
    docs = []
    for i in range(120):  # near copies, and texts that share a line only
        w = list(base)
        w[rng.randrange(1, 149)] = f"n{i}"
        docs.append((i, " ".join(line + w)))
        docs.append((1000 + i, " ".join(line + [f"o{i}x{j}" for j in range(20)])))
    judged, seen = N._judged, []

    def watch(big, classes, percent, name):
        if name != "judged_1":
            own = big.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"))
            seen.extend((r.n, r.most) for r in own.collect())
        return judged(big, classes, percent, name)

    monkeypatch.setattr(N, "_judged", watch)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), leaf=4, levels=1).collect()}
    assert all(n - most > 4 for n, most in seen)
    assert got == {d: 0 if d < 1000 else d for d, _ in docs}
    # a node of one label is done, in another the ones that differ are asked
    rows = [(1, 0, 1, 7), (1, 0, 2, 7), (2, 0, 1, 7), (2, 0, 2, 7), (2, 0, 3, 3)]
    nodes = N._nodes(spark.createDataFrame(rows, "key long, coord int, id long, label long"), "test_nodes").collect()
    assert sorted((r.key, r.id, r.n, r.others, r.alike) for r in nodes) == [(2, 1, 3, 1, True), (2, 2, 3, 1, True), (2, 3, 3, 1, False)]
