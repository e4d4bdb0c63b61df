"""Filter audit, sharding and spelling variants against plain loops, on odd and empty tables."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "", r["source"] or "") for r in df.select("doc_id", "text", "source").collect()]


def brute_audit(rows, labels):
    """Each order walked document by document."""
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    fails = []
    for d, t, part in rows:
        w = WORD.findall(t)
        own = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d,
        }
        fails.append((part, {k for k, v in own.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        left = {i: None for i in range(len(fails))}
        for step, f in enumerate(order, 1):
            for part in {x[0] for x in fails}:
                mine = [i for i, x in enumerate(fails) if x[0] == part]
                gone = [i for i in mine if i in left and f in fails[i][1]]
                shapley[part, f] += len(gone)
                kept = [i for i in mine if i in left and i not in gone]
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(i not in left and f in fails[i][1] for i in mine), sum(fails[i][1] == {f} for i in mine),
                    sum(fails[i][2] for i in gone), sum(fails[i][3] for i in gone),
                ]
            left = {i: None for i in left if f not in fails[i][1]}
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    from peerskill.llm.filter_audit import filter_audit

    rows = filter_audit(docs, labels).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


LABELS = [(d, d % 2, d % 3 // 2) for d in range(13)] + [(None, 1, 1), (3, None, 1), (4, None, None), (99, 1, 1)]


def test_filter_audit(spark, odd, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute_audit(rows_of(odd), LABELS)
    assert audited(odd, labels) == want and len(want) == 600 * len({p for p, *_ in want})
    assert audited(odd, labels.limit(0)) == brute_audit(rows_of(odd), [])
    assert audited(empty, labels) == {}


def test_potentials_give_shapley_values(spark):
    from pyspark.sql import functions as F

    from peerskill.llm.filter_audit import potentials

    rng = random.Random(5)
    game = [0] + [rng.randrange(1000) for _ in range(15)]
    got = spark.range(1).select(potentials(F.array(*map(F.lit, game)).cast("array<long>"), 4).alias("p")).first().p
    for i in range(4):
        each = [game[s | 1 << i] - game[s] for o in permutations(range(4)) for s in [sum(1 << j for j in o[: o.index(i)])]]
        assert 2 * (got[15] - got[15 ^ 1 << i]) == sum(each)  # 4! orders, potentials times 12


def brute_shards(rows, shards, dims):
    """Recursive k-d tree over lists of (doc_id, size, crc, *dims)."""
    ranks = [{id(r): i for i, r in enumerate(sorted(rows, key=lambda r: (r[3 + d], r[2], r[0] is not None, r[0] or 0)))} for d in range(dims)]
    out = {}

    def split(node, first, leaves):
        if leaves == 1:
            out[first] = node
            return
        if not node:
            split(node, first, leaves // 2)
            split(node, first + leaves // 2, leaves - leaves // 2)
            return
        width = [max(k[id(r)] for r in node) - min(k[id(r)] for r in node) for k in ranks]
        key = ranks[width.index(max(width))]
        node, total, at, n = sorted(node, key=lambda r: key[id(r)]), sum(r[1] for r in node), 0, 0
        while (at + node[n][1]) * leaves < total * (leaves // 2):
            at += node[n][1]
            n += 1
        n += 1 if (at + node[n][1]) * leaves - total * (leaves // 2) <= total * (leaves // 2) - at * leaves else 0
        split(node[:n], first, leaves // 2)
        split(node[n:], first + leaves // 2, leaves - leaves // 2)

    split(rows, 0, shards)
    return out


def metadata_of(rows):
    return [(d, len(t.encode()) + 8, zlib.crc32(t.encode()), len(t.encode()), 1000 * len(t.encode()) // max(len(t), 1), 1000 * len(t) // (t.count(" ") + 1)) for d, t, _ in rows]


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding(spark, odd, empty, shards):
    from peerskill.llm.sharding import shard_documents

    rng = random.Random(shards)
    many = [(i, " ".join(rng.choice(["ab", "é", "word", "漢字"]) for _ in range(rng.randrange(40))) if i % 3 else "the same text", "s") for i in range(400)]
    for docs, rows in ((odd, rows_of(odd)), (spark.createDataFrame(many, "doc_id long, text string, source string"), many)):
        got = shard_documents(docs, shards).collect()
        want = brute_shards(metadata_of(rows), shards, 3)
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == Counter((*r[:3], k) for k, v in want.items() for r in v)
        for k, v in want.items():
            assert sorted(r.slot for r in got if r.shard == k) == list(range(len(v)))
        assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    sizes = [sum(r[1] for r in v) for v in want.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for v in want.values() for r in v) * math.ceil(math.log2(shards) + 1)
    parted = Counter(t for v in want.values() for t in {r[2] for r in v})
    assert sum(n - 1 for n in parted.values()) <= shards - 1  # a median parts one group of equal texts at most
    assert shard_documents(empty, shards).count() == 0


def test_sharding_by_target_bytes(spark):
    from peerskill.llm.sharding import kd_shards

    rows = spark.range(1000).selectExpr("id as doc_id", "10L as size", "id * 7 % 13 as text_crc32", "if(id % 5 = 0, null, cast(id % 17 as string)) as source", "id % 3 as lang")
    got = kd_shards(rows, ["source", "lang"], target_bytes=1250).groupBy("shard").sum("size").collect()
    assert sorted(r[1] for r in got) == [1250] * 8


def brute_spelling(rows):
    count = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    around = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(around[w]), words.get(form[w]))
    return out


def test_spelling_variants(spark, odd, empty):
    from peerskill.llm.spelling import spelling_variants

    rng = random.Random(11)
    base = ["aabbaa", "letters", "éclair", "Spelling", "mississippi", "×÷aaaa"]
    text = []
    for w in base:
        text += [w] * 2000
        for _ in range(60):
            x, i = w, rng.randrange(len(w))
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("abÿZ") + x[i:], x[:i] + rng.choice("abÿz") + x[i + 1 :]])
            text += [x] * rng.choice([3, 5, 6, 40, 300])
    rng.shuffle(text)
    rows = [(i if i else None, rng.choice([" ", "7", "漢", "\n"]).join(text[i::50]), None) for i in range(50)] + [(7, None, None), (8, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").union(odd.select("doc_id", "text", "source"))
    got = spelling_variants(docs).collect()
    want = brute_spelling(rows_of(docs))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(v[1] not in (w, v[0]) for w, v in want.items())  # a chain of forms
    assert spelling_variants(empty).count() == 0
