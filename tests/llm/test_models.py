"""SentencePiece, LM scoring, mixing and WARC."""

import collections
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_viterbi_equals_the_library_and_brute_force(odd, empty):
    import sentencepiece

    from peerskill.llm.pieces import MODEL, Vocabulary, decoded, encode_decode, encoded

    v, sp = Vocabulary.load(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(2)
    for _ in range(1500):
        t = "".join(rng.choice(" \n\tabcdeñ ü漢😀theing.,  ") for _ in range(rng.randrange(70)))
        assert v.encode(t).tolist() == sp.encode(t)
        assert v.stretch(" " + t) == v.encode(t).tolist() or not t
        assert v.decode(sp.encode(t)) == t
    tiny = Vocabulary("unigram", {}, {}, list(range(256)), 0, -50.0, [], [], set(), True, True, 3)
    names = {"a": -2.0, "b": -2.5, "ab": -3.9, "ba": -4.0, "aba": -6.1, "bab": -6.4}
    for i, (name, score) in enumerate(names.items()):
        node = tiny.trie
        for ch in name:
            node = node.setdefault(ch, {})
        node[""] = (1000 + i, score)
    ids = {1000 + i: n for i, n in enumerate(names)}
    for n in range(1, 40):
        s = "".join(rng.choice("ab") for _ in range(n))
        best = [0.0] + [-1e9] * n
        for j in range(1, n + 1):
            best[j] = max(best[j - k] + names.get(s[j - k : j], -1e9) for k in (1, 2, 3) if k <= j)
        got = [ids[i] for i in tiny.stretch(s)]
        assert "".join(got) == s and math.isclose(sum(names[x] for x in got), best[n])
    out = encode_decode(odd, carry=("n_words",))
    assert out.count() == odd.count() and out.where("not round_trip").count() == 0 and "n_words" in out.columns
    back = {r.text for r in decoded(encoded(odd, v), v).collect()}
    assert back == {r.text or "" for r in odd.select("text").collect()}
    assert encode_decode(empty).count() == 0


def test_lm(spark, odd, empty):
    from peerskill.llm import attention as A
    from peerskill.llm.lm import lm_scores

    rng = np.random.default_rng(0)
    c = A.Classes(np.r_[rng.integers(0, 99, 500), 0, 0], np.arange(502) % 2 == 0)
    p = {k: x.astype(float) for k, x in A.start(c).items()}
    tokens, targets = c.vector[rng.integers(0, 502, (3, A.WINDOW))], c.of[rng.integers(0, 502, (3, A.WINDOW))]
    scored = rng.random(tokens.shape) < 0.7
    _, g = A.gradients(p, tokens, targets, scored)
    for k in p:
        i = (tokens[0, 0], 1) if k == "vectors" else tuple(0 for _ in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs(g[k][i] - (A.gradients(up, tokens, targets, scored)[0] - A.gradients(down, tokens, targets, scored)[0]) / 2e-5) < 1e-6
    q = {k: x.astype(np.float32) for k, x in p.items()}
    total = np.zeros(scored.sum())
    for k in range(A.CLASSES):  # the classes of both kinds add up to one each
        total += np.exp(A.log_probabilities(q, tokens, np.full_like(targets, k), scored)[0])
    assert np.allclose(total, 2, atol=1e-3)
    later = tokens.copy()
    later[:, -1] = 0
    same = A.log_probabilities(q, later, targets, np.ones_like(scored))[0].reshape(3, -1)[:, :-1]
    assert np.allclose(same, A.log_probabilities(q, tokens, targets, np.ones_like(scored))[0].reshape(3, -1)[:, :-1])  # causal
    for n in (0, 1, A.WINDOW, A.WINDOW + 1, 500):
        places, once = A.windows(np.array([3, n, 7]))
        assert sorted(places[once].tolist()) == list(range(n + 10))
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id > 12"))
    rows = [(r.doc_id, WORD.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    count = collections.Counter(x for d, w in rows if not held(d) for x in (*w, None))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held(d), len(w) + 1, sum(count[x] > 0 for x in (*w, None)), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in (*w, None)), 5)) for d, w in rows)
    got = lm_scores(docs, frequent=500).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scores(empty).count() == 0


def test_lm_trains_on_texts_of_every_length():
    from peerskill.llm import attention as A
    from peerskill.llm.lm import Chunk, _windows

    length = np.arange(100)
    token = np.arange(length.sum())
    chunk = Chunk(length, length, length * 0, length % 10 == 0, (length > 0).astype(int), np.arange(99), length[1:], token)
    before, target, scored = _windows(chunk, 9999)
    want = [x for n, first in zip(length, np.cumsum(length) - length, strict=True) if n % 10 for x in (*range(first, first + n), 9999)]
    assert sorted(target[scored].tolist()) == sorted(want) and before.shape[1] == A.WINDOW


def test_attention_context_and_vectors():
    from peerskill.llm import attention as A

    places, scored = A.windows(np.array([1000]))
    assert ((places - places[:, :1])[scored & (places >= A.WINDOW)] >= 8).all()  # tokens of context
    assert len(set(A.Classes(np.arange(5000), np.arange(5000) % 2 == 0).vector.tolist())) == 4096


def test_lm_continuations_do_not_depend_on_partitions(spark, monkeypatch):
    from peerskill.llm import lm as L

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    one = {r.doc_id: r.score for r in L.lm_scores(docs.repartition(1), rounds=0).collect()}
    monkeypatch.setattr(L, "CONTINUATIONS", 500)  # most are joined
    many = {r.doc_id: r.score for r in L.lm_scores(docs.repartition(8), rounds=0).collect()}
    assert len(one) > 20 and one.keys() == many.keys() and all(math.isclose(one[d], many[d], rel_tol=1e-6) for d in one)


def test_keys_of_continuations_differ():
    from peerskill.llm.lm import Continuations, _paths

    token = np.arange(1, 2000)
    path = _paths(np.repeat(token, 2), np.full(len(token), 2))[0][1::2]  # beginnings of one subword
    steps = np.arange(-1, 2000)
    keys = np.concatenate([Continuations.key(np.full(len(steps), x), steps) for x in path[:500]])
    assert len(np.unique(keys)) == len(keys)


def test_scores_against_plain_loops(spark, monkeypatch):
    """Each token's probability found one by one: counts of word beginnings, discounts, classes, and attention over its window."""
    import sentencepiece

    from peerskill.llm import attention as A
    from peerskill.llm import lm as L

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    rows = [(r.doc_id, WORD.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for r in docs.collect()]
    raw = open(L.MODEL, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    end, begins = sp.get_piece_size(), np.append(L._begins(raw), True)
    ids = {w: tuple(sp.encode(w)) for _, ws in rows for w in ws}
    after, per_id = collections.defaultdict(collections.Counter), np.zeros(end + 1)
    for d, ws in rows:
        if zlib.crc32(str(d).encode()) % 10:
            per_id[end] += 1
            for t in map(ids.get, ws):
                np.add.at(per_id, list(t), 1)
                for i in range(1, len(t) + 1):
                    after[t[:i]][t[i] if i < len(t) else -1] += 1
    classes = A.Classes(per_id, begins)
    p = {k: v.astype(float) for k, v in A.start(classes).items()}

    def scored(ws):
        stream, word, total = [*(t for w in ws for t in ids[w]), end], [], 0.0
        so_far = [x for w in ws for x in (ids[w][:i] for i in range(len(ids[w])))] + [()]
        before_word = [None, *ws]
        n, at_word = 0, []
        for w in ws:
            at_word += [n] + [None] * (len(ids[w]) - 1)
            n += 1
        at_word.append(n)
        for i, t in enumerate(stream):
            first = max(0, -(-(i + 1 - A.WINDOW) // (A.WINDOW - A.OVERLAP))) * (A.WINDOW - A.OVERLAP)
            seen = [classes.vector[stream[j - 1] if j else end] for j in range(first, i + 1)]
            x = p["vectors"][seen]
            q, k, v = np.split(x @ p["qkv"], 3, axis=1)
            s = np.exp(np.clip(q[-1] / np.sqrt(A.WIDTH) @ k.T, -20, 20)) * np.exp(p["near"][np.arange(len(seen))[::-1]])
            h = np.r_[x[-1], s / s.sum() @ v]
            logits = h @ p["out"] + p["bias"]
            begin, c = 1 / (1 + np.exp(-logits[-1])), classes.of[t]
            kind = slice(0, A.START) if c < A.START else slice(A.START, A.CLASSES)
            own = logits[c] - np.log(np.exp(logits[kind]).sum()) + classes.log_in_class[t]
            path = () if at_word[i] == 0 else ids[before_word[at_word[i]]] if at_word[i] is not None else so_far[i]
            step = -1 if begins[t] else t
            node = after.get(path, {}) if path else {}
            share = max(0, node.get(step, 0) - L.DISCOUNT) / sum(node.values()) if node.get(step) else 0.0
            left = len(node) * L.DISCOUNT / sum(node.values()) if node else 1.0
            if not path:
                total += own  # at the start of a text a word begins
            elif begins[t]:
                total += np.log(share + left * begin) + own
            else:
                total += np.log(share + left * (1 - begin) * np.exp(own))
        return total / np.log(10)

    want = {d: scored(ws) for d, ws in rows}
    for most in (L.CONTINUATIONS, 300):
        monkeypatch.setattr(L, "CONTINUATIONS", most)
        got = {r.doc_id: r.score for r in L.lm_scores(docs, rounds=0).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[d], want[d], rel_tol=2e-5, abs_tol=1e-4) for d in want), [(d, got[d], want[d]) for d in want if not math.isclose(got[d], want[d], rel_tol=2e-5, abs_tol=1e-4)][:5]


def test_raking(spark, odd, empty, monkeypatch):
    from peerskill.llm import mixing as M

    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, x, t, int(rng.integers(1, 900))) for s in "abc" for x in "xy" for t in "pq"], columns=[*M.DIMENSIONS, "n_tokens"])
    mixture = M.Mixture(shares={"source": {"a": 0.5, "b": 0.3, "c": 0.2}}, temper={"lang": 0.5})
    w = M.rake(cells, mixture) * cells["n_tokens"]
    total = cells["n_tokens"].sum()
    assert np.allclose(w.groupby(cells["source"]).sum() / total, [0.5, 0.3, 0.2])
    lang = cells.groupby("lang")["n_tokens"].sum() ** 0.5
    assert np.allclose(w.groupby(cells["lang"]).sum() / total, lang / lang.sum())
    monkeypatch.setattr(M, "ROUNDS", 2)
    df = spark.createDataFrame(cells)
    few = M.cell_weights(df, mixture, 1).toPandas().sort_values([*M.DIMENSIONS])
    own = M.cell_weights(df, mixture).toPandas().sort_values([*M.DIMENSIONS])
    assert np.allclose(few["probability"], own["probability"]) and own["probability"].max() == 1
    out = M.mix(odd).collect()
    assert len(out) == odd.count() and all(r.sampled for r in out if r.n_tokens == 0)
    assert M.sampled_documents(odd).columns == odd.columns
    assert M.mix(empty).count() == 0 and M.sampled_documents(empty).count() == 0


def test_one_odd_row_does_not_set_all_probabilities(spark):
    from peerskill.llm import mixing as M

    cells = pd.DataFrame([(s, x, "p", n) for s, n in (("a", 90_000), ("b", 60_000)) for x in ("en", "de")], columns=[*M.DIMENSIONS, "n_tokens"])
    odd = pd.concat([cells, pd.DataFrame([("(none)", "en", "p", 5)], columns=cells.columns)])
    kept = []
    for c in (cells, odd):
        out = M.cell_weights(spark.createDataFrame(c), M.FLATTENED).toPandas().merge(c, on=[*M.DIMENSIONS])
        kept.append((out["probability"] * out["n_tokens"]).sum() / out["n_tokens"].sum())
    assert kept[1] > kept[0] - 0.01


def test_warc(spark):
    from peerskill.llm.warc import MAGIC, digest, read_warc, write_warc

    rng = random.Random(4)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(40_000))
    rows = [(1, "http://a/ b", "same", 1), (2, None, "same", 1), (2, None, "same", 1), (None, "u", "same", 1), (3, "u", None, 1), (4, "u", "", 1), (5, "u", noise, 1)]
    rows += [(10 + i, "u", noise[: rng.randrange(9000)], 1) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = tempfile.mkdtemp(prefix="run-warc-") + "/w"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        write_warc(pages, path, level=0)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first = {}
    for p, _, h, _ in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = set()
    for p, _, h, _ in rows:
        b, f = (h or "").encode(), first[h or ""]
        later = p is None or p > f
        want.add((p, "revisit" if later else "response", f if later else None, len(b), digest(b)))
    assert got == want
    write_warc(pages.limit(0), path + "0")
    assert read_warc(spark, path + "0").count() == 0
    assert MAGIC == b"\x1f\x8b\x08"


def test_members_cut_by_a_magic(spark):
    """A magic inside a stored member, at every place of the byte ranges."""
    from peerskill.llm import warc as W

    payloads = [bytes([65 + i]) * 300 + W.MAGIC * 2 + b"tail" * i for i in range(9)]
    data = b"".join(W.member(i, "u", p, None, level=0) for i, p in enumerate(payloads))
    path = tempfile.mkdtemp(prefix="run-warc-") + "/x.warc"
    with open(path, "wb") as f:
        f.write(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (200, 611, 5000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = {r.page_id: bytes(r.payload) for r in W.read_warc(spark, path).collect()}
            assert got == dict(enumerate(payloads))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
