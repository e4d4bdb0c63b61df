"""MinHash near-dedup by a chosen-path set similarity join.

Documents with equal shingle sets form a class; a class is joined once.  Independent trees branch the classes by the minhash of selected
coordinates; a node with few classes is compared exhaustively on sketches, one with many branches again by other coordinates until few
are left or all but a few are alike to one of them.  Candidate links make coarse groups, in which links are confirmed on the full sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, written
from .components import connected_components
from .text import Words, chunks, mix, window_hashes

#: Words of a shingle; links need 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 80
#: Coordinates of a sketch, trees, classes of a node that are compared exhaustively, first level of a tree whose large nodes are judged.
SKETCH, TREES, LEAF, LEVELS = 64, 16, 128, 1
#: Levels after which what is not alike in a large node is compared with the whole node, in blocks of so many classes.
DEPTH, BLOCK = 10, 1024
#: Share of equal coordinates from which a pair is a candidate: five standard deviations below 0.8.
CANDIDATE = 0.55
#: Set elements of one group that a task confirms at once.
GROUP_ELEMENTS = 1_000_000
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32)


def shingle_sets(own: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles of ``k`` words (A-Z in lower case); of fewer words, of the sequence."""
    w = Words(own, lower=True)
    h = w.hashes()
    grams = window_hashes(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(window_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """Minima of SKETCH hash functions over a non-empty set."""
    x = (mix(elements) >> np.uint64(32)).astype(np.uint32)
    out = np.full(SKETCH, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1 << 14):
        out = np.minimum(out, (x[i : i + (1 << 14), None] * _A + _B).min(axis=0))
    return out


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set) and sketch."""
    def run(batches):
        for rows, own in chunks(batches):
            n, names, sketches, ends = [], [], [], [0]
            for s in shingle_sets(own, k):
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    sketches.append(sketch(s).view(np.int32))
                ends.append(ends[-1] + (SKETCH if len(s) else 0))
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "n_shingles", "set_hash", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sketch array<int>")


def _nodes(keyed: DataFrame, name: str, labelled: bool = True) -> DataFrame:
    """(key, coord, id, label, n, others, alike): the members of the nodes with two labels or more, how many there are, and how many do not
    have the node's most frequent label (alike: has it).  Members with one label were alike to one pivot before, so their pairs are
    covered.  Not ``labelled``: each member has a label of its own."""
    keyed = written(keyed, name)
    if labelled:
        sizes = keyed.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
        sizes = sizes.agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("top"))
        sizes = sizes.where("n > most").select("key", "n", (F.col("n") - F.col("most")).alias("others"), "top")
        alike = F.col("label") == F.col("top")
    else:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("others", F.col("n"))
        alike = F.lit(False)
    sized = keyed.join(written(sizes, name + "_sizes"), "key")
    return written(sized.select("key", "coord", "id", "label", "n", "others", alike.alias("alike")), name + "_sized")


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Share of equal coordinates of the sketches of two columns."""
    x, y = (c.flatten().to_numpy().reshape(-1, SKETCH) for c in (a, b))
    return (x == y).mean(axis=1)


def _judged(big: DataFrame, classes: DataFrame, percent: int, name: str) -> DataFrame:
    """(key, coord, id, label, n, pivot, alike, others): of large nodes one class as pivot, whether each member is a candidate with it, and how
    many are not."""
    own, big = classes.select("id", "sketch", F.col("n_shingles").alias("size")), big.drop("others", "alike")
    pivots = big.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("pivot"))
    pivots = pivots.join(own.select(F.col("id").alias("pivot"), F.col("sketch").alias("p_sketch"), F.col("size").alias("p_size")), "pivot")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column("size").to_numpy(), b.column("p_size").to_numpy()
            alike = (_same(b.column("sketch"), b.column("p_sketch")) >= CANDIDATE) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "coord", "id", "label", "n", "pivot")), pa.array(alike)], names=["key", "coord", "id", "label", "n", "pivot", "alike"])

    both = big.join(own, "id").join(pivots, "key").select("key", "coord", "id", "label", "n", "sketch", "size", "pivot", "p_sketch", "p_size")
    judged = written(both.mapInArrow(run, "key long, coord int, id long, label long, n long, pivot long, alike boolean"), name)
    others = judged.where("not alike").groupBy("key").agg(F.count("*").alias("others"))
    return written(judged.join(others, "key", "left").fillna(0, ["others"]), name + "_others")


def _blocks(judged: DataFrame) -> DataFrame:
    """(key, id, asked): each member that is not alike meets every block of its node."""
    blocks, parts = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("others") / BLOCK)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    own = judged.where("others > 0").select("key", "id", "alike", blocks.alias("blocks"), parts.alias("parts"))
    whole = own.select("key", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), numbers(F.col("parts")).alias("part"), F.lit(False).alias("asked"))
    few = own.where("not alike").select("key", "id", numbers(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).alias("part"), F.lit(True).alias("asked"))
    return whole.unionByName(few).select(F.xxhash64("key", "block", "part").alias("key"), "id", "asked")


def _leaves(classes: DataFrame, trees: int, leaf: int, levels: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, id, asked) of the small nodes and blocks of all trees, in which each pair with an asked class is to be compared; candidate
    links (u, v) to the pivots of large nodes."""
    roots = [(t, 4 * t % SKETCH) for t in range(trees)] + [(t, (4 * t + 2) % SKETCH) for t in range(0, trees, 4)]
    at = F.array(*(F.struct(F.xxhash64(F.lit(t), F.lit(c), F.col("sketch")[c]).alias("key"), F.lit(c).alias("coord")) for t, c in roots))
    now = _nodes(classes.select("id", F.explode(at).alias("x")).select("x.key", "x.coord", "id", F.col("id").alias("label")), "paths_1", labelled=False)
    small = lambda now: now.where(F.col("n") <= leaf).select("key", "id", (~F.col("alike")).alias("asked"))
    out, links = small(now), None
    for level in range(1, DEPTH + 1):
        # where all but a few have one label, these few meet the whole node
        few = (F.col("n") > leaf) & (F.col("others") <= leaf)
        out = out.unionByName(_blocks(now.where(few)))
        big = now.where((F.col("n") > leaf) & ~few)
        if big.isEmpty():
            return out, links
        if level >= levels:
            # what is alike to the pivot is in one coarse group already: when few are not, or on the last level, they meet the whole node
            big = _judged(big, classes, percent, f"judged_{level}")
            stars = big.where("alike and id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v"))
            links = stars if links is None else links.unionByName(stars)
            done = F.col("others") <= (leaf if level < DEPTH else F.col("n"))
            out = out.unionByName(_blocks(big.where(done)))
            big = big.where(~done).withColumn("label", F.when(F.col("alike"), F.col("pivot")).otherwise(F.col("label")))
            if level == DEPTH or big.isEmpty():
                return out, links
        # children by one coordinate, for a quarter of the nodes by two: 1 / 0.8 on average
        step = F.pmod(F.xxhash64("key"), F.lit(SKETCH - 1))
        first = F.pmod(F.col("coord") + 1 + step, F.lit(SKETCH)).cast("int")
        second = F.when(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(4)) == 0, F.pmod(F.col("coord") + 1 + F.pmod(step + 1 + F.pmod(F.xxhash64("key", F.lit(2)), F.lit(SKETCH - 2)), F.lit(SKETCH - 1)), F.lit(SKETCH)).cast("int"))
        child = (
            big.select("key", "id", "label", F.explode(F.filter(F.array(first, second), lambda c: c.isNotNull())).alias("coord"))
            .join(classes.select("id", "sketch"), "id")
            .select(F.xxhash64("key", "coord", F.element_at("sketch", F.col("coord") + 1)).alias("key"), "coord", "id", "label")
        )
        now = _nodes(child, f"paths_{level + 1}")
        out = out.unionByName(small(now))
    return out, links


def _grouped(batches, columns: int):
    """Rows of consecutive equal keys (first column): (key, list of the other columns), across batches."""
    at, held = None, [[] for _ in range(columns - 1)]
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(columns)]
        key = cols[0]
        start = 0
        for i in range(len(key)):
            if key[i] != at:
                if i > start:
                    for h, c in zip(held, cols[1:], strict=True):
                        h += c[start:i]
                if held[0]:
                    yield at, held
                at, start, held = key[i], i, [[] for _ in range(columns - 1)]
        for h, c in zip(held, cols[1:], strict=True):
            h += c[start:]
    if held[0]:
        yield at, held


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _stars(close: np.ndarray, ids: list[int]) -> list[tuple[int, int]]:
    """A star for each component of an adjacency matrix."""
    left, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            new = np.flatnonzero(close[queue.pop()] & left)
            left[new] = False
            out += [(ids[i], ids[j]) for j in new.tolist()]
            queue += new.tolist()
    return out


def _candidates(leaves: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate links (u, v) that connect what is alike in some node: all pairs with an asked class are compared, a spanning forest is
    returned."""
    rows = leaves.join(classes.select("id", "n_shingles", "sketch"), "id").select("key", "id", "n_shingles", "sketch", "asked")

    def run(batches):
        pairs: list[tuple[int, int]] = []
        for _, (ids, n, sk, asked) in _grouped(batches, 5):
            s, size = np.array(sk, np.int32), np.array(n)
            if len(ids) == 2:
                if any(asked) and (s[0] == s[1]).mean() >= CANDIDATE and 100 * size.min() >= percent * size.max():
                    pairs.append((ids[0], ids[1]))
            else:
                alike = np.zeros((len(ids), len(ids)), bool)
                for i in np.flatnonzero(asked).tolist():
                    alike[i] = (s == s[i]).mean(axis=1) >= CANDIDATE
                alike |= alike.T
                alike &= 100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size)
                pairs += _stars(alike, ids)
            if len(pairs) > 10_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def confirmed(ids: list[int], sets: list[np.ndarray], percent: int, only: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly what the pairs with 100 * intersection >= percent * union connect.

    Breadth first: a document is compared with those that nothing has reached yet.  With ``only`` (mask) just the pairs with such a
    document count, and every pair is compared."""
    n = len(ids)
    size = np.fromiter(map(len, sets), np.int64, n)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [flat[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
    mark = np.zeros(int(flat.max()) + 1, bool)

    def linked(x: int, rest: np.ndarray, joined: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mark[own[x]] = True
        common = np.add.reduceat(mark[joined], starts, dtype=np.int64)
        mark[own[x]] = False
        return rest[100 * common >= percent * (size[x] + size[rest] - common)]

    def packed(rest: np.ndarray):
        return np.concatenate([own[i] for i in rest.tolist()]), np.concatenate(([0], np.cumsum(size[rest])[:-1]))

    out: list[tuple[int, int]] = []
    if only is not None:
        rest = np.arange(n)
        joined, starts = packed(rest)
        for x in np.flatnonzero(only).tolist():
            out += [(ids[x], ids[y]) for y in linked(x, rest, joined, starts).tolist() if y != x]
        return out
    left = np.ones(n, bool)
    rest = np.arange(n)
    joined, starts = packed(rest)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            if left[rest].sum() * 4 < len(rest) * 3:
                rest = rest[left[rest]]
                if not len(rest):
                    return out
                joined, starts = packed(rest)
            x = queue.pop()
            new = linked(x, rest, joined, starts)
            new = new[left[new]]
            left[new] = False
            out += [(ids[x], ids[y]) for y in new.tolist()]
            queue += new.tolist()
    return out


def _confirm(rows: DataFrame, percent: int, only: bool = False) -> DataFrame:
    """rows: key, id, elements (and asked); links within each key."""
    def run(batches):
        for _, held in _grouped(batches, 4):
            sets = [np.frombuffer(x, np.uint64) for x in held[1]]
            yield _edges(confirmed(held[0], sets, percent, np.array(held[2], bool) if only else None) if len(sets) > 1 else [])

    return rows.select("key", "id", "elements", "asked").repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, k: int, percent: int, most: int) -> DataFrame:
    """Links confirmed on full sets within the coarse groups (node, component).

    A group with at most ``most`` set elements is confirmed by one task.  A larger one in blocks, each also with some members of the
    block before: what is tightly linked falls into one component.  Every member outside the group's largest component is then compared
    with all members of the group, block by block, so no pair of different components goes unseen."""
    sizes = written(
        groups.join(classes.select(F.col("id").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.sum("n_shingles").alias("elements")), "near_sizes"
    )
    placed = written(groups.join(sizes, "component"), "near_groups")

    def run(batches):
        for rows, own in chunks(batches):
            sets = [s.tobytes() for s in shingle_sets(own, k)]
            yield pa.RecordBatch.from_arrays([rows.column("component"), rows.column("id"), rows.column("size"), pa.array(sets, pa.binary())], names=["component", "id", "size", "elements"])

    members = placed.select(F.col("node").alias("doc_id"), "component", F.col("elements").alias("size"))
    sets = written(
        docs.hint("merge").join(members, "doc_id").select("component", F.col("doc_id").alias("id"), "size", "text")
        .mapInArrow(run, "component long, id long, size long, elements binary").where(F.octet_length("elements") > 0), "near_sets"
    )
    links = written(_confirm(sets.where(F.col("size") <= most).select(F.col("component").alias("key"), "id", "elements", F.lit(False).alias("asked")), percent), "near_links")
    big = sets.where(F.col("size") > most)
    if big.isEmpty():
        return links
    parts = F.ceil(F.col("size") / most)
    big = big.withColumns({"parts": parts, "block": F.pmod(F.xxhash64("id"), parts)})
    also = F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(32)) == 0, F.pmod(F.col("block") + 1, F.col("parts")))
    spread = big.withColumn("at", F.explode(F.array_distinct(F.filter(F.array("block", also), lambda x: x.isNotNull()))))
    near = written(_confirm(spread.select(F.xxhash64("component", "at").alias("key"), "id", "elements", F.lit(False).alias("asked")), percent), "near_links_blocks")
    label = connected_components(near).withColumnRenamed("component", "label")
    named = written(big.select("component", "id", F.octet_length("elements").alias("bytes")).join(label, F.col("id") == F.col("node"), "left").select("component", "id", "bytes", F.coalesce("label", "id").alias("label")), "near_named")
    most_of = named.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = written(named.join(most_of, "component").where("label <> main").select("component", "id", "bytes").distinct(), "near_rest")
    if rest.isEmpty():
        return links.unionByName(near)
    asked = rest.groupBy("component").agg(F.ceil(F.sum("bytes") / (8 * most)).alias("asks"))
    asked = written(asked, "near_asks")
    ask = rest.join(asked, "component").select("component", "id", F.pmod(F.xxhash64("id", F.lit(2)), F.col("asks")).alias("ask"))
    # every block of the group meets every part of the rest
    whole = big.join(asked, "component").withColumn("ask", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("asks") - 1))).select("component", "block", "ask", "id", "elements", F.lit(False).alias("asked"))
    few = (
        big.select("component", "id", "elements", "parts").join(ask, ["component", "id"])
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).select("component", "block", "ask", "id", "elements", F.lit(True).alias("asked"))
    )
    meet = whole.unionByName(few).select(F.xxhash64("component", "block", "ask").alias("key"), "id", "elements", "asked")
    return links.unionByName(near).unionByName(_confirm(meet, percent, only=True))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, leaf: int = LEAF,
                    levels: int = LEVELS, group_elements: int = GROUP_ELEMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (doc_id = component_id) of every row of ``docs``.

    Texts without words, null texts and rows without doc_id are linked with nothing; a row without doc_id has a null component_id and is
    kept.  Rows with one doc_id are one document.  Texts with fewer than ``k`` words are linked by equality of the whole sequence.

    A pair with similarity 0.8 misses the candidates only if all ``trees`` separate it or its sketches differ by five standard
    deviations; no node, group or partner count is capped.  From level ``levels`` on a large node is done when all but ``leaf`` of its
    classes are alike to one of them: these few are compared with the whole node.  After DEPTH levels all that are not alike are.  Classes
    alike to one pivot are in one group, so below their node they are not compared with each other again."""
    small_batches(docs.sparkSession, 512)
    own = texts(docs)
    base = written(_sketched(own, k), "near_base")
    classes = written(
        base.where("set_hash is not null and doc_id is not null").groupBy("set_hash", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.min_by("sketch", "doc_id").alias("sketch")), "near_classes"
    )
    leaves, stars = _leaves(classes, trees, leaf, levels, percent)
    found = _candidates(leaves, classes, percent)
    groups = connected_components(written(found if stars is None else found.unionByName(stars), "near_candidates"))
    links = _exact_links(own, classes, written(groups, "near_coarse"), k, percent, group_elements)
    # rows that repeat a doc_id with another text tie its classes together
    texts_of = base.where("set_hash is not null and doc_id is not null").select("doc_id", "set_hash").distinct()
    many = texts_of.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeats = texts_of.join(many, "doc_id").join(classes, "set_hash").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    found = written(connected_components(links.unionByName(repeats)), "near_components")
    named = written(classes.join(found, F.col("id") == F.col("node"), "left").select("set_hash", F.coalesce("component", "id").alias("component_id")), "near_named_classes")
    out = base.join(named, "set_hash", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked documents, that of the smallest doc_id, with all its columns; rows without doc_id all stay.  Of rows
    that repeat the kept doc_id the one with the smallest text hash stays."""
    kept = written(near_duplicates(docs, k, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct(), "near_kept")
    own = docs.where("doc_id is not null").hint("merge").join(kept, F.col("doc_id").cast("long") == F.col("_kept_id"), "left_semi")
    first = own.withColumn("_place", F.expr("row_number() over (partition by cast(doc_id as long) order by xxhash64(text))")).where("_place = 1").drop("_place")
    return first.unionByName(docs.where("doc_id is null"))
