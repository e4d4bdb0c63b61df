"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps the best way to each reached boundary.  For a unigram vocabulary that is the one with the highest sum of scores.  A BPE
vocabulary is searched for the segmentation that its merges give: two pieces may follow each other only if merging their joint
characters gives just these two, which leaves one way to each boundary.  When the backpointer paths of all reached boundaries ahead meet in one
boundary, the ids up to it are committed and the window moves there; it spans little more than the longest piece.  Places that no
piece of the vocabulary crosses (two neighbours that no piece holds side by side) are such boundaries in any text, so stretches
between them are encoded on their own and remembered within a task."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: Where the public vocabulary lies; a parameter of every function that reads it, never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A character that no piece holds scores this much less than the worst piece (fixed value of the SentencePiece format).
UNKNOWN_PENALTY = 10.0
_REMEMBERED = 450_000  # stretches that a task remembers


@dataclass
class Vocabulary:
    """Pieces (with ordinary spaces) as a character trie; ids of the 256 byte pieces; bytes of each id for decoding."""

    kind: str  # unigram or bpe
    scores: dict[str, tuple[int, float]]
    trie: dict
    byte_ids: list[int]
    unknown_id: int
    unknown_score: float
    spelled: list[bytes]
    pieces: list[str]
    sides: set[str]  # neighbours within pieces
    crossing: bool  # some piece has a space behind another character
    newline: bool  # some piece holds a line end
    longest: int
    memo: dict = field(default_factory=dict, repr=False)
    pairs: dict = field(default_factory=dict, repr=False)
    states: dict = field(default_factory=dict, repr=False)
    begins: set = field(default_factory=set, repr=False)
    apart: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "pairs": {}, "states": {}, "begins": set(), "apart": None}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Read the vocabulary on the driver; it has a fixed size and travels with the tasks."""
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, model: bytes) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        trie: dict = {}
        byte_ids, spelled, scores, names, known = [-1] * 256, [b""] * n, [], [], {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                name = piece.replace("▁", " ")
                spelled[i] = name.encode()
                names.append(name)
                scores.append(sp.get_score(i))
                known[name] = (i, sp.get_score(i))
                node = trie
                for ch in name:
                    node = node.setdefault(ch, {})
                node[""] = (i, sp.get_score(i))
        unknown = sp.unk_id()
        spelled[unknown] = " ⁇ ".encode()
        sides = {x[i : i + 2] for x in names for i in range(len(x) - 1)}
        strings = [""] * n
        for name, (i, _) in known.items():
            strings[i] = name
        return cls(_kind(model), known, trie, byte_ids, unknown, min(scores) - UNKNOWN_PENALTY, spelled, strings, sides, any(re.search("[^ ] ", x) for x in names),
                   any("\n" in x for x in names), max(map(len, names)))

    def _spell(self, ch: str) -> list[int]:
        ids = [self.byte_ids[b] for b in ch.encode()]
        return ids if -1 not in ids else [self.unknown_id]

    def merged(self, s: str) -> list[str]:
        """Pieces of a short string by merges: the neighbours whose joint piece scores best first, of equals the leftmost."""
        parts, scores = list(s), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = scores.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got[1] > best):
                    best, at = got[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, before: int, piece: int) -> bool:
        """True if ``piece`` may come after ``before`` (-1: at a start; -2, a boundary that is not reached: never)."""
        key = before << 32 | piece
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= 2 * _REMEMBERED:
                self.pairs.clear()
            a, b = self.pieces[before] if before >= 0 else "", self.pieces[piece]
            got = self.pairs[key] = before > -2 and self.merged(a + b) == ([a, b] if a else [b])
        return got

    def stretch(self, s: str) -> list[int]:
        """Ids of the best segmentation of ``s``; of equal scores the one that begins each piece earliest."""
        return self._only_way(s) if self.kind == "bpe" else self._best_way(s)

    def _state(self, begun: str) -> tuple[dict, list]:
        """The state of a search that has read ``begun``, the longest end of the text that begins a piece, and the pieces that end here."""
        if not self.begins:
            self.begins.update(x[:i] for x in self.scores for i in range(len(x) + 1))
        while begun not in self.begins:
            begun = begun[1:]
        got = self.states.get(begun)
        if got is None:
            got = self.states[begun] = ({"": begun}, [(self.scores[x][0], len(x)) for x in (begun[i:] for i in range(len(begun))) if x in self.scores])
        return got

    def _only_way(self, s: str) -> list[int]:
        """``stretch`` of a BPE vocabulary, where one way at most leads to each boundary: of the pieces that end there, the longest first,
        the one that may come after the piece before it."""
        pairs, follows, (state, _) = self.pairs, self._follows, self._state("")
        out, at, check = [], 0, 2 * self.longest  # boundaries count from the last committed one
        back, own = [0], [-1]  # start and id (-1: none) of the piece that ends at each boundary; id -2: not reached
        for i, ch in enumerate(s, 1):
            at += 1
            step = state.get(ch)
            if step is None:
                step = state[ch] = self._state(state[""] + ch)
            state, ends = step
            length = 0
            for piece, length in ends:
                key = own[at - length] << 32 | piece
                fits = pairs.get(key)
                if fits is None:
                    fits = follows(own[at - length], piece)
                if fits:
                    back.append(at - length), own.append(piece)
                    break
            else:
                back.append(at - 1), own.append(-2 if length == 1 or own[-1] == -2 else -1)
            if at < check and i < len(s):
                continue
            # boundaries that are reached and from which a piece may go on; their paths go back until one boundary is left
            alive = {k for k in range(at - len(state[""]), at + 1) if own[k] != -2} if i < len(s) else {at}
            while len(alive) > 1:
                last = max(alive)
                alive.remove(last)
                alive.add(back[last])
            k = meet = alive.pop()
            path = []
            while k > 0:
                path += [own[k]] if own[k] >= 0 else reversed(self._spell(s[i - at + k - 1]))
                k = back[k]
            out += reversed(path)
            back, own, at = [x - meet for x in back[meet:]], own[meet:], at - meet
            check = max(2 * self.longest, at + self.longest)  # what is not yet decided is looked at later
        return out

    def _best_way(self, s: str) -> list[int]:
        """``stretch`` of a unigram vocabulary: the highest sum of scores."""
        n, out = len(s), []
        base = 0  # all before is committed
        score: list = [0.0]  # of the boundaries base, base + 1, ...
        back: list = [None]
        check = 2 * self.longest
        for i in range(n):
            at = i - base
            here = score[at]
            if here is not None:
                node, j, single = self.trie, i, False
                while j < n and (node := node.get(s[j])) is not None:
                    j += 1
                    got = node.get("")
                    if got is not None:
                        single |= j == i + 1
                        while len(score) <= j - base:
                            score.append(None), back.append(None)
                        total = here + got[1]
                        if score[j - base] is None or total > score[j - base]:
                            score[j - base], back[j - base] = total, (i, got[0])
                if not single:
                    if len(score) <= at + 1:
                        score.append(None), back.append(None)
                    total = here + self.unknown_score
                    if score[at + 1] is None or total > score[at + 1]:
                        score[at + 1], back[at + 1] = total, (i, None)
            if at >= check or i == n - 1:
                # boundaries that are reached ahead; their paths go back until one boundary is left
                alive = sorted(k + base for k in range(at + 1, len(score)) if score[k] is not None)
                while len(alive) > 1:
                    last = alive.pop()
                    k = back[last - base][0]
                    if k not in alive:
                        alive.append(k)
                        alive.sort()
                meet = alive[0]
                if meet > base:
                    path, k = [], meet
                    while k > base:
                        path.append((k, back[k - base]))
                        k = back[k - base][0]
                    for _, (start, piece) in reversed(path):
                        out += [piece] if piece is not None else self._spell(s[start])
                    top = score[meet - base]
                    score = [None if x is None else x - top for x in score[meet - base :]]
                    back, base = back[meet - base :], meet
                    check = 2 * self.longest
                else:
                    check = at + self.longest  # not yet decided: look again later
        return out

    def _part(self, part: str) -> bytes:
        got = self.memo.get(part)
        if got is None:
            got = array("i", self.stretch(part)).tobytes()
            if len(part) <= 64:
                if len(self.memo) >= _REMEMBERED:
                    self.memo.clear()
                self.memo[part] = got
        return got

    def _remembered(self, s: str) -> bytes:
        """Ids of a stretch, encoded in parts that no piece crosses."""
        cuts = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in self.sides]
        return b"".join([self._part(s[i:j]) for i, j in zip([0, *cuts], [*cuts, len(s)], strict=True)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a space is put in front of it, as the format does.  An empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        text = " " + text
        if self.crossing:
            return np.frombuffer(self._remembered(text), np.int32)
        memo, out = self.memo, []
        lines = [text] if self.newline else text.split("\n")
        for number, line in enumerate(lines):
            if number:
                out.append(self._remembered("\n"))
            for s in re.findall(" *[^ ]+| +", line):
                got = memo.get(s)
                out.append(got if got is not None else self._remembered(s))
        return np.frombuffer(b"".join(out), np.int32)

    def _parted(self) -> np.ndarray:
        """By two ASCII characters (256 * first + second): no piece holds them side by side."""
        if self.apart is None:
            self.apart = np.zeros(1 << 16, bool)
            self.apart.reshape(256, 256)[:128, :128] = True
            for x in self.sides:
                if x.isascii():
                    self.apart[256 * ord(x[0]) + ord(x[1])] = False
        return self.apart

    def encode_all(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the place where those of each text begin (and, last, end).

        As ``encode`` of each; equal stretches of the texts are told apart by their bytes and looked up once."""
        if self.crossing or self.newline:
            ids = [self.encode(t.decode()) for t in own]
            return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
        size = np.array([len(t) + 1 if t else 0 for t in own], np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        if not first[-1]:
            return np.zeros(0, np.int32), np.zeros(len(own) + 1, np.int64)
        data = b"".join([b" " + t for t in own if t])
        a = np.frombuffer(data, np.uint8)
        blank, line = a == 32, a == 10
        # a stretch begins with a text, at a line end, behind one, with a run of spaces and between characters that no piece holds side by side
        begins = line.copy()
        begins[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        begins[1:] |= self._parted().take(a[:-1].astype(np.uint16) << 8 | a[1:])
        begins[first[:-1][size > 0]] = True
        starts = np.flatnonzero(begins)
        stretches = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        stretches = stretches.dictionary_encode()
        which, memo = stretches.indices.to_numpy(), self.memo
        found = [memo.get(s) or (self._part(s) if s.isascii() else self._remembered(s)) for s in stretches.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(found), np.int32)
        count = np.array([len(x) // 4 for x in found], np.int64)
        at = _gathered(np.cumsum(count) - count, count, which)
        ends = np.concatenate(([0], np.cumsum(count[which])))
        return flat[at], ends[np.searchsorted(starts, first)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the leading space goes.  Bytes that are not UTF-8 become U+FFFD."""
        return self.decode_all(np.array(ids, np.int32), np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of the texts whose ids lie between consecutive ``ends``; the leading space of each goes."""
        sizes = np.array([len(x) for x in self.spelled], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes[ids])))[ends].tolist()
        data = pa.array(self.spelled, pa.large_binary()).take(pa.array(ids)).buffers()[2]
        data = b"" if data is None else data.to_pybytes()
        return [data[a:b].removeprefix(b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _gathered(starts: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the runs ``which``, one run behind the other; a run has ``count`` places from its start on."""
    n = count[which]
    ends = np.cumsum(n)
    return np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _fields(message: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            c = message[i]
            i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
            if c < 128:
                return out

    while i < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, message[i : i + n]
            i += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, message[i : i + n]
            i += n


def _kind(model: bytes) -> str:
    """Kind of a model file; the fixed values of the format are 2 for the training settings, there 3 for the kind, 1 unigram, 2 BPE."""
    kind = 1
    for number, value in _fields(model):
        if number == 2:
            kind = next((v for n, v in _fields(value) if n == 3), kind)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return {1: "unigram", 2: "bpe"}[kind]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; no shuffle."""
    small_batches(docs.sparkSession, 256)

    def run(batches):
        for b in batches:
            ids, ends = vocabulary.encode_all(_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids, ends)], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and text of ``ids``; null ids give an empty text."""
    small_batches(ids.sparkSession, 256)

    def run(batches):
        for b in batches:
            out = [vocabulary.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _bytes(own: pa.Array) -> list[bytes]:
    return own.cast(pa.large_binary()).to_pylist()


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))


def encode_decode(docs: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 and round_trip (the ids decode to the text) of every row of ``docs``, and its columns
    ``carry``.

    Null and empty texts have no ids.  Characters outside the vocabulary, a literal U+2581 among them, are spelled in byte pieces, so any
    text comes back as it was.  Repeated rows each get a row; a null doc_id stays null.  Encoded and decoded in one pass."""
    small_batches(docs.sparkSession, 256)
    vocabulary = Vocabulary.load(model)

    def run(batches):
        import hashlib

        for b in batches:
            own = _bytes(b.column("text"))
            ids, ends = vocabulary.encode_all(own)
            back = [x if x == t else x.decode("utf-8", "replace").encode() for x, t in zip(vocabulary.decode_all(ids, ends), own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(np.diff(ends), pa.int64()), _lists(ids, ends),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array([x == t for x, t in zip(back, own, strict=True)], pa.bool_()),
                    *map(b.column, carried),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip", *carried],
            )

    carried = [f"_carry_{c}" for c in carry]
    own = texts(docs, *(F.col(c).alias(x) for c, x in zip(carry, carried, strict=True)))
    more = "".join(f", `{x}` {own.schema[x].dataType.simpleString()}" for x in carried)
    out = own.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean" + more)
    return out.withColumnsRenamed(dict(zip(carried, carry, strict=True)))
