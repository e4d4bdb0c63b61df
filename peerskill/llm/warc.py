"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Archives are written and read by Spark's own file formats, so they can lie in any store that Spark reaches, and writes commit as other
Spark output does.  The writer hands each member to the text format, whose line end is the zero byte that ends a member (the high byte
of its length).  The reader takes the gzip magic for the line end: a task gets the pieces between the magics of its byte range, the
last one to its end beyond the range; a piece is a candidate member, valid if its headers decode, and belongs to the range that its magic
begins in.  A magic inside compressed data cuts a member: the pieces are put together again, also across ranges.

Files whose names end in .gz would be decompressed by Spark before the reader sees them; give archives another suffix."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

MAGIC = b"\x1f\x8b\x08"
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"
RECORD = (
    "record_type string, page_id long, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(page_id, url, payload: bytes, refers_to, level: int = 6) -> bytes:
    """Gzip member of a response, or of a revisit if ``refers_to`` is given; it ends in a zero byte."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = "" if page_id is None else str(page_id)
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), f"WARC-Record-ID: <{_URN}{name}>".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}".encode(), b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.insert(3, b"WARC-Target-URI: " + "".join(url.split()).encode())
    if refers_to is not None:
        head += [b"WARC-Profile: " + _PROFILE, f"WARC-Refers-To: <{_URN}{refers_to}>".encode()]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
    return out if out[-1:] == b"\0" else out + _EMPTY  # only records of 16 MB and more


def _parse(raw: bytes) -> dict | None:
    """Fields of a decoded record, or None if it is none."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        return None
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in raw[:end].split(b"\r\n")[1:])}
    size = int(head.get(b"content-length", b"-1"))
    block = raw[end + 4 : end + 4 + size]
    if size < 0 or len(block) < size:
        return None
    kind, payload, length = head.get(b"warc-type", b"").decode(), None, None
    if head.get(b"content-type", b"").startswith(b"application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        stated = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        payload, length = (body, len(body)) if kind == "response" else (None, int(stated[0]) if stated else None)

    def page(name: bytes):
        v = head.get(name, b"").decode().strip("<>")
        return int(v[len(_URN) :]) if v.startswith(_URN) and v[len(_URN) :] else None

    stated_digest = head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None
    return {
        "record_type": kind, "page_id": page(b"warc-record-id"), "target_uri": head.get(b"warc-target-uri", b"").decode() or None,
        "refers_to": page(b"warc-refers-to"), "payload_bytes": length,
        "payload_digest": digest(payload) if payload is not None else stated_digest, "payload": payload,
    }


class Member:
    """A candidate member that is decoded piece by piece.  state: open, done or bad."""

    def __init__(self):
        self.z, self.out, self.pieces, self.state, self.headed = zlib.decompressobj(31), [], [], "open", False

    def feed(self, piece: bytes) -> str:
        self.pieces.append(piece)
        try:
            self.out.append(self.z.decompress(piece))
        except zlib.error:
            self.state = "bad"
            return self.state
        if not self.headed:
            first = b"".join(self.out)
            self.out = [first]
            if len(first) >= 5:
                self.headed = True
                if not first.startswith(b"WARC/"):
                    self.state = "bad"
        if self.z.eof and self.state == "open":
            self.state = "done"
        return self.state

    def record(self) -> dict | None:
        return _parse(b"".join(self.out))


_PIECE = "path string, block long, seq long, open boolean, piece binary"


def _split_records(batches, payloads: bool):
    """(records, leftover pieces) of the byte ranges of a task, in order."""
    at, now, seq, begun = None, None, 0, False

    def left(member):
        return {"path": at[0], "block": at[1], "seq": 1 << 60, "open": member.headed, "piece": b"".join(member.pieces)}

    def orphans(member):
        """What is no member may go on one of the range before, if no member has begun in this range."""
        nonlocal seq
        if member is None or begun:
            return []
        seq += 1
        return [{"path": at[0], "block": at[1], "seq": seq, "open": False, "piece": b"".join(member.pieces)}]

    for batch in batches:
        records, rest = [], []
        for path, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (path, block) != at:
                if now is not None:
                    rest.append(left(now))
                at, now, seq, begun = (path, block), None, 0, False
                if block == 0:
                    begun = True  # a file begins with a member; what lies before its first magic is none
                    continue
            piece = MAGIC + piece
            fresh = None if now is not None and now.headed else Member()
            if now is None or (fresh is not None and fresh.feed(piece) != "bad" and fresh.headed):
                # a candidate that has not shown a WARC header yet gives way to one that does
                rest += orphans(now)
                now = Member()
                state = now.feed(piece)
            else:
                state = now.feed(piece)
            if state == "bad":
                rest += orphans(now)
                broken, now = len(now.pieces) > 1, None
                if broken and (fresh := Member()).feed(piece) != "bad" and fresh.headed:  # a broken member before another
                    now, state = fresh, fresh.state
                else:
                    continue
            if state == "open":
                continue
            if state == "done":
                got = now.record()
                begun, now = True, None
                if got is not None:
                    records.append(got if payloads else got | {"payload": None})
        yield records, rest
    if now is not None:
        yield [], [left(now)]


def _rows(records: list[dict], rest: list[dict]) -> pa.RecordBatch:
    kind = pa.struct([("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to", pa.int64()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    left = pa.struct([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("open", pa.bool_()), ("piece", pa.binary())])
    n, m = len(records), len(rest)
    return pa.RecordBatch.from_arrays([pa.array(records + [None] * m, kind), pa.array([None] * n + rest, left)], names=["record", "rest"])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path`` (RECORD); ``payloads=False`` leaves payload null.

    The digest of a response is computed from its payload, that of a revisit is the one it states.  Pieces that no range can place
    (a member cut by a magic in its data at the end of a byte range; about one in millions) are written, joined by file and decoded."""
    from .common import written

    small_batches(spark, 256)
    raw = (
        spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))
    )

    def run(batches):
        for records, rest in _split_records(batches, payloads):
            yield _rows(records, rest)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for row in pdf.sort_values(["block", "seq"]).itertuples():
            if now is None or (row.open and not now.headed):
                now = Member()
            state = now.feed(row.piece)
            if state == "bad" and row.open and len(now.pieces) > 1:  # goes on nothing, so it begins
                now = Member()
                state = now.feed(row.piece)
            if state == "done":
                out.append(now.record())
            if state != "open":
                now = None
        found = [x if payloads else x | {"payload": None} for x in out if x]
        return pd.DataFrame(found, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    parts = written(raw.mapInArrow(run, f"record struct<{RECORD.replace(' ', ':').replace(',:', ',')}>, rest struct<{_PIECE.replace(' ', ':').replace(',:', ',')}>"), "warc_parts")
    whole = parts.where("record is not null").select("record.*")
    return whole.unionByName(parts.where("rest is not null").select("rest.*").groupBy("path").applyInPandas(join, RECORD))


def assigned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (html in UTF-8, null: empty) and refers_to.

    Of pages with equal payloads of at least ``least_bytes`` bytes the smallest page_id stays (null ids come last), the others refer to
    it; pages that repeat that id stay as well.  Only digests meet by payload, pre-aggregated; payloads are joined by page_id."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    big = own.where(F.octet_length("payload") >= least_bytes)
    first = big.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    later = (
        big.select("page_id", "sha").join(first.select("sha", "refers_to"), "sha").where("page_id is null or page_id > refers_to").distinct()
        .select(F.col("page_id").alias("later_id"), F.col("sha").alias("later_sha"), "refers_to")
    )
    return own.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("sha") == F.col("later_sha")), "left").select("page_id", "url", "payload", "refers_to")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, level: int = 6) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives under ``path``.

    Null urls leave out the target, null html is an empty payload, other columns are ignored, repeated rows each get a record; of an empty
    table one archive without records is left."""
    small_batches(pages.sparkSession, 256)

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
            got = [member(p, u, h, r, level)[:-1] for p, u, h, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["member"])

    members = assigned(pages, least_bytes).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
