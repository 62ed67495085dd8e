"""WARC records in ZIP archives, written by tasks and read back by ranges.

An archive holds two stored members: ``archive/data.warc.gz``, where each record is a
gzip member of its own, and ``indexes/index.cdxj`` with a line of key, offset and length
for each record. Reading parses the ZIP directories (:mod:`guidepost.llm.zip_reader`),
locates members and indexes, deals the records out by blocks of the archives, and reads
them by ranges; neighbours are fetched together. Nothing is extracted. Archives of others
that have no index are cut into records by walking over their gzip members.

Of rows with equal payloads of at least ``MIN_PAYLOAD`` bytes the one with the smallest id
becomes a response, the others revisits that name it and hold no payload; smaller ones
all become responses. Equality goes by SHA-256 and length. A payload that a thousandth of
all rows or more share is looked up by broadcast (there are at most 1,000), all others by
a join, so that no key gathers many rows.

Null payloads are empty, null addresses become the record's own name. Rows without an id
are never referred to; where all rows of a payload lack one, and where several rows share
the smallest id, these are all responses. An empty table gives no rows and no archives.
Tasks write under names of their own attempt and return them, so files of lost attempts
are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guidepost.llm.common import settings, store, utf8
from guidepost.llm.zip_reader import Archive, Writer
from guidepost.session import scratch_path

MIN_PAYLOAD = 100
#: A new archive starts beyond this size; its index is held in memory until then.
ARCHIVE_BYTES = 128 << 20
#: Bytes of an archive that one task reads, and that one read fetches.
BLOCK_BYTES, READ_BYTES = 8 << 20, 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATA_NAME, INDEX_NAME = r"\.warc(\.gz)?$", r"^indexes/.*\.cdxj$"
# Fixed values of the record format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"


def decided(pages: DataFrame, page_id: str, payload: str, url: str) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``first``, the id to refer to."""
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), utf8(F.col(payload)).alias("payload"))
    src = src.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes"))
    large = F.col("bytes") >= MIN_PAYLOAD
    spark = pages.sparkSession
    counts = src.where(large).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    counts = store(counts, f"{scratch_path(spark, 'warc')}/payloads")
    total = src.count()
    hot = counts.where(F.col("n") * 1000 >= total).select(F.col("digest").alias("hot"), F.col("first").alias("hot_first"))
    cold = counts.where(F.col("n") * 1000 < total).select(F.col("digest").alias("key"), F.col("first").alias("cold_first"))
    found = src.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left")  # at most 1,000 rows
    # only payloads that can be in the table keep their digest as key; the others spread evenly
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))
    keyed = found.withColumn("key", F.when(F.col("hot").isNull() & large, F.col("digest")).otherwise(own))
    done = keyed.join(cold, "key", "left")
    first = F.coalesce("hot_first", "cold_first")
    return done.select("page_id", "url", "payload", "digest", F.when(~first.eqNullSafe(F.col("page_id")), first).alias("first"))


def header_value(text: str) -> str:
    """A value fit for one header line: blanks, controls and what is beyond ASCII as %XX."""
    return re.sub(rb"[^\x21-\x7E]", lambda m: b"%%%02X" % m.group(0)[0], text.encode()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, first, date: str) -> bytes:
    """One record, uncompressed."""
    name = f"{NAME}{'' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(url) if url else name}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{NAME}{first}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", page_id: str = "page_id", payload: str = "html", url: str = "url", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all rows as archives in ``folder``; ``path``, ``records``, ``bytes`` of each archive."""
    src = decided(pages, page_id, payload, url)

    def run(batches):
        out, lines, name = None, [], ""

        def finish():
            out.end()
            out.begin(INDEX)
            for line in lines:
                out.write(line)
            out.end()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64()), pa.array([out.close()], pa.int64())], names=["path", "records", "bytes"])

        for rows in batches:
            for r in zip(*(rows.column(c) for c in ("page_id", "url", "payload", "digest", "first"))):
                if out is None:
                    name, lines = f"{folder}/{uuid.uuid4().hex}.wacz", []
                    out = Writer(name)
                    out.begin(DATA)
                    base = out.pos
                page, *rest = (x.as_py() for x in r)
                at, data = out.pos - base, packed(record(page, *rest, date))
                out.write(data)
                lines.append(json.dumps({"id": page, "offset": at, "length": len(data)}).encode() + b"\n")
                if out.pos > archive_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return store(src.mapInArrow(run, "path string, records long, bytes long"), f"{folder}/manifest")


def members(archives: DataFrame, path: str = "path") -> DataFrame:
    """Every member of every archive: ``path``, ``name``, ``method``, ``stored``, ``start``
    of its bytes in the file, ``packed`` and ``size``."""

    def run(batches):
        for rows in batches:
            for uri in rows.column("path").to_pylist():
                with Archive(uri) as a:
                    got = [(uri, m.name, m.method, m.stored, a.data_at(m), m.packed, m.size) for m in a.members()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), MEMBER.values())], names=list(MEMBER)) if got else empty(MEMBER)

    src = archives.select(F.col(path).alias("path")).where("path is not null")
    return src.mapInArrow(run, "path string, name string, method int, stored boolean, start long, packed long, size long")


MEMBER = {"path": pa.string(), "name": pa.string(), "method": pa.int32(), "stored": pa.bool_(), "start": pa.int64(), "packed": pa.int64(), "size": pa.int64()}
RANGE = {"path": pa.string(), "start": pa.int64(), "length": pa.int64()}


def empty(kind: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in kind.values()], names=list(kind))


def ranges(found: DataFrame) -> DataFrame:
    """``path``, ``start``, ``length`` of every record in stored members: from the index of
    an archive, or by walking over the records where it has none."""
    data = F.col("name").rlike(DATA_NAME) & F.col("stored")
    index = F.col("name").rlike(INDEX_NAME) & F.col("stored")
    one = found.groupBy("path").agg(
        F.collect_list(F.when(data, F.struct("start", "size"))).alias("data"), F.collect_list(F.when(index, F.struct("start", "size"))).alias("index"))

    def run(batches):
        for rows in batches:
            for r in rows.to_pylist():
                with Archive(r["path"]) as a:
                    if len(r["data"]) == 1 and r["index"]:
                        base = r["data"][0]["start"]
                        spans = ((base + e["offset"], e["length"]) for m in r["index"] for e in map(json.loads, lines_of(a, m["start"], m["size"])))
                    else:
                        spans = (span for m in r["data"] for span in walk(a, m["start"], m["size"]))
                    for part in chunks(spans, 10_000):
                        start, length = zip(*part)
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(part)), pa.array(start, pa.int64()), pa.array(length, pa.int64())], names=list(RANGE))

    return one.mapInArrow(run, "path string, start long, length long")


def chunks(items: Iterable, n: int) -> Iterator[list]:
    part = []
    for x in items:
        part.append(x)
        if len(part) == n:
            yield part
            part = []
    if part:
        yield part


def pieces(a: Archive, start: int, size: int) -> Iterator[bytes]:
    for at in range(start, start + size, READ_BYTES):
        yield a.read(at, min(READ_BYTES, start + size - at))


def lines_of(a: Archive, start: int, size: int) -> Iterator[bytes]:
    rest = b""
    for piece in pieces(a, start, size):
        *full, rest = (rest + piece).split(b"\n")
        yield from filter(None, full)
    if rest:
        yield rest


def walk(a: Archive, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of the gzip members that follow one another in a range."""
    z, begun, at = zlib.decompressobj(31), start, start
    for piece in pieces(a, start, size):
        while piece:
            if z is None:
                z, begun = zlib.decompressobj(31), at
            z.decompress(piece)
            left = z.unused_data
            at += len(piece) - len(left)
            piece = left
            if z.eof:
                yield begun, at - begun
                z = None


def opened(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def headers(data: bytes, start: int = 0) -> tuple[dict[str, str], int]:
    """Header lines as a dictionary of lower-case names, and where the block begins."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise ValueError("a record without the end of its headers")
    out: dict[str, str] = {}
    for line in data[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.strip().lower()] = value.strip()
    return out, end + 4


def parsed(data: bytes) -> tuple:
    """Fields of a record: type, own name, address, payload length and digest, name
    referred to, payload (None for a revisit), and whether the stated digest holds."""
    head, at = headers(data)
    block = data[at : at + int(head["content-length"])]
    name = lambda key: head[key].strip("<>").removeprefix(NAME) if head.get(key) else None
    kind, stated = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    http, body = headers(block) if block[:5] == b"HTTP/" else ({}, 0)
    if kind == "revisit":
        size = int(http["content-length"]) if "content-length" in http else None
        return kind, name("warc-record-id"), head.get("warc-target-uri"), size, stated, name("warc-refers-to"), None, None
    payload = block[body:]
    digest = hashlib.sha256(payload).hexdigest()
    return kind, name("warc-record-id"), head.get("warc-target-uri"), len(payload), digest, None, payload, stated in (None, digest)


FIELDS = {
    "record_type": pa.string(), "name": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "refers_to": pa.string(), "payload": pa.binary(), "intact": pa.bool_(),
}


def read(archives: DataFrame, with_payload: bool = True, path: str = "path") -> DataFrame:
    """Records of all archives: ``record_type``, ``name``, ``url``, ``payload_bytes``,
    ``payload_digest``, ``refers_to``, ``payload`` (null for revisits and if not asked for)
    and ``intact``. Names of records are without their ``urn:page:``."""

    def run(batches):
        for rows in batches:
            spans = sorted(zip(rows.column("path").to_pylist(), rows.column("start").to_pylist(), rows.column("length").to_pylist()))
            got, held = [], 0
            for uri, own in by_file(spans):
                with Archive(uri) as a:
                    for lo, hi, part in together(own):
                        data = a.read(lo, hi - lo)
                        for start, length in part:
                            fields = list(parsed(opened(data[start - lo : start - lo + length])))
                            if not with_payload:
                                fields[6] = None
                            got.append(fields)
                            held += len(fields[6] or b"") + 200
                            if held > 4 * READ_BYTES:
                                yield batch_of(got)
                                got, held = [], 0
            if got:
                yield batch_of(got)

    # blocks of the archives are dealt to tasks by the bytes there are to read, not by the
    # few bytes that name them
    spark = archives.sparkSession
    found = store(members(archives, path), f"{scratch_path(spark, 'members')}/all")
    blocks = found.where(F.col("name").rlike(DATA_NAME)).agg(F.sum(F.ceil(F.col("size") / BLOCK_BYTES))).first()[0] or 1
    spans = ranges(found).withColumn("block", F.floor(F.col("start") / BLOCK_BYTES))
    dealt = spans.repartition(int(blocks), "path", "block").sortWithinPartitions("path", "start").select("path", "start", "length")
    return dealt.mapInArrow(run, "record_type string, name string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, intact boolean")


def by_file(spans: list[tuple]) -> Iterator[tuple[str, list]]:
    lo = 0
    for i in range(1, len(spans) + 1):
        if i == len(spans) or spans[i][0] != spans[lo][0]:
            yield spans[lo][0], [s[1:] for s in spans[lo:i]]
            lo = i


def together(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list]]:
    """Neighbouring ranges up to ``READ_BYTES`` as one read each; a longer record alone."""
    part: list[tuple[int, int]] = []
    lo = hi = 0
    for start, length in spans:
        if part and (start != hi or start + length - lo > READ_BYTES):
            yield lo, hi, part
            part = []
        if not part:
            lo = start
        part.append((start, length))
        hi = start + length
    if part:
        yield lo, hi, part


def batch_of(got: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), FIELDS.values())], names=list(FIELDS))


def round_trip(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """All rows written as archives in the shared folder and read back from them:
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    spark = pages.sparkSession
    kind = pages.select(page_id).schema[0].dataType.simpleString()
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="8m"):
        archives = write(pages, scratch_path(spark, "archives"), page_id=page_id, payload=payload, url=url)
    own = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    got = read(archives, with_payload=False)
    held = F.when(F.coalesce("intact", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return got.select(own("name").alias("page_id"), "payload_bytes", held.alias("payload_digest"), "record_type", own("refers_to").alias("refers_to"))
