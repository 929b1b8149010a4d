"""WARC archives: a writer through Spark's own sink, and a splittable reader of gzip members.

Writer: one gzip member a record. The last byte of a member is the top byte of its length, zero for records below 16 MiB,
so members go out as lines of Spark's text sink with a zero byte as line separator: the files are the members back to
back, and Spark's commit protocol covers lost executors and retries. A longer record gets an empty member after it, which
ends in zero too.

Reader: files are cut into byte ranges. A task looks for the gzip magic in its range, checks each candidate by decoding
its first bytes, which must start a WARC header, and owns the records that start inside its range; the last one is read
past the range's end. After a valid member the scan goes on at its end, so magic within compressed data is met only
before a range's first record, where the header check rejects it. A whole member may lie uncompressed within another one (a stored
payload): scans start LOOK_BACK bytes before their range, so it is passed over if its host starts no further away than that.
Records of any writer are read: all types, ids of any kind, several records in a member, answers without a length.

Duplicates: of rows with equal payloads (SHA-1 and length) the largest page_id is the response. Digests are pre-aggregated
before the shuffle; rows meet their winner in a plain equi-join that adaptive execution splits for hot payloads.

Cases: null html is an empty payload; empty payloads are equal to each other; a null page_id is written as an empty id,
comes back null and is a response only if no other row has its payload; rows that repeat the winning page_id are all
responses; null urls are left out; an empty table gives an archive without records and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, stage, table

MAGIC = b"\x1f\x8b\x08"
RANGE = 8 << 20
WINDOW = LOOK_BACK = 1 << 20
MOST_TASKS = 100_000
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean, record_id string, refers_to_id string, fault string"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.0 record, uncompressed. A revisit holds the HTTP header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member that ends in a zero byte."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def with_roles(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (SHA-1) and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    winners = stage(spark, rows.groupBy("digest", F.length("payload").alias("n")).agg(F.max("page_id").alias("winner")), "warc-winners").select(F.col("digest").alias("d"), "n", "winner")
    joined = rows.join(winners, (F.col("digest") == F.col("d")) & (F.length("payload") == F.col("n")))
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"))


def write_warc(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """pages: page_id, url, html. Writes a folder of archives (gzip, one member a record)."""
    small_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, url, payload, digest, refers_to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["refers_to"], strict=True):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                out.append(member(record(page_id, None if pd.isna(url) else url, payload, base64.b32encode(digest).decode(), refers_to))[:-1])
            yield pd.DataFrame({"value": out})

    # ids go as strings, since a null among longs would make pandas round them
    rows = with_roles(spark, pages).select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    rows.mapInPandas(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _open(path: str):
    """A seekable file and its length, in any store that Arrow reads."""
    from pyarrow import fs

    uri = path if "://" in path else path.replace(":/", ":///", 1) if ":/" in path else f"file://{path}"
    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def _member_at(data: bytes, at: int) -> bool:
    """Whether a gzip member whose text starts a WARC record begins here."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


class _Window:
    """A file read through one buffer of WINDOW bytes or a little more."""

    def __init__(self, f):
        self.f, self.length, self.base, self.buffer = f, f.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        held = self.base + len(self.buffer)
        if at < self.base or at + n > held and held < self.length or at > held:
            self.f.seek(at)
            self.base, self.buffer = at, self.f.read(max(n, WINDOW))
        return self.buffer[at - self.base : at - self.base + n]


def _salvage(data: bytes, step: int = 256) -> bytes:
    """What a damaged member decodes to before its fault."""
    z, out = zlib.decompressobj(31), []
    with contextlib.suppress(zlib.error):
        for k in range(0, len(data), step):
            out.append(z.decompress(data[k : k + step]))
    return b"".join(out)


def members(f, start: int, end: int, step: int = 1 << 16) -> Iterator[bytes]:
    """The decoded members that start in [start, end); of a damaged one what could be decoded.

    The scan starts LOOK_BACK bytes earlier, so that a member which lies uncompressed within another is passed over with its host.
    """
    window, at = _Window(f), max(0, start - LOOK_BACK)
    while at < end:
        span = min(step, end - at)
        data = window.get(at, span + 4096)
        found = data.find(MAGIC)
        while 0 <= found < span and not _member_at(data, found):
            found = data.find(MAGIC, found + 1)
        if not 0 <= found < span:
            at += span
            continue
        first = at + found
        own = first >= start
        z, out, pos, n = zlib.decompressobj(31), [], first, 1 << 14
        while not z.eof and (chunk := window.get(pos, n)):
            try:
                part = z.decompress(chunk)
            except zlib.error:
                out = [_salvage(chunk if pos == first else window.get(first, pos + len(chunk) - first))] if own else out
                break
            if own:
                out.append(part)
            pos, n = pos + len(chunk), min(4 * n, WINDOW)
        at = pos - len(z.unused_data) if z.eof else first + 1
        if own and (z.eof or any(out)):
            yield b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; lines that start with a space continue the one before; of repeated fields the first counts."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


def _head(data: bytes, start: int) -> tuple[bytes, int] | None:
    """A header block from ``start`` on, and where it ends; lines may end in CR LF or LF alone."""
    ends = [(k, n) for n, k in ((4, data.find(b"\r\n\r\n", start)), (2, data.find(b"\n\n", start))) if k >= 0]
    if not ends:
        return None
    k, n = min(ends)
    return data[start:k], k + n


def _number(value: str | None) -> int | None:
    """The page's number in an id of this writer; null for ids of other writers."""
    x = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x.lstrip("-").isdecimal() and value != x else None


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


def _record(fields: dict[str, str], block: bytes, cut: bool) -> dict:
    kind = fields.get("warc-type", "").lower()
    fault = "cut short" if cut else None if kind else "no type"
    payload, stated = block, len(block)
    if "application/http" in fields.get("content-type", "").lower() or block.startswith(b"HTTP/"):
        http = _head(block, 0)
        if http is None:
            payload, stated, fault = b"", 0, fault or "no end of the HTTP header"
        else:
            payload = block[http[1] :]
            length = _whole(_fields(http[0]).get("content-length"))
            stated = len(payload) if length is None or kind not in ("response", "revisit") else length
    digest = fields.get("warc-payload-digest")
    held = None
    if digest and kind != "revisit":
        name, _, value = digest.rpartition(":")
        try:
            raw = hashlib.new(name or "sha1", payload).digest()
            held = value.upper() == base64.b32encode(raw).decode().rstrip("=") or value.upper() == base64.b32encode(raw).decode() or value.lower() == raw.hex()
        except ValueError:
            fault = fault or "unknown digest"
    if held is False or kind == "response" and stated != len(payload):
        fault = fault or ("digest differs" if held is False else "length differs")
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": _number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload_bytes": stated, "payload_digest": digest.rpartition(":")[2] if digest else None if kind == "revisit" else own,
        "record_type": kind or None, "refers_to": _number(fields.get("warc-refers-to")), "payload": None if kind == "revisit" else payload, "intact": fault is None,
        "record_id": fields.get("warc-record-id"), "refers_to_id": fields.get("warc-refers-to"), "fault": fault,
    }


def parse(data: bytes) -> Iterator[dict]:
    """All records of a member, of any type; what doesn't fit the format comes with a fault instead of an error."""
    at = 0
    while at < len(data):
        at = data.find(b"WARC/", at)
        head = None if at < 0 else _head(data, at)
        if head is None:
            break
        fields, start = _fields(head[0]), head[1]
        length = _whole(fields.get("content-length"))
        end = len(data) if length is None else start + length
        yield _record(fields, data[start:end].removesuffix(b"\r\n\r\n") if length is None else data[start:end], end > len(data))
        at = end


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder, split by byte ranges within files.

    ``fault`` says what is wrong with a record and ``intact`` that nothing is: its length and, if stated, its payload's digest fit.
    page_id and refers_to are the numbers in ids of write_warc(); record_id and refers_to_id are ids of any kind as they stand.
    """
    import pyarrow as pa

    longs, texts = ["page_id", "payload_bytes", "refers_to"], ["url", "payload_digest", "record_type", "record_id", "refers_to_id", "fault"]
    kinds = {n: pa.int64() for n in longs} | {n: pa.string() for n in texts} | {"payload": pa.binary(), "intact": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[0]]) for f in RECORD_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, held = [], 0
                with _open(name) as f:
                    for data in members(f, start, end):
                        for r in parse(data):
                            if not payloads:
                                r["payload"] = None
                            rows.append(r)
                        held += len(data)
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    tasks = max(1, min(MOST_TASKS, ranges.count()))  # a stated number: ranges are tiny rows, which would be coalesced into one task
    return ranges.repartition(tasks).mapInArrow(run, RECORD_SCHEMA)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives hold; ``intact`` tells whether lengths and digests of a record's payload were found as stated."""
    path = new_path(spark, "warc")
    write_warc(spark, table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
