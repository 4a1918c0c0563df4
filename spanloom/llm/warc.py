"""WARC archives: a writer that cuts long records into segments, and a reader that puts them together again.

Write: each page is a response record, or a revisit record if a page with an equal payload and a larger page_id has the
response. What revisits what is found from digests alone; a revisit is written without its html, and html is only shuffled where its digest
may have a second page (a bitmap tells). Blocks over SEGMENT bytes are cut into a first record and continuation records. Payloads go out in
chunked transfer framing. Spark's text writer, with the blank line that ends each record as its line separator, writes
the files to any file system.

Read: files come as bytes, records are cut by Content-Length; segmented ones are grouped by origin identifier, ordered by
segment number, tested for gaps and against WARC-Segment-Total-Length; then the transfer framing is undone and
the payload's digest tested. Files are read once: what a whole record says goes out at once, segments wait for their group.

A record's identifier holds its page_id and digest, and where rows repeat (equal page_id and payload, or null page_ids) also the task and
row that wrote it, so one origin's segments are one page's, whatever the table holds.

Null html counts as an empty payload. Rows with a null page_id are always responses. Repeated page_ids with an
equal payload are all responses if they have the largest id; with different payloads each stands for itself. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import scratch, skew_join, staged, with_possible

SEGMENT = 32_768
#: Records of a file, so that no file is too large for one task.
RECORDS = 4_000
_DATE = "2000-01-01T00:00:00Z"
_PIECE = 8_192


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, piece: int = _PIECE) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + piece] for i in range(0, len(payload), piece))) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + n]
        if len(part) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a transfer chunk is cut off")
        out.append(part)
        at = end + 4 + n


def record(kind: str, identifier: str, target: str, block: bytes, **more) -> bytes:
    """A record without the blank lines that end it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Date": _DATE, "WARC-Target-URI": target, **{k.replace("_", "-"): v for k, v in more.items() if v is not None}}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def identifier(page_id, digest: str, more: str = "") -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{digest}{more}"


def page_records(page_id, url, payload: bytes, digest: str, more: str = "", segment: int = SEGMENT) -> list[bytes]:
    """A response: one record, or a first one and its continuations."""
    name = identifier(page_id, digest, more)
    target, sha = _target(url, name), f"sha1:{digest}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [record("response", f"<{name}>", target, block, Content_Type="application/http;msgtype=response", WARC_Payload_Digest=sha)]
    out = [record("response", f"<{name}>", target, parts[0], Content_Type="application/http;msgtype=response", WARC_Payload_Digest=sha, WARC_Segment_Number=1)]
    for i, part in enumerate(parts[1:], 2):
        out.append(record("continuation", f"<{name}:segment:{i}>", target, part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=i, WARC_Segment_Total_Length=len(block) if i == len(parts) else None))
    return out


def revisit_record(page_id, url, size: int, refers_to: int, digest: str) -> bytes:
    """A page whose payload another page's record holds."""
    name = identifier(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n".encode()
    return record("revisit", f"<{name}>", _target(url, name), http, Content_Type="application/http;msgtype=response", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{identifier(refers_to, digest)}>", WARC_Payload_Digest=f"sha1:{digest}")


def _target(url, name: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or name)


def _base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, compression: str = "gzip") -> None:
    """Writes the archives of a (page_id, url, html) table under `path`."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # digests that several rows share: who holds the response, and in how many rows
    by_page = own.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = by_page.groupBy("sha").agg(F.max("page_id").alias("holder"), F.max_by("n", "page_id").alias("copies"), F.sum("n").alias("n")).where("n > 1").select("sha", "holder", "copies")
    groups = staged(groups, "warc-groups")
    keys = own.select("page_id", "url", F.octet_length("html").alias("size"), "sha")
    again = skew_join(keys, groups, "sha").where(F.col("page_id").isNotNull() & (F.col("page_id") < F.col("holder")))

    def revisits(batches):
        for batch in batches:
            out = [revisit_record(p, u, n, h, _base32(x)) for p, u, n, x, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "size", "sha", "holder")))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    def responses(batches):
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, html, sha, copies in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "copies"))):
                row += 1
                more = f":{task}-{row}" if page_id is None or (copies or 0) > 1 else ""
                out += page_records(page_id, url, html.encode(), _base32(sha), more, segment)
                if sum(map(len, out[-64:])) > 4_000_000 or len(out) > 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    marked = with_possible(own, "sha", groups.select("sha"))
    alone = marked.where("not __possible").select("page_id", "url", "html", "sha", F.lit(None).cast("long").alias("copies"))
    shared = skew_join(marked.where("__possible").select("page_id", "url", "html", "sha"), groups, "sha", "left")
    shared = shared.where(F.col("holder").isNull() | F.col("page_id").isNull() | (F.col("page_id") == F.col("holder"))).select(alone.columns)
    records = alone.unionByName(shared).mapInArrow(responses, "record binary").unionByName(again.mapInArrow(revisits, "record binary"))
    records = records.select(F.col("record").cast("string").alias("value"))
    records.write.options(lineSep="\r\n\r\n", compression=compression, maxRecordsPerFile=RECORDS).text(path)


def parse(data: bytes):
    """(headers in lower case, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, block
        at = end + 8 + n


_RAW = "kind string, name string, refers_to string, digest string, origin string, number int, total long, block binary"


def inflated(name: str, data: bytes) -> bytes:
    """A file's bytes; gzip files may have one member or several."""
    if not name.endswith(".gz"):
        return data
    parts = []
    while data:
        z = zlib.decompressobj(31)
        parts += [z.decompress(data), z.flush()]
        data = z.unused_data
    return b"".join(parts)


def raw_records(data: bytes):
    """Each record as (kind, name, refers_to, digest, origin, number, total, block)."""
    for h, block in parse(data):
        number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
        origin = h.get("warc-segment-origin-id") or (h["warc-record-id"] if number else None)
        yield h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-payload-digest"), origin, int(number) if number else None, int(total) if total else None, block


def _read(spark: SparkSession, path: str, schema: str, take) -> DataFrame:
    """What take(record) gives for each record (None: nothing), in one pass over the files and one Python worker a task."""
    fields = T.StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        own = to_arrow_schema(fields)
        for batch in batches:
            for i in range(batch.num_rows):
                data = inflated(batch.column("path")[i].as_py(), batch.column("content")[i].as_py())
                rows, size = [], 0
                for r in raw_records(data):
                    row = take(r)
                    if row is not None:
                        rows.append(row)
                        size += len(row[-1] or b"") + 100
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), own.types)], schema=own)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), own.types)], schema=own)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under `path`."""
    return _read(spark, path, _RAW, lambda r: r)


def assemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block that (segment number, total length, block) rows of one origin make up."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or stands there twice")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] is None or parts[-1][1] != len(block):
        raise ValueError("the segments don't have the total length")
    return block


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(name: str | None) -> int | None:
    name = name.removeprefix("<urn:page:").split(":")[0] if name else "null"
    return None if name == "null" else int(name)


def _payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return fields, unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _described(kind: str, name: str, refers_to: str | None, digest: str, block: bytes) -> tuple:
    fields, payload = _payload(block)
    if kind == "revisit":
        return _number(name), int(fields["content-length"]), digest.removeprefix("sha1:"), kind, _number(refers_to)
    if f"sha1:{digest_of(payload)}" != digest:
        raise ValueError(f"the payload of {name} doesn't have its digest")
    return _number(name), len(payload), digest_of(payload), kind, None


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page in the archives, segments put together."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def joined(batches):
        for batch in batches:
            rows = []
            for origin, parts in zip(batch.column("origin").to_pylist(), batch.column("parts").to_pylist()):
                first = min(parts, key=lambda p: p["number"])
                rows.append(_described(first["kind"], origin, None, first["digest"], assemble([(p["number"], p["total"], p["block"]) for p in parts])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    # one pass over the files: whole records are described at once, segments go on as they are
    segment = "kind string, digest string, origin string, number int, total long, block binary"
    both = _read(spark, path, f"{_PAGES}, {segment}", lambda r: (*_described(*r[:4], r[7]), *[None] * 6) if r[5] is None else (*[None] * 5, r[0], *r[3:]))
    both = staged(both, "warc-read")
    whole = both.where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    # a group is one page's segments
    groups = both.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "kind", "total", "digest", "block")).alias("parts"))
    return whole.unionByName(groups.mapInArrow(joined, _PAGES))


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives, reads them back and gives what read_pages() does."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path)
    return read_pages(spark, path)
