"""Legacy archive conversion: ARC records of versions 1 and 2 become WARC records.

ARC header lines are parsed by their version's fields, bodies by their declared
length; identifiers, timestamps, types and digests are synthesised. Archives are
rows of a table in the shared folder, so any executor can write and read them
and a lost task is written again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import shared

#: Fixed values of the ARC formats: the fields of a record's header line, by version.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARCHIVE_BYTES, REVISIT_BYTES = 8 << 20, 1000
BROADCAST_ROWS = 1 << 18  # of 40 bytes
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT payload_bytes, sha1(b) payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) top FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < top THEN top END refers_to
FROM r
"""


def clean(value: str | None, default: str = "-") -> str:
    """A header field without white space."""
    return "".join(f"%{ord(c):02X}" if c.isspace() else c for c in value or "") or default


def arc_file(records: list[dict], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file; each record has url, date (14 digits), body (an HTTP response)."""
    head = f"{version} 0 cargolens\n{' '.join(FIELDS[version])}\n".encode()
    rest = f"text/plain {len(head)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(head)}"
    out = [f"filedesc://{name} 0.0.0.0 20200101000000 {rest}\n".encode(), head, b"\n"]
    for r in records:
        size = len(r["body"])
        rest = f"text/html {size}" if version == 1 else f"text/html 200 - - {sum(map(len, out))} {name} {size}"
        out += [f"{clean(r['url'])} 0.0.0.0 {r['date']} {rest}\n".encode(), r["body"], b"\n"]
    return b"".join(out)


def arc_head(data: bytes) -> tuple[dict, list[str], int]:
    """What an ARC file's first record says, the fields of the others, and where they begin; ValueError if of no known version."""
    end = data.index(b"\n")
    about = data[:end].decode("utf-8", "replace").split(" ")
    size = int(about[-1])
    block = data[end + 1 : end + 1 + size].decode("utf-8", "replace").split("\n")
    version = int(block[0].split(" ", 1)[0])
    if version not in FIELDS:
        raise ValueError(f"ARC version {version}")
    return {"filedesc": about[0].removeprefix("filedesc://"), "version": version, "Archive-date": about[2]}, block[1].split() or FIELDS[version], end + 1 + size


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of an ARC file but for its head; ValueError if it is cut off or of no known version."""
    if not data:
        return
    head, names, at = arc_head(data)
    version = head["version"]
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").strip("\r").rsplit(" ", len(names) - 1)  # a URL may have spaces
        if len(values) != len(names):
            raise ValueError(f"ARC header line of {len(values)} fields at byte {at}")
        record = dict(zip(names, values, strict=True)) | {"version": version}
        size = int(record["Archive-length"])
        record["body"] = data[end + 1 : end + 1 + size]
        if len(record["body"]) != size:
            raise ValueError("ARC record shorter than its declared length")
        yield record
        at = end + 1 + size


def arc_contents(data: bytes) -> Iterator[dict]:
    """An ARC file's head and records."""
    if data:
        yield arc_head(data)[0]
        yield from arc_records(data)


def http_parts(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP response; a body without a status line is all payload."""
    if not body.startswith(b"HTTP/"):
        return {}, body
    head, _, payload = body.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, payload


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def date_of(arc: dict) -> str:
    d = arc["Archive-date"].ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(arc: dict, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record; with refers_to a revisit without payload. A file's head becomes a warcinfo record."""
    if "filedesc" in arc:
        block = f"software: cargolens\r\nformat: WARC File Format 1.1\r\nsource-format: ARC {arc['version']}\r\n".encode()
        fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(f"{arc['filedesc']} {arc['Archive-date']}"), "WARC-Date": date_of(arc), "WARC-Filename": arc["filedesc"], "WARC-Block-Digest": sha1_32(block), "Content-Type": "application/warc-fields"}
        return framed(fields, block)
    headers, payload = http_parts(arc["body"])
    key = headers.get("x-page-id") or f"{arc['URL']} {arc['Archive-date']} {hashlib.sha1(arc['body']).hexdigest()}"
    block = arc["body"] if refers_to is None else arc["body"][: len(arc["body"]) - len(payload)]
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(key),
        "WARC-Date": date_of(arc),
        "WARC-Target-URI": arc["URL"],
        "WARC-IP-Address": arc["IP-address"],
        "WARC-Payload-Digest": sha1_32(payload),
        "WARC-Block-Digest": sha1_32(block),
        "Content-Type": "application/http;msgtype=response" if headers else arc["Content-type"],
    }
    if "x-page-id" in headers:
        fields["X-Page-Id"] = headers["x-page-id"]
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page": refers_to, "X-Payload-Length": str(len(payload))}
    return framed(fields, block)


def framed(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def members(data: bytes) -> bytes:
    """What the members of a gzip file hold; gzip.decompress would copy what is left at each of them."""
    view, out, at = memoryview(data), [], 0
    while at < len(view):
        one = zlib.decompressobj(31)
        while not one.eof:
            if at >= len(view):
                raise EOFError("a gzip member is cut off")
            part = view[at : at + (1 << 14)]
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
    return b"".join(out)


def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, payload, refers) to archives: rows become ARC files, and those gzipped WARC files."""

    def archive(records, version):
        arc = arc_file(records, version)
        refers = [None, *(r["refers"] for r in records)]
        return b"".join(gzip.compress(warc_record(a, r), 4, mtime=0) for a, r in zip(arc_contents(arc), refers, strict=True))

    version, kept, size = 1, [], 0
    for batch in batches:
        for r in batch.to_pylist():
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {r['page']}\r\nContent-Length: {len(r['payload'])}\r\n\r\n"
            kept.append({"url": r["url"], "date": "20200101000000", "body": head.encode() + r["payload"], "refers": r["refers"]})
            size += len(r["payload"]) + 200
            if size >= ARCHIVE_BYTES:
                yield pa.record_batch([pa.array([version], pa.int32()), pa.array([archive(kept, version)], pa.binary())], names=["arc_version", "content"])
                version, kept, size = 3 - version, [], 0
    if kept:
        yield pa.record_batch([pa.array([version], pa.int32()), pa.array([archive(kept, version)], pa.binary())], names=["arc_version", "content"])


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())])
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for f, block in warc_records(members(content)):
                if f["warc-type"] == "warcinfo":
                    continue
                _, payload = http_parts(block)
                stated = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                response = f["warc-type"] == "response"
                if response and hashlib.sha1(payload).hexdigest() != stated:
                    raise ValueError("payload and digest differ")
                rows.append({"page": f.get("x-page-id"), "payload_bytes": len(payload) if response else int(f["x-payload-length"]), "payload_digest": stated, "record_type": f["warc-type"], "refers": f.get("x-refers-to-page")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def converted(files: DataFrame) -> DataFrame:
    """(path, record_no, url, record_type, warc, error) of ARC files given as rows of path and content, plain or gzipped.

    Each record is a gzipped WARC record of its own, the file's head a warcinfo
    record. A file that is damaged from some place on gives a row with the
    error after the records before it. Null and empty contents give no row.
    """
    schema = pa.schema([("path", pa.string()), ("record_no", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("warc", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error = [], None
                try:
                    for arc in arc_contents(members(content) if (content or b"").startswith(b"\x1f\x8b") else content or b""):
                        rows.append((arc.get("URL"), "warcinfo" if "filedesc" in arc else "response", gzip.compress(warc_record(arc), 4, mtime=0)))
                except (ValueError, KeyError, IndexError, EOFError, OSError, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                out = [{"path": path, "record_no": k, "url": u, "record_type": t, "warc": w, "error": None} for k, (u, t, w) in enumerate(rows)]
                if error:
                    out.append({"path": path, "record_no": len(rows), "url": None, "record_type": None, "warc": None, "error": error})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, record_no long, url string, record_type string, warc binary, error string")


def archives(pages: DataFrame) -> DataFrame:
    """A table (arc_version, content) of gzipped WARC files with a record for each page.

    Null html is an empty payload, a null url a dash; a null page_id is never
    referred to and revisits any other. Rows of equal payload and equal page_id
    are all responses. What refers to what is found from ids and digests alone;
    it comes back to the pages by broadcast up to a proven number of rows, and
    by id and digest beyond, so copies of one payload never meet in one task.
    """
    base = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page"), F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    narrow = base.filter(F.octet_length("payload") >= REVISIT_BYTES).select("id", F.unhex(F.sha1("payload")).alias("digest"))
    copies = shared.table(narrow.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("rows")).filter("rows > 1 and top is not null").select("digest", "top"), shared.tasks(pages))
    later = shared.table(narrow.filter("id is not null").join(copies, "digest").filter("id < top").distinct(), shared.tasks(pages))
    bounded = lambda df: F.broadcast(df) if later.count() <= BROADCAST_ROWS else df
    with_id = base.filter("id is not null").withColumn("digest", F.unhex(F.sha1("payload"))).join(bounded(later), ["id", "digest"], "left")
    without = base.filter("id is null").withColumn("digest", F.when(F.octet_length("payload") >= REVISIT_BYTES, F.unhex(F.sha1("payload")))).join(copies, "digest", "left")
    rows = with_id.select("page", "url", "payload", "top").unionByName(without.select("page", "url", "payload", "top"))
    return shared.table(rows.select("page", "url", "payload", F.col("top").cast("string").alias("refers")).mapInArrow(convert, "arc_version int, content binary"))


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op10: one row a page, from the archives read back."""
    back = archives(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("content").mapInArrow(read_back, "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    return back.select(F.when(F.col("page") != "null", F.col("page").cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast("long").alias("refers_to"))
