"""Media columns: interleaved sequences of text and media of HTML documents.

HTML is parsed to ordered structs, either text or a media reference with its
caption; references name a payload by digest, and a join by digest resolves
them. Payloads are kept once for each digest, as greyscale PNG (8-bit samples,
lossless), and features are computed from the stored bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import shared
from cargolens.llm.passages import keyed

UNIT, WIDTH = 576, 24
BLOCKS = ("p", "div", "li", "h1", "h2", "h3", "tr", "article", "section", "figure")
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"
MEDIA_FIELDS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def padded(data: bytes) -> bytes:
    """data and as many bytes 255 as make a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT or UNIT * (not data))


def png(samples: bytes) -> bytes:
    """A greyscale PNG of WIDTH columns with these 8-bit samples."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter byte 0: samples as they are
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + chunk(b"IEND", b"")


def samples_of(data: bytes) -> np.ndarray:
    """The samples of such a PNG, checksums verified."""
    if not data.startswith(PNG_HEAD):
        raise ValueError("not a PNG")
    at, body, size = len(PNG_HEAD), [], None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("another PNG filter")
    return raw[:, 1:]


def candidates(srcset: str) -> list[str]:
    """The addresses of a srcset: separated by commas, each with an optional descriptor after a space; an address may hold commas."""
    out, at = [], 0
    while m := re.compile(r"[\s,]*([^\s,]\S*)").match(srcset, at):
        out.append(m.group(1).rstrip(","))
        at = m.end()
        if not m.group(1).endswith(","):  # a descriptor reaches to the next comma
            end = srcset.find(",", at)
            at = len(srcset) if end < 0 else end
    return out


class Sequence(HTMLParser):
    """Collects text and media references in document order.

    References are src and srcset of img, video, audio and of source inside
    picture, video and audio; an address named twice by one picture, video or
    audio is one reference. A figcaption belongs to all media of the innermost
    open figure, before or after it, and stands before their alt texts. Outside
    a figure, or in one without media, it is text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.hidden = 0
        self.figures: list[dict] = []  # of each open figure its media, its caption and where that stood
        self.group: list[dict] | None = None  # media of the open picture, video or audio

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def refer(self, a: dict):
        self.flush()
        for address in [a.get("src") or "", *candidates(a.get("srcset") or "")]:
            digest = address.removeprefix("sha256:")
            if not digest or any(x["digest"] == digest for x in self.group or []):
                continue
            item = {"kind": "media", "text": None, "digest": digest, "caption": a.get("alt")}
            self.items.append(item)
            if self.group is not None:
                self.group.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("picture", "video", "audio"):
            self.group = []
            self.refer(a)
        elif tag == "source" and self.group is not None:
            self.refer(a)
        elif tag == "img":
            alone = self.group is None
            self.group = [] if alone else self.group
            self.refer(a)
            for x in self.group:  # the alternatives of a picture share its alt
                x["caption"] = a.get("alt") if x["caption"] is None else x["caption"]
            self.group = None if alone else self.group
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCKS or tag == "br":
            self.flush()
        if tag == "figure":
            self.figures.append({"media": [], "caption": "", "at": 0})

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("picture", "video", "audio"):
            self.group = None
        elif tag == "figcaption" and self.caption is not None:
            self.close_caption()
        elif tag in BLOCKS:
            if tag == "figure" and self.caption is not None:
                self.close_caption()
            self.flush()
        if tag == "figure" and self.figures:
            self.close_figure()

    def close_caption(self):
        words = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figures and not self.figures[-1]["caption"]:
            self.figures[-1] |= {"caption": words, "at": len(self.items)}
        else:
            self.text.append(words)
            self.flush()

    def close_figure(self):
        figure = self.figures.pop()
        for x in figure["media"]:
            x["caption"] = figure["caption"] or x["caption"]
        if figure["caption"] and not figure["media"]:
            self.items.insert(figure["at"], {"kind": "text", "text": figure["caption"], "digest": None, "caption": None})

    def finish(self):
        """Closes what the page left open."""
        if self.caption is not None:
            self.close_caption()
        self.flush()
        while self.figures:
            self.close_figure()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence(page: str | None) -> list[dict]:
    parser = Sequence()
    parser.feed(page or "")
    parser.close()
    parser.finish()
    return [{"pos": k, **x} for k, x in enumerate(parser.items)]


def interleaved(pages: DataFrame, key: str = "key", column: str = "html") -> DataFrame:
    """key and items: the ordered text and media structs of each page; null html has none."""
    item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([sequence(x) for x in batch.column(1).to_pylist()], pa.list_(item))], names=["key", "items"])

    return pages.select(F.col(key).alias("key"), F.col(column).alias("html")).mapInArrow(parse, f"key long, items array<{ITEM}>")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """key, pos, caption, digest and the media's columns for each reference; one without payload keeps nulls."""
    refs = sequences.select("key", F.explode("items").alias("item")).filter("item.kind = 'media'").select("key", "item.pos", "item.caption", "item.digest")
    return refs.join(media, "digest", "left")


def resolved(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """key and items: each sequence whole and in order, text as it was and `media`, the media's columns, in every reference that has a payload.

    Only references are joined; media has a row a digest. A sequence without
    items stays an empty one, rows of one key stay one sequence each.
    """
    rows = shared.table(sequences.select(F.monotonically_increasing_id().alias("_row"), "key", "items"))  # numbers that a lost task can't change
    items = rows.select("_row", "key", F.explode_outer("items").alias("item"))
    columns = [c for c in media.columns if c != "digest"]
    found = media.select(F.col("digest").alias("_digest"), F.struct(*columns).alias("media"))
    refs = items.filter("item.kind = 'media'").join(found, F.col("item.digest") == F.col("_digest"), "left").drop("_digest")
    rest = items.filter("item IS NULL OR item.kind <> 'media'").withColumn("media", F.lit(None).cast(found.schema["media"].dataType))
    whole = F.struct("item.pos", "item.kind", "item.text", "item.digest", "item.caption", "media")
    each = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), whole)))
    return refs.unionByName(rest).groupBy("_row", "key").agg(each.alias("items")).select("key", "items")


def described(samples: np.ndarray) -> str:
    """Size, mean, spread and eight shares of sample values."""
    flat = samples.ravel()
    shares = np.bincount(flat >> 5, minlength=8)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={flat.mean(dtype=np.float64):.3f};std={flat.std(dtype=np.float64):.3f};hist={','.join(map(str, shares))}"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest and features of each stored medium, from its bytes."""
    for batch in batches:
        out = []
        for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if hashlib.sha256(data).hexdigest() != digest:
                raise ValueError("payload and digest differ")
            samples = samples_of(data)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), digest, described(samples)))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, MEDIA_FIELDS, strict=True))], names=["digest", *(n for n, _ in MEDIA_FIELDS)])


def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pid, n_bytes, digest and medium of each text; a text that the batch had before has a null medium."""
    for batch in batches:
        seen, out = set(), []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            data = png(padded(text or b""))
            digest = hashlib.sha256(data).hexdigest()
            out.append((len(text or b""), digest, None if digest in seen else data))
            seen.add(digest)
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary()), strict=True))], names=["pid", "n_bytes", "digest", "data"])


def document_media(docs: DataFrame) -> DataFrame:
    """For each document the medium its page refers to, and the medium's features.

    A null text is empty (one unit of padding). Rows that share a doc_id keep a
    row each; equal texts share one medium. Other columns are not read.
    """
    base = keyed(docs).mapInArrow(stored, "pid long, n_bytes long, digest string, data binary")  # encoded twice: cheaper than keeping media on disk
    media = base.filter("data is not null").select("digest", "data").groupBy("digest").agg(F.first("data").alias("data")).mapInArrow(features, "digest string, " + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    page = F.concat(F.lit("<article><p>Document "), F.coalesce(F.col("pid").cast("string"), F.lit("")), F.lit('</p><figure><img src="sha256:'), F.col("digest"), F.lit('" alt=""><figcaption>'), F.col("n_bytes"), F.lit(" bytes</figcaption></figure><p>End</p></article>"))
    found = resolve(interleaved(base.select(F.col("pid").alias("key"), page.alias("html"))), media)
    return found.withColumn("n_bytes", F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")).withColumnRenamed("key", "pid")


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op5: one row a document with what its stored medium holds."""
    out = document_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("pid").alias("doc_id"), "n_bytes", *(n for n, _ in MEDIA_FIELDS))
