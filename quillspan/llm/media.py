"""Media columns: interleaved document sequences with payloads resolved by digest.

HTML is parsed into an ordered array of text and media-reference structs. References name a stored object by the digest
of its bytes; a join with the table of objects brings the bytes to the reference, where they are read back, and positions
and captions stay where they were. Objects are grey PNG images of 8 bits a sample, one row of samples each, which also
keep the unpadded length as a text chunk, so that any bytes can be stored without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.html_events import Walker
from quillspan.llm.shared import extended, written

ROW = 64
PNG = b"\x89PNG\r\n\x1a\n"
SPREAD = 4096  # an object with more than 1/SPREAD of all references is one of SPREAD at most, and its references are dealt out


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(raw: bytes) -> bytes:
    """A PNG image of the bytes, padded with zeros to a multiple of ROW samples, ROW at least, all in one row."""
    samples = raw + bytes(ROW - len(raw) % ROW if len(raw) % ROW or not raw else 0)
    head = struct.pack(">IIBBBBB", len(samples), 1, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(b"\0" + samples, 6)) + _chunk(b"IEND", b"")


def from_image(stored: bytes) -> tuple[int, bytes]:
    """Unpadded length and samples of a stored image; fails on anything else."""
    chunks, at = {}, len(PNG)
    while at < len(stored):
        size, kind = struct.unpack_from(">I4s", stored, at)
        data = stored[at + 8 : at + 8 + size]
        if stored[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError("a broken chunk")
        chunks[kind] = data
        at += 12 + size
    if not stored.startswith(PNG) or list(chunks) != [b"IHDR", b"tEXt", b"IDAT", b"IEND"]:
        raise ValueError("not a whole stored image")
    width, height, *form = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    row = zlib.decompress(chunks[b"IDAT"])
    if (height, form) != (1, [8, 0, 0, 0, 0]) or len(row) != width + 1 or row[0]:
        raise ValueError("not a stored image's form")
    return int(chunks[b"tEXt"].split(b"\0")[1]), row[1:]


def image_feature(samples: bytes) -> str:
    """Rows, mean, spread and a 64-bit average hash over columns."""
    a = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    columns = a.sum(axis=0, dtype=np.int64)
    bits = int("".join("1" if x else "0" for x in columns * ROW > columns.sum()), 2)
    mean = columns.sum() / a.size
    spread = float(np.sqrt(max(0.0, np.square(a, dtype=np.uint32).sum(dtype=np.int64) / a.size - mean * mean)))
    return f"rows={len(a)};mean={mean:.4f};spread={spread:.4f};hash={bits:016x}"


def stored_media(docs: DataFrame, text_col: str = "text", once: bool = False) -> DataFrame:
    """docs' other columns with digest (SHA-256 of the stored form) and media, the stored form of each whole text; null is empty.

    With `once`, media is null where the same batch of rows holds the object already.
    """
    rest = [c for c in docs.columns if c not in (text_col, "digest", "media")]
    base = docs.select(*rest, text_col)

    def run(batches):
        for batch in batches:
            held = set()
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = [to_image(x.encode() if x is not None else b"") for x in part.column(len(rest)).to_pylist()]
                digests = [hashlib.sha256(m).hexdigest() for m in media]
                if once:
                    media = [None if d in held or held.add(d) else m for d, m in zip(digests, media)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=[*rest, "digest", "media"])

    return base.mapInArrow(run, extended(docs.select(*rest), "digest string, media binary"))


MEASURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with what is read back from the stored bytes in media_col, in place of them: lengths, digests of payload and stored form, feature.

    Null bytes have null measures. Columns named as the measures are replaced.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    rest = [c for c in media.columns if c not in (media_col, *names)]
    base = media.select(*rest, media_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for held in part.column(len(rest)):
                    if not held.is_valid:
                        rows.append((None,) * len(names))
                        continue
                    stored = held.as_py()
                    n, samples = from_image(stored)
                    rows.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), image_feature(samples)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[*rest, *names])

    return base.mapInArrow(run, extended(base.drop(media_col), MEASURES))


class _Sequence(Walker):
    def __init__(self):
        super().__init__()
        self.items: list[dict] = []
        self.waiting: list[dict] = []  # media of the open figure, which its caption names

    def handle_starttag(self, tag, attrs):
        if tag == "figure":
            self.waiting = []
        super().handle_starttag(tag, attrs)

    def on_block(self, text, tag, link, apart, region):
        if tag == "figcaption" and self.waiting:
            for m in self.waiting:
                m["caption"] = text
            return
        self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def on_media(self, tag, attrs):
        if attrs.get("src"):
            self.flush()
            self.items.append({"kind": "media", "text": None, "ref": attrs["src"], "caption": attrs.get("alt") or None})
            self.waiting.append(self.items[-1])


ITEM = "array<struct<kind:string,text:string,ref:string,caption:string>>"


def parsed_sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with items: text and media-reference structs in page order; null html has none. A figure's caption stands with its media."""
    rest = [c for c in pages.columns if c not in (html_col, "items")]
    base = pages.select(*rest, html_col)
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "text", "ref", "caption")]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                items = [_Sequence().walk(h).items if h else [] for h in part.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(items, kind)], names=[*rest, "items"])

    return base.mapInArrow(run, extended(pages.select(*rest), f"items {ITEM}"))


def referenced(sequences: DataFrame, media: DataFrame, key: str, media_col: str = "media", prefix: str = "sha256:") -> DataFrame:
    """A row for each item of `sequences`: key, pos, kind, text, ref, caption and media_col, the bytes that the reference names.

    media holds digest and media_col, copies allowed. Items without a reference that starts with `prefix` move no bytes
    and take no part in the join. An object with more than 1/SPREAD of all references is laid out several times, in
    proportion to them, and its references are dealt over these copies; there are fewer than SPREAD such objects, so
    their digests are broadcast.
    """
    one = sequences.select(F.col(key).alias("key"), F.posexplode_outer("items").alias("pos", "item"))
    one = written(one.select("key", "pos", "item.kind", "item.text", "item.ref", "item.caption"), "items", "zstd")
    one = one.withColumn("digest", F.when(F.startswith("ref", F.lit(prefix)), F.unhex(F.substr("ref", F.lit(len(prefix) + 1)))))
    objects = media.select(F.unhex("digest").alias("digest"), F.col(media_col).alias("bytes")).where("digest is not null and bytes is not null")
    named = one.where("digest is not null")
    counts = named.groupBy("digest").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    often = F.broadcast(written(counts.where(F.col("n") * SPREAD > total).select("digest", F.ceil(F.col("n") * SPREAD / F.lit(max(total, 1))).cast("int").alias("copies")), "often"))
    few = objects.join(often, "digest", "left_anti").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    plain = named.join(often, "digest", "left_anti").join(few, "digest", "left")
    many = objects.join(often, "digest").groupBy("digest", "copies").agg(F.first("bytes").alias("bytes"))
    many = many.select("digest", "bytes", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = named.join(often, "digest").withColumn("copy", F.pmod(F.xxhash64("key", "pos"), F.col("copies")).cast("int"))
    dealt = dealt.join(many, ["digest", "copy"], "left")
    columns = ["key", "pos", "kind", "text", "ref", "caption"]
    out = one.where("digest is null").select(*columns, F.lit(None).cast("binary").alias("bytes"))
    for part in (plain, dealt):
        out = out.unionByName(part.select(*columns, "bytes"))
    return out.withColumnsRenamed({"key": key, "bytes": media_col})


def packed(items: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, items): rows of `referenced` put together again, in order, with the given columns as each item's object; null where all are."""
    found = F.when(F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull(), F.struct(*columns))
    item = F.struct("pos", "kind", "text", "ref", "caption", found.alias("object"))
    lists = items.groupBy(key).agg(F.collect_list(F.when(F.col("pos").isNotNull(), item)).alias("items"))
    return lists.select(key, F.array_sort("items", lambda a, b: a["pos"] - b["pos"]).alias("items"))


def resolved(sequences: DataFrame, media: DataFrame, key: str, media_col: str = "media", prefix: str = "sha256:") -> DataFrame:
    """(key, items) with the stored bytes, as object.<media_col>, in each media struct whose reference names a known digest.

    Text structs and unknown references have a null object and keep their places. key must be unique; a document with
    no items gets an empty array.
    """
    return packed(referenced(sequences, media, key, media_col, prefix), key, [media_col])


def media_report(docs: DataFrame) -> DataFrame:
    """Stores each document's text as an object, shows it in an interleaved page by digest, and reads it back behind the join.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, and the
    media's position and caption. Objects are written to a table; the bytes that are measured are those that the join
    brings from it. Null texts are empty, repeated rows and ids are documents of their own, and an empty table stays empty.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    stored = written(stored_media(docs.select("doc_id", "text"), once=True).withColumn("row", F.monotonically_increasing_id()), "objects", "zstd")
    said = F.concat(F.lit("text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    html = F.concat(F.lit("<article><p>"), said, F.lit('</p><figure><img src="sha256:'), "digest", F.lit('"><figcaption>'), said, F.lit("</figcaption></figure></article>"))
    pages = stored.select(F.struct("row", "doc_id").alias("key"), html.alias("html"))
    shown = referenced(parsed_sequences(pages), stored, "key").where("kind = 'media'")
    found = measured_media(shown.select("key.doc_id", "pos", "caption", "media"))
    return found.select("doc_id", *names, F.col("pos").alias("position"), "caption")
