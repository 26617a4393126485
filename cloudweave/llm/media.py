"""Interleaved document sequences: ordered text and media references of HTML, with payloads resolved by digest.

Pages are parsed into sequences of text and media items, each with its position and, for media, its caption and the
digest by which its source names the payload. References are joined to a media table by digest and put back into their
sequences in place; only what describes a payload crosses the network, never the payload. Payloads are stored as raster
images of 64 pixels a row, losslessly.
"""

from __future__ import annotations

import hashlib
import zlib
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm.common import map_arrow, table, written

#: Bytes of a row: 64 pixels of three 8-bit samples.
ROW, ACROSS = 192, 64
SCHEME = "sha256:"
BREAKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "td", "tr", "table", "br", "blockquote", "pre", "figure", "nav", "header", "footer"}
MEDIA = {"img", "video", "audio", "source", "embed"}
SILENT = {"script", "style", "template", "noscript"}


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.silent = 0

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.items.append({"kind": "text", "text": words, "source": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                self.items.append({"kind": "media", "text": None, "source": found["src"], "caption": " ".join((found.get("alt") or found.get("title") or "").split()) or None})
                self.figure.append(len(self.items) - 1)
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            for i in self.figure if words else ():
                self.items[i]["caption"] = words
        elif tag in BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page in order: position, kind (text or media), text, source, digest, caption.

    A figure's caption is that of all media in it; without one, a medium's alternative text is its caption. The digest
    is that of a source by the digest scheme, else null.
    """
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    for i, item in enumerate(parser.items):
        source = item["source"]
        item |= {"position": i, "digest": source[len(SCHEME) :] if source and source.startswith(SCHEME) else None}
    return parser.items


_ITEM = [("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("source", pa.string()), ("digest", pa.string()), ("caption", pa.string())]
ITEMS = "items array<struct<position: int, kind: string, text: string, source: string, digest: string, caption: string>>"


def sequences(pages: DataFrame, row_id: str | None = None) -> DataFrame:
    """doc_id, items of each row of pages (doc_id, html), with its row_id (long) if named; null and empty pages have no items."""
    names = ["doc_id"] + ([row_id] if row_id else [])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {n: batch.column(n) for n in names} | {"items": [parse(h) for h in batch.column("html").to_pylist()]}

        return step

    longs = [F.col(n).cast("long").alias(n) for n in names]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("items", pa.list_(pa.struct(_ITEM)))])
    return map_arrow(pages.select(*longs, F.col("html").cast("string")), make, ", ".join(f"{n} long" for n in names) + f", {ITEMS}", schema)


def _referred(refs: DataFrame, media: DataFrame) -> DataFrame:
    """refs (digest, ...) with the columns of media, nulls where there is none.

    References without a digest are no part of the join, as they would all be one key of it; a digest that a third of
    all pages name is one row of media and many references, which Spark may split.
    """
    named = refs.where(F.col("digest").isNotNull()).join(media, "digest", "left")
    return named.unionByName(refs.where(F.col("digest").isNull()), allowMissingColumns=True)


def resolved(sequenced: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each media item: doc_id, position, caption, digest and the columns of media (one row a digest).

    Items without a digest, or with one that media lacks, have nulls there.
    """
    refs = sequenced.select("doc_id", F.explode("items").alias("item")).where("item.kind = 'media'").select("doc_id", "item.position", "item.caption", "item.digest")
    return _referred(refs, media)


def interleaved(sequenced: DataFrame, media: DataFrame) -> DataFrame:
    """row_id, doc_id, items of each row of sequenced (row_id, which no other row has; doc_id; items).

    items are all of the row's texts and media in their order: position, kind, text, caption, digest, and payload, a
    struct of what media (one row a digest) has for a medium's digest, null for texts and where there is nothing. A row
    without items has an empty array. sequenced is read twice (once for its digests alone), so it should be a written
    table. Where media is one too, Spark may split the references to a digest that many pages name.
    """
    described = [c for c in media.columns if c != "digest"]
    named = F.array_distinct(F.transform(F.filter("items", lambda i: i["digest"].isNotNull()), lambda i: i["digest"]))
    refs = sequenced.select("row_id", F.explode(named).alias("digest"))
    # A source says no more than its digest, so it needn't be shuffled with the rest.
    bare = sequenced.select("row_id", "doc_id", F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in ("position", "kind", "text", "caption", "digest")))).alias("items"))
    found = refs.join(media.select("digest", F.struct(*described).alias("payload")), "digest")
    # Each digest of a page once, so a map holds no more than its page does.
    payloads = found.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("digest", "payload"))).alias("_payloads"))
    in_place = F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in ("position", "kind", "text", "caption", "digest")), F.try_element_at("_payloads", i["digest"]).alias("payload")))
    return bare.join(payloads, "row_id", "left").select("row_id", "doc_id", in_place.alias("items"))


def store(data: bytes) -> bytes:
    """The payload (data padded with blanks to full rows, one at least) as a portable pixmap that notes data's length."""
    rows = max(1, -(-len(data) // ROW))
    return b"P6\n# bytes %d\n%d %d\n255\n" % (len(data), ACROSS, rows) + data.ljust(rows * ROW, b" ")


def read_back(stored: bytes) -> tuple[int, np.ndarray]:
    """The noted length and the samples (rows, pixels, channels) of a stored pixmap."""
    magic, note, shape, depth, samples = stored.split(b"\n", 4)
    across, rows = map(int, shape.split())
    if magic != b"P6" or depth != b"255" or len(samples) != across * rows * 3:
        raise ValueError("not a pixmap of 8-bit samples")
    return int(note.rsplit(b" ", 1)[1]), np.frombuffer(samples, np.uint8).reshape(rows, across, 3)


def feature(samples: np.ndarray) -> str:
    """Size, sums of the channels, sum of differences along rows, and counts of samples in eight ranges."""
    sums = samples.sum(axis=(0, 1), dtype=np.int64)
    flat = samples.reshape(len(samples), -1).astype(np.int16)
    edges = int(np.abs(np.diff(flat, axis=1)).sum(dtype=np.int64))
    bins = np.bincount(samples.reshape(-1) >> 5, minlength=8)
    return f"{samples.shape[1]}x{samples.shape[0]};" + ",".join(map(str, sums)) + f";{edges};" + ",".join(map(str, bins))


STORED = f"doc_id long, {ITEMS}, images array<binary>"
_STORED = pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.struct(_ITEM))), ("images", pa.list_(pa.binary()))])
DESCRIBED = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
_DESCRIBED = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])


def page_of(text: str, digest: str, tail: str) -> str:
    """A page about a text: a heading (its first words), its image with a caption, a paragraph, and its last row's image."""
    heading = escape(" ".join(text[:400].split())[:80])
    size = f"{len(text.encode())} bytes"
    return (
        f'<article><h1>{heading}</h1><figure><img src="{SCHEME}{digest}" alt="image"><figcaption>Text of {size}</figcaption></figure>'
        f'<p>The last row of {size}:</p><img src="{SCHEME}{tail}" alt="last row"><p>End</p></article>'
    )


def stored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, items (parsed from a page that shows the text's image and its last row's), images (stored) of each row."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"doc_id": batch.column("doc_id"), "items": [], "images": []}
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                images = [store(data), store(data[max(0, len(data) - 1) // ROW * ROW :])]
                digests = [hashlib.sha256(i).hexdigest() for i in images]
                out["items"].append(parse(page_of(text or "", *digests)))
                out["images"].append(images[: len(set(digests))])
            return out

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, STORED, _STORED)


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes of media (stored) hold, read back, by the digest of these bytes; one row for each digest."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in _DESCRIBED.names}
            for stored in batch.column("stored").to_pylist():
                n, samples = read_back(stored)
                payload = samples.tobytes()
                row = (hashlib.sha256(stored).hexdigest(), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), feature(samples))
                for name, value in zip(_DESCRIBED.names, row, strict=True):
                    out[name].append(value)
            return out

        return step

    return map_arrow(media.select("stored"), make, DESCRIBED, _DESCRIBED).dropDuplicates(["digest"])


def image_sequences(docs: DataFrame) -> DataFrame:
    """Each row's text as an image in a page, the page as a sequence with its media resolved in place.

    doc_id, what is known of the text's image, its position and caption, and items, the whole sequence. Null texts count
    as empty, and an empty text is a row of blanks. Equal texts have equal pages, are stored with one digest and are
    described alike. Repeated rows are repeated, a null doc_id is kept, an empty table gives no rows, and other columns
    are not looked at. The stored images are written to the shared folder and read back from there; so are
    the parsed pages, so that none is parsed twice.
    """
    # The rows' own numbers are written with them, so they are the same for all who read them.
    bare = F.transform("items", lambda i: i.dropFields("source"))
    kept = written(stored_documents(docs).withColumn("items", bare).withColumn("row_id", F.monotonically_increasing_id()), "media", compression="zstd")
    media = described(kept.select(F.explode("images").alias("stored")))
    found = interleaved(kept.select("row_id", "doc_id", "items"), media)
    own = found.withColumn("own", F.get(F.filter("items", lambda i: i["kind"] == "media"), F.lit(0)))
    return own.select("doc_id", "own.payload.*", F.col("own.digest").alias("media_sha256"), "own.position", "own.caption", "items")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as images in interleaved sequences, with features of the images."""
    found = image_sequences(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "items")
