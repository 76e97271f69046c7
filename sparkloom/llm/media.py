"""Media columns: interleaved document sequences.

HTML is parsed to an ordered array of text and media-reference structs; references carry the digest of their payload, a
media store holds payloads under that digest, and a join by digest resolves them; position and caption stay in the struct, so
nothing has to be aligned afterwards. Payloads are kept as binary greyscale images (PGM, 8-bit samples in rows of 24, blocks
of 24 rows), padded with 255. Documents that are plain text are rendered as pages: their paragraphs, with a captioned
reference to the payload that holds the whole text after the first.

Edge cases: null HTML gives an empty sequence, null text an empty payload (one block of padding) and a page of one reference;
a media reference without a source has a null digest and stays unresolved; unknown digests resolve to nulls; equal payloads
are stored once by a task and resolve alike; pages with one key, or none, are resolved each; a very long text is one payload;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, utf8

WIDTH, BLOCK = 24, 576
_HEADER = re.compile(rb"P5\n24 (\d+)\n255\n")
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,source:string,caption:string>>"


def encode_payload(data: bytes) -> bytes:
    """The image that holds data: padded with 255 to a positive multiple of 576 samples."""
    n = max(1, -(-len(data) // BLOCK)) * BLOCK
    return b"P5\n%d %d\n255\n" % (WIDTH, n // WIDTH) + data + b"\xff" * (n - len(data))


def decode_payload(image: bytes) -> bytes:
    """The samples of such an image; ValueError if header and size don't agree."""
    m = _HEADER.match(image)
    if not m or len(image) - m.end() != WIDTH * int(m[1]):
        raise ValueError("not an image of this store")
    return image[m.end() :]


def payload_digest(data: bytes) -> str:
    """SHA-256 of the padded payload, by which references name it."""
    n = max(1, -(-len(data) // BLOCK)) * BLOCK
    return hashlib.sha256(data + b"\xff" * (n - len(data))).hexdigest()


def features(samples: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit difference hash of the image averaged to 8 rows of 9."""
    a = np.frombuffer(samples, np.uint8)
    rows = np.array_split(a.reshape(-1, WIDTH), 8) if len(a) >= 8 * WIDTH else [a.reshape(-1, WIDTH)] * 8
    bands = np.array([r.mean(0) if len(r) else np.zeros(WIDTH) for r in rows])
    cells = np.add.reduceat(bands, np.arange(9) * WIDTH // 9, axis=1) / np.diff([*(np.arange(9) * WIDTH // 9), WIDTH])
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()
    return f"mean={a.mean():.4f};std={a.std():.4f};dhash={bits}"


class _Sequence(HTMLParser):
    """Ordered segments: text between media elements, and the elements with alt text or figure caption."""

    SKIP = {"script", "style", "noscript", "template", "nav", "head"}
    MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
    BREAK = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "table", "ul", "ol", "blockquote", "pre"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.skipping: list[str] = []
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.words))
        text = re.sub(r" ?\n[ \n]*", "\n", text).strip()
        self.words = []
        if text:
            self.add("text", text=text)

    def add(self, kind: str, **own: str | None) -> None:
        self.out.append({"position": len(self.out), "kind": kind, "text": None, "digest": None, "source": None, "caption": None} | own)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipping or tag in self.SKIP:
            if tag in self.SKIP:
                self.skipping.append(tag)
            return
        if tag in self.MEDIA:
            own = dict(attrs)
            self.flush()
            source = own.get("src")
            self.add(self.MEDIA[tag], source=source, digest=source_digest(source), caption=own.get("alt") or own.get("title"))
        elif tag == "figure":
            self.flush()
            self.figure.append(len(self.out))
        elif tag == "figcaption":
            self.caption = []
        if tag in self.BREAK:
            self.words.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for s in self.out[self.figure[-1] if self.figure else len(self.out) :]:
                if s["kind"] != "text" and text:
                    s["caption"] = text
        elif tag == "figure" and self.figure:
            self.flush()
            self.figure.pop()
        if tag in self.BREAK:
            self.words.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            (self.words if self.caption is None else self.caption).append(data)


def data_payload(source: str | None) -> bytes | None:
    """The bytes of a data: URL; None for any other source or a broken one."""
    if not source or not source.startswith("data:") or "," not in source:
        return None
    head, body = source.split(",", 1)
    try:
        return base64.b64decode(body, validate=True) if head.endswith(";base64") else unquote_to_bytes(body)
    except (binascii.Error, ValueError):
        return None


def source_digest(source: str | None) -> str | None:
    """The digest a reference names (sha256:...), or that of the payload it holds, else of the URL it points to."""
    if not source:
        return None
    if source.startswith("sha256:"):
        return source[7:]
    payload = data_payload(source)
    return payload_digest(payload) if payload is not None else hashlib.sha256(source.encode()).hexdigest()


def parse_sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html", *carried: str) -> DataFrame:
    """key, the carried columns, and the page's sequence of segments."""
    keys = [key, *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "digest", "source", "caption"))]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([parse_sequence(h) for h in batch.columns[-1].to_pylist()], kind)], names=[*keys, "sequence"])

    ddl = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keys)
    return pages.select(*keys, html).mapInArrow(run, f"{ddl}, sequence {SEQUENCE}")


def document_page(text: str | None) -> str:
    """A text as HTML: its paragraphs, and after the first the figure that stands for the payload of the whole text."""
    data = utf8(text)
    first, *rest = [f"<p>{escape(p)}</p>" for p in (text or "").split("\n\n")]
    figure = f'<figure><img src="sha256:{payload_digest(data)}" alt="text"><figcaption>text of {len(data)} bytes</figcaption></figure>'
    return f"<article>{first}{figure}{''.join(rest)}</article>"


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array([document_page(t) for t in texts], pa.string())], names=["doc_id", "n_bytes", "html"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, html string")


_STORED = "doc_id long, n_bytes long, digest string, media binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest (of the payload), media: the stored image with the first row of each digest that a task sees, null with later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            sizes, digests, media = [], [], []
            for text in batch.column(1).to_pylist():
                data = utf8(text)
                image = encode_payload(data)
                digest = hashlib.sha256(decode_payload(image)).digest()
                sizes.append(len(data))
                digests.append(digest.hex())
                media.append(None if digest in seen else image)
                seen.add(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "digest", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, _STORED)


_READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_store(store: DataFrame) -> DataFrame:
    """What the stored images hold, read back from their bytes: one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                samples = decode_payload(image)
                rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _READ.split(", ")])

    return store.filter("media is not null").select("digest", "media").mapInArrow(run, _READ).dropDuplicates(["digest"])


def references(sequences: DataFrame, *keys: str) -> DataFrame:
    """keys, position, digest, caption of every media reference: texts are left behind."""
    media = F.filter("sequence", lambda s: s["kind"] != "text")
    each = sequences.select(*keys, F.explode(F.transform(media, lambda s: F.struct(s["position"].alias("position"), s["digest"].alias("digest"), s["caption"].alias("caption")))).alias("s"))
    return each.select(*keys, "s.position", "s.digest", "s.caption")


FACTS = [c.split()[0] for c in _READ.split(", ")[1:]]


def resolved(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs (with a column digest) and what the payloads hold. Only digests and facts are shuffled, never payloads. A digest
    that has more than one in 1,000 of the references is joined by sending its facts to every task: there are fewer than
    1,000 of these, whatever the input. So no digest brings more than that share of the rows to one task."""
    refs, _ = materialize(refs)
    facts, _ = materialize(read_store(store))
    counts = refs.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"))
    least = (counts.agg(F.sum("n")).first()[0] or 0) / 1000
    hot = facts.join(F.broadcast(counts.filter(F.col("n") > least).select("digest")), "digest")
    hot = F.broadcast(hot.select(F.col("digest").alias("_hot"), F.struct(*FACTS).alias("_a")))
    own = refs.join(hot, F.col("digest") == F.col("_hot"), "left")
    # rows that need nothing more are spread by a key that no digest equals
    spread = F.concat(F.lit("-"), F.xxhash64(*[F.col(f"`{c}`") for c in refs.columns]).cast("string"))
    own = own.withColumn("_key", F.when(F.col("_hot").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(spread))
    cold = facts.select(F.col("digest").alias("_cold"), F.struct(*FACTS).alias("_b"))
    full = own.join(cold.hint("merge"), F.col("_key") == F.col("_cold"), "left")
    return full.select(*refs.columns, *[F.coalesce(f"_a.{c}", f"_b.{c}").alias(c) for c in FACTS])


def resolve(sequences: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """sequences with each reference's payload facts in its struct, in the order of the page."""
    known = resolved(references(sequences, key), store).filter("payload_bytes is not null")
    by_page = known.groupBy(F.col(key).alias("_page")).agg(F.map_from_entries(F.collect_set(F.struct("digest", F.struct("payload_bytes", "media_bytes", "media_sha256", "feature")))).alias("_facts"))
    own = ("position", "kind", "text", "digest", "source", "caption")
    with_facts = F.transform("sequence", lambda s: F.struct(*[s[c].alias(c) for c in own], *[F.try_element_at("_facts", F.coalesce(s["digest"], F.lit("")))[c].alias(c) for c in ("payload_bytes", "media_bytes", "media_sha256", "feature")]))
    return sequences.join(by_page.hint("merge"), F.col(key).eqNullSafe(F.col("_page")), "left").select(key, with_facts.alias("sequence"))


def op3_interleaved_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored, _ = materialize(store_texts(docs))
    sequences = interleave(document_pages(docs), "doc_id", "html", "n_bytes")
    chars = F.aggregate("sequence", F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.length(s["text"]), F.lit(0)))
    counted = sequences.select("doc_id", "n_bytes", F.size("sequence").alias("n_segments"), chars.alias("text_chars"), "sequence")
    refs = references(counted, "doc_id", "n_bytes", "n_segments", "text_chars")
    return resolved(refs, stored).select("doc_id", "n_bytes", *FACTS, "position", "caption", "n_segments", "text_chars")
