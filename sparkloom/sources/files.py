"""Sources: folders of files, web pages, and the parsing of both to text."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS, extension, hidden


class _Text(HTMLParser):
    BLOCK = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "title", "ul", "ol", "table", "nav", "header", "footer"}
    SKIP = {"script", "style", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.skip += tag in self.SKIP
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        self.skip -= tag in self.SKIP and self.skip > 0
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data) -> None:
        if not self.skip:
            self.parts.append(re.sub(r"\s+", " ", data))


def html_text(html: str | None) -> str:
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = [x.strip() for x in "".join(p.parts).split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def _office(data: bytes, member: str) -> str:
    """Text of the paragraphs in the parts of a zipped office file whose names begin with member."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for name in sorted(n for n in z.namelist() if n.startswith(member) and n.endswith(".xml")):
            for e in ElementTree.fromstring(z.read(name)).iter():
                if e.tag.endswith("}p"):
                    out.append("".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")))
        return "\n".join(out)


def _workbook(data: bytes) -> str:
    """Rows of the sheets of an .xlsx file, by sheet number, the filled cells of each parted as those of .csv; dates are the
    numbers they are stored as, formulas their last values."""

    def named(e: ElementTree.Element, *tags: str) -> Iterator[ElementTree.Element]:
        return (x for x in e.iter() if x.tag.rpartition("}")[2] in tags)

    def string(e: ElementTree.Element) -> str:
        sounds = {t for r in named(e, "rPh") for t in r.iter()}  # phonetic guides aren't the cell's text
        return "".join(t.text or "" for t in named(e, "t") if t not in sounds)

    def value(c: ElementTree.Element) -> str:
        v = next((x.text or "" for x in named(c, "v")), "")
        kind = c.get("t")
        if kind == "inlineStr":
            return string(c)
        if kind == "s":
            return shared[int(v)] if v else ""
        return ("TRUE" if v == "1" else "FALSE") if kind == "b" and v else v

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [string(e) for e in named(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
        sheets = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))]
        rows = [[value(c) for c in named(r, "c")] for _, n in sorted(sheets) for r in named(ElementTree.fromstring(z.read(n)), "row")]
        return "\n".join(" | ".join(filter(None, r)) for r in rows if any(r))


def parse_bytes(data: bytes, ext: str) -> str:
    """Text of a file by its suffix. PDF needs a parser that isn't part of this package, and is an error without one."""
    if ext in (".html", ".htm"):
        text = html_text(data.decode("utf-8", "replace"))
    elif ext in (".docx", ".pptx"):
        text = _office(data, {".docx": "word/document", ".pptx": "ppt/slides/slide"}[ext])
    elif ext == ".xlsx":
        text = _workbook(data)
    elif ext == ".csv":
        text = "\n".join(" | ".join(row) for row in csv.reader(io.StringIO(data.decode("utf-8", "replace"))))
    elif ext == ".pdf":
        from pypdf import PdfReader  # optional

        text = "\n".join(page.extract_text() for page in PdfReader(io.BytesIO(data)).pages)
    else:
        text = data.decode("utf-8", "replace")
    return re.sub("\n{3,}", "\n\n", text).strip()


_PARSED = "path string, text string, error string"

#: Characters gathered before rows are sent on. Spark bounds what a worker is given (10,000 rows or 64 MB at a time), but a worker
#: that kept the texts of all of it, as it made them and as it sends them, held many times that.
_SENT = 1 << 20


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches, made one at a time."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _sent(rows: Iterator[tuple[str | None, str | None, str | None]]) -> Iterator[pa.RecordBatch]:
    """Rows of _PARSED in batches that end with the row that reaches _SENT characters."""

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=["path", "text", "error"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if x)  # rows without text take room too
        if size >= _SENT:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[str | None, str | None, str | None]]:
        for path, ext, data in _each(batches):
            try:
                yield path, parse_bytes(data, ext), None
            except Exception as e:  # a file that can't be read is a row with its error, not a failed job
                yield path, None, f"{type(e).__name__}: {e}"

    return _sent(rows())


def scan_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, text, error of the files below folder that have one of the suffixes and no hidden part in their path below it."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(files["path"], "^file:/*", "/")
    below = F.substring(path, len(re.sub("^file:/*", "/", root)) + 2, 1 << 20)
    own = files.select(path.alias("path"), extension(path).alias("ext"), "content").filter(extension("path").isin(*extensions) & ~hidden(below))
    return own.mapInArrow(_parse, _PARSED)


def load_path(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of the files below a folder, or of one file; a path that isn't there is a row with its error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([(path, None, "FileNotFoundError: no such file or folder")], _PARSED)
    if fs.getFileStatus(p).isDirectory():
        return scan_folder(spark, path)
    one = spark.read.format("binaryFile").load(re.sub(r"([\\*?\[\]{}])", r"\\\1", path))
    return one.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), extension("path").alias("ext"), "content").mapInArrow(_parse, _PARSED)


def html_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """path, text, error of pages already fetched."""
    own = pages.select(F.col(url).alias("path"), F.lit(".html").alias("ext"), F.encode(html, "UTF-8").alias("content"))
    return own.mapInArrow(_parse, _PARSED)


def fetch_urls(urls: DataFrame, column: str = "url", timeout: float = 30.0) -> DataFrame:
    """path, text, error of http(s) URLs, fetched by the executors."""

    def fetched(url: str | None) -> str:
        from urllib.request import Request, urlopen

        if not re.match("(?i)https?:", url or ""):
            raise ValueError("not an http(s) URL")
        with urlopen(Request(url, headers={"User-Agent": "sparkloom/1"}), timeout=timeout) as r:
            ext = (re.search(r"\.[A-Za-z0-9]+$", url.split("?")[0].rsplit("/", 1)[-1]) or [".html"])[0].lower()
            return parse_bytes(r.read(), ext if ext in EXTENSIONS else ".html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str | None, str | None, str | None]]:
            for (u,) in _each(batches):
                try:
                    yield u, fetched(u), None
                except Exception as e:
                    yield u, None, f"{type(e).__name__}: {e}"

        return _sent(rows())

    return urls.select(column).mapInArrow(run, _PARSED)


def parse_extensions(listed: str) -> tuple[str, ...]:
    """A comma-separated list of suffixes, with or without their dot."""
    return tuple("." + x.strip().lower().lstrip(".") for x in listed.split(",") if x.strip())
