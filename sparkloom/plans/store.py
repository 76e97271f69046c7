"""A store: documents, chunks and the inverted index of these as Parquet, in buckets by document, under numbered manifests.

All of it goes through Hadoop's file system, so the path may be on any that the executors share. A writer adds files for the
buckets it touches and then the next manifest; what other buckets hold is taken over as it is. Readers see the manifest they
began with. vacuum() deletes files that only older manifests name."""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..functions.models import HashedEmbedder, embed
from ..functions.text import bpe_chunks, document_id, front_matter, metadata_value, source_type, strip_front_matter, terms, title
from ..functions.text import chunks as chunk_texts
from ..operators.catalog import find_document, matches, migrate, upsert, without
from ..operators.keyword import _split

TABLES = ("documents", "chunks", "postings")


def postings_of(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, doc_id, tf, length of every term of every chunk, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for chunk, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = _split(text)
                out += [(t.decode("utf-8", "surrogatepass"), chunk, doc, n, len(own)) for t, n in Counter(own).items()]
            types = [pa.string()] * 3 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["term", "chunk_id", "doc_id", "tf", "length"])

    return chunks.select("chunk_id", "doc_id", "text").mapInArrow(run, "term string, chunk_id string, doc_id string, tf int, length int")


class Store:
    """buckets: how many parts an update is confined to one of; a store keeps the number that it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, str(path).rstrip("/")
        self._fs = self._p().getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p())
        self.buckets = self._manifest().get("buckets", buckets)

    def _p(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str = "") -> list[str]:
        p = self._p(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def version(self) -> int | None:
        """The number of the latest manifest."""
        return max((int(n[9:-5]) for n in self._names() if n.startswith("manifest-")), default=None)

    def _manifest(self) -> dict:
        v = self.version()
        if v is None:
            return {"files": {t: {} for t in TABLES}, "counts": {}}
        stream = self._fs.open(self._p(f"manifest-{v}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        files = self._manifest()["files"][name]
        paths = [f"{self.path}/{p}" for b, p in sorted(files.items()) if buckets is None or int(b) in buckets]
        schema = getattr(schemas, name.upper())
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        return migrate(self._table("documents"))

    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def index(self) -> tuple[DataFrame, int, float]:
        """(postings, number of chunks, their average number of terms): what keyword search reads instead of texts."""
        counts = self._manifest()["counts"].values()
        n, total = sum(c[0] for c in counts), sum(c[1] for c in counts)
        return self._table("postings"), n, total / n if n else 0.0

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _commit(self, touched: list[int], documents: DataFrame, chunks: DataFrame, postings: DataFrame) -> None:
        """Replaces what the touched buckets hold."""
        before, new = self.version(), self._manifest()
        new["buckets"] = self.buckets
        folder = f"data/{uuid.uuid4().hex}"
        for name, df, by in (("documents", documents, "id"), ("chunks", chunks, "doc_id"), ("postings", postings, "doc_id")):
            schema = getattr(schemas, name.upper())
            out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], self._bucket(by).alias("bucket"))
            if name == "postings":  # files hold their terms in order, so a search reads few row groups of each
                out = out.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("bucket", "term")
            else:
                out = out.repartition("bucket", F.pmod(F.xxhash64(by), F.lit(1009)))
            out.write.partitionBy("bucket").parquet(f"{self.path}/{folder}/{name}")
            for b in touched:
                new["files"][name].pop(str(b), None)
            new["files"][name] |= {n[7:]: f"{folder}/{name}/{n}" for n in self._names(f"{folder}/{name}") if n.startswith("bucket=")}
        for b in touched:
            new["counts"].pop(str(b), None)
        mine = [f"{self.path}/{p}" for p in new["files"]["chunks"].values() if p.startswith(folder)]
        if mine:
            rows = self.spark.read.schema(schemas.CHUNKS).parquet(*mine).groupBy(self._bucket("doc_id").alias("b")).agg(F.count("*").alias("n"), F.sum("n_terms").alias("t")).collect()  # a row a bucket
            new["counts"] |= {str(r.b): [r.n, r.t] for r in rows}
        draft, final = self._p(f"draft-{uuid.uuid4().hex}"), self._p(f"manifest-{(before or 0) + 1}.json")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError("another writer was faster: run this again")

    def add(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Replaces the documents with these ids, with their chunks and postings; only their buckets are written."""
        touched = [r.b for r in documents.select(self._bucket("id").alias("b")).distinct().collect()]  # at most `buckets`
        ids = documents.select("id").distinct()
        old = [without(self._table(t, touched).withColumnRenamed("doc_id", "id"), ids, "id").withColumnRenamed("id", "doc_id") for t in ("chunks", "postings")]
        counted = chunks.withColumn("n_terms", F.size(terms("text")))
        self._commit(touched, upsert(self._table("documents", touched), documents), old[0].unionByName(counted), old[1].unionByName(postings_of(chunks)))

    def delete(self, path: str, collection: str | None = None) -> bool:
        """Deletes the document of this path in every collection (or one); whether there was any."""
        gone = self.documents().filter((F.col("path") == path) & matches(collection=collection)).select("id")
        touched = [r.b for r in gone.select(self._bucket("id").alias("b")).distinct().collect()]
        if not touched:
            return False
        by_doc = [without(self._table(t, touched).withColumnRenamed("doc_id", "id"), gone, "id").withColumnRenamed("id", "doc_id") for t in ("chunks", "postings")]
        self._commit(touched, without(self._table("documents", touched), gone, "id"), *by_doc)
        return True

    def forget(self, query: str, collection: str | None = None, fuzzy: bool = True) -> str | None:
        """Deletes by exact path, else (with fuzzy) the newest document that query is found in; its path, or None."""
        if self.delete(query, collection):
            return query
        found = find_document(self.documents(), query, collection=collection).first() if fuzzy else None
        if found is None:
            return None
        self.delete(found.path)
        return found.path

    def exists(self, path: str) -> bool:
        return not self.documents().filter(F.col("path") == path).limit(1).isEmpty()

    def size_mb(self) -> float:
        paths = [p for files in self._manifest()["files"].values() for p in files.values()]
        return round(sum(self._fs.getContentSummary(self._p(p)).getLength() for p in paths) / 1024**2, 2)

    def vacuum(self) -> int:
        """Deletes the files that the latest manifest doesn't name, and older manifests: the number of folders deleted. Readers
        of an older version must be done by then."""
        v, kept, n = self.version(), {p for files in self._manifest()["files"].values() for p in files.values()}, 0
        for run in self._names("data"):
            own = [f"data/{run}/{t}/{b}" for t in self._names(f"data/{run}") for b in self._names(f"data/{run}/{t}") if b.startswith("bucket=")]
            gone = [p for p in own if p not in kept]
            n += len(gone)
            for p in [f"data/{run}"] if len(gone) == len(own) else gone:
                self._fs.delete(self._p(p), True)
        for name in self._names():
            if name.startswith("draft-") or (name.startswith("manifest-") and int(name[9:-5]) != v):
                self._fs.delete(self._p(name), True)
        return n

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """df written below the store and read back, and the path to drop()."""
        path = f"{self.path}/tmp/{time.time_ns()}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs.delete(p, True)


def prepare(parsed: DataFrame, settings: Settings, embedder, *, collection: str = "default", project: str | None = None, layer: str | None = None, tags: str | None = None, added_at=None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of parsed rows (path, text): front matter read and cut off, windows cut, vectors attached."""
    c = settings.chunking
    text = strip_front_matter("text")
    windows = bpe_chunks(text, c.size, c.overlap, c.tokenizer) if c.tokenizer else chunk_texts(text, c.size, c.overlap)
    given = {"project": project, "layer": layer, "tags": tags}
    meta = F.col("_meta")
    own = parsed.withColumn("_meta", front_matter("text")).select(
        document_id(F.lit(collection), "path").alias("id"), "path", title("path").alias("title"), source_type("path").alias("source_type"), F.lit(collection).alias("collection"),
        *[metadata_value(F.lit(v), meta[k]).alias(k) for k, v in given.items()], windows.alias("texts"),
    )
    chars = F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.length(t))
    documents = own.filter(F.size("texts") > 0).select("id", "path", "title", "source_type", "collection", "project", "layer", "tags", chars.alias("char_count"), F.size("texts").alias("chunk_count"), (F.current_timestamp() if added_at is None else F.lit(added_at)).alias("added_at"))
    each = own.select(F.col("id").alias("doc_id"), F.posexplode("texts").alias("seq", "text"))
    chunks = each.select(F.concat_ws(":", "doc_id", F.col("seq").cast("string")).alias("chunk_id"), "doc_id", "seq", "text", embed("text", embedder).alias("embedding"))
    return documents, chunks


def ingest(store: Store, parsed: DataFrame, settings: Settings = Settings(), embedder=None, *, force: bool = False, path_only: bool = False, collection: str = "default", **given) -> DataFrame:
    """Adds parsed rows (path, text, error) and returns a status row for each: ok, empty, error or skipped.
    Known documents are those of the same collection and path, or with path_only of the path in any collection."""
    embedder = embedder or HashedEmbedder()
    # read and parsed once, whatever is asked of it below; of several texts of a path the longest that could be read counts
    rows = parsed if "error" in parsed.columns else parsed.withColumn("error", F.lit(None).cast("string"))
    best = F.max(F.struct(F.col("error").isNull().alias("ok"), F.length("text").alias("n"), "text", "error"))
    rows, kept = store.keep(rows.groupBy("path").agg(best.alias("b")).select("path", "b.text", "b.error"))
    known = store.documents().select("path", "collection").filter(F.lit(True) if path_only else F.col("collection") == collection).select("path").distinct()
    rows = rows.join(known.withColumn("_known", F.lit(True)), "path", "left")
    status = F.when(F.lit(not force) & F.col("_known").isNotNull(), "skipped").when(F.col("error").isNotNull(), "error").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty")
    rows = rows.withColumn("status", status).drop("_known")
    rows, labelled = store.keep(rows)
    documents, chunks = prepare(rows.filter(F.col("status").isNull()), settings, embedder, collection=collection, **given)
    chunks, cut = store.keep(chunks)  # vectors are made once
    store.add(documents, chunks)
    added = store.documents().select("path", "collection", "id", "title", "chunk_count").filter(F.col("collection") == collection).drop("collection")
    out = rows.select(F.col("path").alias("source"), "status", "error", F.length("text").cast("long").alias("chars")).join(added.withColumnRenamed("path", "source"), "source", "left")
    new = F.col("status").isNull()
    label = F.coalesce("status", F.when(F.col("id").isNull(), "empty").otherwise("ok"))
    spark = store.spark
    done = out.select(label.alias("status"), "source", F.when(new, F.col("id")).alias("doc_id"), F.when(new, F.col("title")).alias("title"), F.when(new, F.coalesce("chunk_count", F.lit(0))).otherwise(0).alias("chunks"), F.coalesce("chars", F.lit(0)).alias("chars"), "error")
    schema, listed = done.schema, [tuple(r) for r in done.collect()]  # a status row a source, as the caller gets them
    for path in (kept, labelled, cut):
        store.drop(path)
    return spark.createDataFrame(listed, schema)


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def paired(texts: Column | str, vectors: Column | str) -> Column:
    """An array of (text, embedding) of two arrays; unequal lengths are an error, not cut to the shorter."""
    t, v = (F.col(c) if isinstance(c, str) else c for c in (texts, vectors))
    bad = F.raise_error(F.concat(F.size(t).cast("string"), F.lit(" texts and "), F.size(v).cast("string"), F.lit(" vectors")))
    return F.when(F.size(t) == F.size(v), F.zip_with(t, v, lambda a, b: F.struct(a.alias("text"), b.alias("embedding")))).otherwise(bad)


def as_json(rows) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2, default=str)
