"""The retrieval operators over the driver's tables, each with the SQL that gives the same rows.

documents stand for a store: path doc://<doc_id>, collection = source, project = lang, layer = labels.quality; embeddings
join by vec_id = doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.stem import stemmed
from .operators import catalog
from .operators.fusion import fuse, ranked, search
from .operators.keyword import best, bm25, bm25_batch, bm25_postings, postings, query_terms, term_statistics
from .operators.vector import candidate_pool, nearest, nearest_batch, within_cutoff
from .plans.prompt import SYSTEM, context_blocks, messages_column, prompt_column
from .streaming.watch import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """documents; a table of less than 256 MB, whose file may be one row group, is spread over the cores."""
    docs = _t(spark, d, "documents")
    small = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 28
    return docs.repartition(spark.sparkContext.defaultParallelism) if small else docs


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", "embedding")


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    row = _t(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        raise ValueError(f"no vector {vec_id}")
    return row.embedding


def _store(spark: SparkSession, d: str) -> DataFrame:
    """documents as a store would hold them; the time of adding is made of the id."""
    docs = _texts(spark, d)
    layer = _t(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("layer"))
    path = F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))
    own = docs.join(layer, "doc_id", "left").select("doc_id", path.alias("path"), F.col("source").alias("collection"), F.col("lang").alias("project"), "layer", "text")
    return own.select(T.document_id("collection", "path").alias("id"), "path", T.title("path").alias("title"), "collection", "project", "layer", (F.lit(1_700_000_000) + F.col("doc_id") % 97).alias("added_at"), "doc_id", "text")


_STORE = """store AS (
  SELECT substr(sha256(d.source || ':doc://' || d.doc_id), 1, 32) AS id, 'doc://' || d.doc_id AS path, d.source AS collection, d.lang AS project, l.layer, 1700000000 + d.doc_id % 97 AS added_at, d.doc_id, d.text
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality)::VARCHAR AS layer FROM labels GROUP BY doc_id) l USING (doc_id)
)"""
_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOW + r", '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"


@_query(f"SELECT e.vec_id, round({_L2}, 9) AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_L2}, e.vec_id LIMIT 10")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return nearest(_vectors(spark, d), _vector(spark, d, 7), 10, key="vec_id").withColumn("dist", F.round("dist", 9))


@_query("SELECT e.vec_id, round(1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 8) AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q ORDER BY dist, e.vec_id LIMIT 10")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    hits = nearest(_vectors(spark, d), _vector(spark, d, 11), 10, key="vec_id", metric="cosine")
    return hits.withColumn("dist", F.round("dist", 8))


@_query(f"SELECT e.vec_id, round({_L2}, 9) AS dist FROM embeddings e SEMI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') s ON s.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY {_L2}, e.vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    only = _texts(spark, d).filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return nearest(_vectors(spark, d), _vector(spark, d, 3), 10, key="vec_id", only=only).withColumn("dist", F.round("dist", 9))


@_query(f"""WITH p AS (SELECT e.vec_id, {_L2} AS dist FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY dist, e.vec_id LIMIT 50)
SELECT vec_id, round(dist, 9) AS dist FROM p WHERE dist <= 1.15 * (SELECT min(dist) FROM p)""")
def knn_cutoff(spark: SparkSession, d: str) -> DataFrame:
    others = _vectors(spark, d).filter("vec_id <> 7")  # the query's own vector would be at distance 0
    return within_cutoff(nearest(others, _vector(spark, d, 7), 50, key="vec_id")).withColumn("dist", F.round("dist", 9))


@_query("SELECT k AS top_k, n AS n_chunks, least(10 * k, greatest(3 * k, n // 3)) AS pool FROM (SELECT count(*) AS n FROM documents), (SELECT unnest([1, 5, 10, 1000])::BIGINT AS k)")
def candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    n = _texts(spark, d).count()
    return spark.createDataFrame([(k, n, candidate_pool(n, k)) for k in (1, 5, 10, 1000)], "top_k long, n_chunks long, pool long")


@_query(f"SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct, t[1] AS first_term FROM (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    own = _texts(spark, d).select("doc_id", T.terms("text").alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first_term"))


@_query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return term_statistics(_texts(spark, d))


def _bm25_sql(words: list[str], match: str = "any") -> str:
    """Scores by chunk; the last step is named bm."""
    listed = ", ".join(f"('{w}')" for w in words)
    need = len(words) if match == "all" else 1
    return f"""tok AS (SELECT doc_id AS chunk_id, {_TERMS.format('text')} AS t FROM documents),
len AS (SELECT chunk_id, len(t) AS length FROM tok), stat AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM len),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) SEMI JOIN (VALUES {listed}) w(term) USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT chunk_id, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) AS score
  FROM tf JOIN df USING (term) JOIN len USING (chunk_id), stat GROUP BY chunk_id HAVING count(*) >= {need})"""


_WORDS = ["ing", "tion", "pathetic"]


@_query(f"WITH {_bm25_sql(_WORDS)} SELECT chunk_id, round(score, 9) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT 20")
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    chunks = _texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return best(bm25(chunks, query_terms("ing tion, pathetic?")), 20).withColumn("score", F.round("score", 9))


@_query(f"WITH {_bm25_sql(['und', 'der'], 'all')} SELECT chunk_id, round(score, 9) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT 20")
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    chunks = _texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return best(bm25(chunks, query_terms("und der", "strict"), match="all"), 20).withColumn("score", F.round("score", 9))


@_query(f"WITH {_bm25_sql(_WORDS)} SELECT chunk_id, round(score, 9) AS score FROM bm SEMI JOIN (SELECT doc_id FROM documents WHERE source = 'src3') s ON s.doc_id = chunk_id ORDER BY bm.score DESC, chunk_id LIMIT 20")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).withColumnRenamed("doc_id", "chunk_id")
    return best(bm25(docs.select("chunk_id", "text"), _WORDS), 20, only=docs.filter("source = 'src3'")).withColumn("score", F.round("score", 9))


@_query()
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    chunks = _texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    return best(bm25(chunks, query_terms("disgusting losers", stem=True), stem=True), 20).withColumn("score", F.round("score", 9))


def _rrf_sql(vec_id: int, words: list[str], top_k: int, where: str = "true") -> str:
    return f"""WITH pool AS (SELECT least(10 * {top_k}, greatest(3 * {top_k}, count(*) // 3)) AS p FROM documents),
allowed AS (SELECT doc_id FROM documents WHERE {where}),
vp AS (SELECT e.vec_id AS chunk_id, {_L2} AS dist FROM embeddings e JOIN allowed ON allowed.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = {vec_id}) q WHERE e.vec_id <> {vec_id} ORDER BY dist, chunk_id LIMIT (SELECT p FROM pool)),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY dist, chunk_id) - 1 AS rv FROM vp WHERE (SELECT min(dist) FROM vp) <= 0 OR dist <= 1.15 * (SELECT min(dist) FROM vp)),
{_bm25_sql(words)},
fp AS (SELECT chunk_id, score FROM bm SEMI JOIN allowed ON allowed.doc_id = bm.chunk_id ORDER BY score DESC, chunk_id LIMIT (SELECT p FROM pool)),
f AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS rf FROM fp)
SELECT chunk_id, round(coalesce(0.6::DOUBLE / (60 + rv), 0) + coalesce(0.4::DOUBLE / (60 + rf), 0), 6) AS score, coalesce(rv, -1) AS vector_rank, coalesce(rf, -1) AS keyword_rank
FROM v FULL JOIN f USING (chunk_id) WHERE rv IS NOT NULL OR rf < 2 * {top_k}
ORDER BY coalesce(0.6::DOUBLE / (60 + rv), 0) + coalesce(0.4::DOUBLE / (60 + rf), 0) DESC, rv NULLS LAST, rf NULLS LAST, chunk_id LIMIT {top_k}"""


def _ranks() -> list:
    """Both ranks, -1 where a leg lacks the chunk."""
    return [F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in ("vector_rank", "keyword_rank")]


def _rrf(spark: SparkSession, d: str, vec_id: int, text: str, top_k: int, only: DataFrame | None = None) -> DataFrame:
    chunks = _texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = _vectors(spark, d).withColumnRenamed("vec_id", "chunk_id").filter(F.col("chunk_id") != vec_id).join(_t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    n = _t(spark, d, "documents").count()
    hits = search(chunks, _vector(spark, d, vec_id), text, top_k=top_k, only=only, vectors=vectors, n_chunks=n)
    return hits.select("chunk_id", "score", *_ranks())


@_query(_rrf_sql(7, _WORDS, 10))
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _rrf(spark, d, 7, "ing tion pathetic", 10)


@_query(_rrf_sql(19, _WORDS, 10, "lang = 'en' AND source = 'src1'"))
def rrf_hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    only = _texts(spark, d).filter("lang = 'en' and source = 'src1'").select(F.col("doc_id").alias("chunk_id"))
    return _rrf(spark, d, 19, "ing tion pathetic", 10, only)


@_query(f"""WITH asked AS (SELECT b.item_id AS query_id, e.embedding, {_TERMS.format('b.text')} AS t FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
pool AS (SELECT least(100, greatest(30, count(*) // 3)) AS p FROM documents),
vd AS (SELECT q.query_id, e.vec_id AS chunk_id, {_L2} AS dist FROM embeddings e, asked q WHERE e.vec_id <> q.query_id),
vp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS n FROM vd QUALIFY n <= (SELECT p FROM pool)),
v AS (SELECT query_id, chunk_id, n - 1 AS rv FROM vp WHERE dist <= 1.15 * (SELECT min(dist) FROM vp b WHERE b.query_id = vp.query_id)),
qt AS (SELECT DISTINCT query_id, unnest(t) AS term FROM asked),
tok AS (SELECT doc_id AS chunk_id, {_TERMS.format('text')} AS t FROM documents), len AS (SELECT chunk_id, len(t) AS length FROM tok), stat AS (SELECT count(*)::DOUBLE AS n, avg(length) AS average FROM len),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) SEMI JOIN qt USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, chunk_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (chunk_id), stat GROUP BY ALL),
f AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rf FROM bm QUALIFY rf < (SELECT p FROM pool)),
r AS (SELECT query_id, chunk_id, rv, rf, coalesce(0.6::DOUBLE / (60 + rv), 0) + coalesce(0.4::DOUBLE / (60 + rf), 0) AS rrf FROM v FULL JOIN f USING (query_id, chunk_id) WHERE rv IS NOT NULL OR rf < 20)
SELECT query_id, chunk_id, round(rrf, 6) AS score, coalesce(rv, -1) AS vector_rank, coalesce(rf, -1) AS keyword_rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rv NULLS LAST, rf NULLS LAST, chunk_id) <= 10""")
def rrf_batch(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark items as a batch of queries, each with the vector of its number."""
    vectors, top_k = _vectors(spark, d), 10
    chunks = _texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text")
    asked = _t(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("vector"))
    pool = candidate_pool(chunks.count(), top_k)
    near = nearest_batch(vectors.withColumnRenamed("vec_id", "chunk_id"), asked, pool + 1).filter("chunk_id <> query_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "chunk_id"))).filter(F.col("rank") <= pool)
    near = within_cutoff(near).withColumn("vector_rank", F.col("rank") - 1)
    found = bm25_batch(chunks, asked, pool).withColumn("keyword_rank", F.col("rank") - 1)
    return fuse(near, found, top_k).select("query_id", "chunk_id", "score", *_ranks())


_CHUNKED = r"""tk AS (SELECT doc_id, regexp_extract_all(text, '[ \t\n\r]*[^ \t\n\r]+') AS t FROM documents),
wi AS (SELECT doc_id, t, unnest(range(0, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 200 THEN 1 ELSE 1 + ceil((len(t) - 200) / 160.0)::INT END)) AS i FROM tk),
raw AS (SELECT doc_id, i, regexp_replace(array_to_string(t[i * 160 + 1 : i * 160 + 200], ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS chunk FROM wi),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, chunk FROM raw WHERE length(chunk) > 20)"""


@_query(f"WITH {_CHUNKED} SELECT doc_id, seq, length(chunk) AS n_chars, md5(chunk) AS digest FROM ch")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    each = _texts(spark, d).select("doc_id", F.posexplode(T.chunks("text", 200, 40)).alias("seq", "chunk"))
    return each.select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


@_query(f"WITH {_CHUNKED} SELECT d.source AS collection, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars, max(length(chunk)) AS longest, count(DISTINCT ch.doc_id) AS documents FROM ch JOIN documents d USING (doc_id) GROUP BY d.source")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    each = _texts(spark, d).select(F.col("source").alias("collection"), "doc_id", F.explode(T.chunks("text", 200, 40)).alias("chunk"))
    n = F.length("chunk").cast("long")
    return each.groupBy("collection").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.max(n).alias("longest"), F.count_distinct("doc_id").alias("documents"))


@_query("SELECT doc_id, substr(sha256(source || ':doc://' || doc_id), 1, 32) AS id FROM documents")
def doc_ids(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", T.document_id("source", F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))).alias("id"))


_KINDS = ["/a/report.PDF", "/a/b.docx", "/x/main.py", "/x/app.js", "/n/notes.md", "/n/n.txt", "/w/i.html", "/w/data.csv", "/w/none", "HTTPS://e.org/a.pdf"]


@_query(r"""WITH p AS (SELECT url AS path FROM pages UNION ALL SELECT path FROM (VALUES """ + ", ".join(f"('{k}')" for k in _KINDS) + r""") v(path))
SELECT path, regexp_matches(path, '^(?i)https?:') AS is_url, CASE WHEN regexp_matches(path, '^(?i)https?:') THEN 'url' ELSE coalesce(map {'.pdf': 'pdf', '.docx': 'docx', '.pptx': 'pptx', '.xlsx': 'xlsx', '.md': 'markdown', '.txt': 'text', '.py': 'code', '.js': 'code', '.ts': 'code', '.go': 'code', '.rs': 'code', '.java': 'code', '.html': 'html', '.htm': 'html'}[lower(regexp_extract(path, '(\.[^./]+)$', 1))], 'file') END AS kind FROM p""")
def source_types(spark: SparkSession, d: str) -> DataFrame:
    paths = _t(spark, d, "pages").select(F.col("url").alias("path")).unionByName(spark.createDataFrame([(k,) for k in _KINDS], "path string"))
    return paths.select("path", T.is_url("path").alias("is_url"), T.source_type("path").alias("kind"))


@_query(f"WITH {_STORE} SELECT id, path, collection, project, layer, added_at FROM store WHERE collection = 'src3' AND layer = '1' ORDER BY added_at DESC, id")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_documents(_store(spark, d), collection="src3", layer="1").select("id", "path", "collection", "project", "layer", "added_at")


@_query("SELECT DISTINCT source AS collection FROM documents ORDER BY 1")
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    return catalog.collections(_store(spark, d))


@_query(f"WITH {_CHUNKED} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS collections, (SELECT count(*) FROM ch) AS chunks")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.store_stats(_store(spark, d), _texts(spark, d).select(F.explode(T.chunks("text", 200, 40)).alias("chunk")))


@_query(f"WITH {_STORE} SELECT id, path FROM store WHERE contains(lower(path), 'oc://19') AND project = 'en' ORDER BY added_at DESC, id LIMIT 1")
def find_document(spark: SparkSession, d: str) -> DataFrame:
    return catalog.find_document(_store(spark, d), "OC://19", project="en").select("id", "path")


@_query(f"WITH {_bm25_sql(_WORDS)}, h AS (SELECT d.source AS path, chunk_id, round(score, 9) AS score FROM bm JOIN documents d ON d.doc_id = chunk_id) SELECT path, chunk_id, score FROM h QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_id) = 1")
def dedupe_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), "text")
    hits = bm25(docs.select("chunk_id", "text"), _WORDS).withColumn("score", F.round("score", 9)).join(docs.select("chunk_id", "path"), "chunk_id")
    return catalog.first_per_path(hits, F.desc("score"), "chunk_id").select("path", "chunk_id", "score")


@_query(f"WITH {_STORE}, new AS (SELECT id, path, collection, 'v2' AS version FROM store JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY ALL) SELECT id, path, collection, 'v1' AS version FROM store ANTI JOIN new USING (id) UNION ALL SELECT id, path, collection, version FROM new")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    new = store.filter("layer = '1'").select("id", "path", "collection", F.lit("v2").alias("version"))
    return catalog.upsert(store.select("id", "path", "collection", F.lit("v1").alias("version")), new)


@_query(f"WITH {_STORE} SELECT id, path FROM store ANTI JOIN (SELECT id FROM store WHERE collection = 'src2') g USING (id)")
def delete_anti(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    return catalog.without(store, store.filter("collection = 'src2'"), "id").select("id", "path")


@_query("SELECT p.url AS path, CASE WHEN k.url IS NULL THEN 'new' ELSE 'skipped' END AS status FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN (SELECT DISTINCT url FROM pages WHERE contains(url, '.org')) k USING (url)")
def skip_existing(spark: SparkSession, d: str) -> DataFrame:
    incoming = _t(spark, d, "pages").select(F.col("url").alias("path")).distinct()
    known = incoming.filter(F.contains("path", F.lit(".org")))
    skipped = incoming.join(known, "path", "left_semi").withColumn("status", F.lit("skipped"))
    return skipped.unionByName(incoming.join(known, "path", "left_anti").withColumn("status", F.lit("new")))


_GREP = ["Pathetic", "license", "RESERVED", "example.com"]


@_query(f"SELECT doc_id, array_to_string(w, ',') AS words FROM (SELECT doc_id, list_filter([{', '.join(f'''CASE WHEN contains({_LOW.format('text')}, '{w.lower()}') THEN '{w}' END''' for w in _GREP)}], lambda x: x IS NOT NULL) AS w FROM documents) WHERE len(w) > 0")
def keyword_baseline(spark: SparkSession, d: str) -> DataFrame:
    return catalog.term_matches(_texts(spark, d), _GREP, key="doc_id").select("doc_id", F.array_join("words", ",").alias("words"))


@_query(f"SELECT vec_id AS doc_id FROM (SELECT e.vec_id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_L2}, e.vec_id LIMIT 50) EXCEPT SELECT doc_id FROM documents WHERE contains({_LOW.format('text')}, 'pathetic')")
def semantic_only_except(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(_vectors(spark, d), _vector(spark, d, 7), 50, key="vec_id").select(F.col("vec_id").alias("doc_id"))
    return near.subtract(catalog.term_matches(_texts(spark, d), ["pathetic"], key="doc_id").select("doc_id"))


@_query(f"WITH {_CHUNKED} SELECT doc_id, string_agg('--- Context ' || (seq + 1) || ' [doc ' || doc_id || '] ---' || chr(10) || chunk, chr(10) || chr(10) ORDER BY seq) || chr(10) || chr(10) || 'Question: what?' AS prompt FROM ch GROUP BY doc_id")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    each = _texts(spark, d).select("doc_id", F.posexplode(T.chunks("text", 200, 40)).alias("seq", "text"))
    hits = each.select("doc_id", (F.col("seq") + 1).alias("rank"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "text")
    return context_blocks(hits, "doc_id").select("doc_id", prompt_column(F.col("prompt"), F.lit("what?")).alias("prompt"))


@_query(f"SELECT conv_id, '[system] {SYSTEM}' || chr(10) || string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) || chr(10) || '[user] and then?' AS messages, count(*) + 2 AS n FROM conversations GROUP BY conv_id")
def chat_history(spark: SparkSession, d: str) -> DataFrame:
    said = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    history = F.transform("h", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    m = messages_column(F.lit("and then?"), history)
    line = F.transform("m", lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["content"]))
    return said.select("conv_id", m.alias("m")).select("conv_id", F.array_join(line, "\n").alias("messages"), F.size("m").cast("long").alias("n"))


def _fronted():
    return F.concat(F.lit("---\nproject: "), F.col("lang"), F.lit("\n# remark\ntags: [a, 'b c']\nlayer: \""), F.col("source"), F.lit("\"\nproject: last\n---\n"), F.col("text"))


_FRONT_SQL = "'---' || chr(10) || 'project: ' || lang || chr(10) || '# remark' || chr(10) || 'tags: [a, ''b c'']' || chr(10) || 'layer: \"' || source || '\"' || chr(10) || 'project: last' || chr(10) || '---' || chr(10)"


@_query("SELECT doc_id, 'last' AS project, source AS layer, 'a,b c' AS tags FROM documents")
def frontmatter_fallback(spark: SparkSession, d: str) -> DataFrame:
    own = _texts(spark, d).select("doc_id", T.front_matter_map(_fronted()).alias("m"))
    return own.select("doc_id", *[T.metadata_value(F.lit(""), F.col("m")[k]).alias(k) for k in ("project", "layer", "tags")])


@_query("SELECT doc_id, md5(text) AS plain, md5(text) AS crlf, md5(' ' || text) AS without FROM documents")
def strip_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """The block goes with line ends of either kind and with blanks before it; a text that has none stays as it is."""
    crlf = F.concat(F.lit(" \r\n"), F.replace(F.concat(F.substring_index(_fronted(), "\n---\n", 1), F.lit("\n---\n")), F.lit("\n"), F.lit("\r\n")), F.col("text"))
    digest = lambda c: F.md5(T.strip_front_matter(c))
    return _texts(spark, d).select("doc_id", digest(_fronted()).alias("plain"), digest(crlf).alias("crlf"), digest(F.concat(F.lit(" "), "text")).alias("without"))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS fire_us, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = sessions(_t(spark, d, "events"), "user_id", "30 minutes")
    return own.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("fire_at").alias("fire_us"), "n")


@_query("SELECT doc_id, lang || ',' || source AS tags FROM documents WHERE source = 'src1'")
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whole tags: src1 doesn't find src10."""
    tagged = _texts(spark, d).select("doc_id", F.concat_ws(",", "lang", "source").alias("tags"))
    return tagged.filter(catalog.matches(tags="src1"))


@_query("SELECT doc_id, lang || ',' || source AS tags FROM documents WHERE contains(lang || ',' || source, 'src1')")
def tag_filter_substring(spark: SparkSession, d: str) -> DataFrame:
    tagged = _texts(spark, d).select("doc_id", F.concat_ws(",", "lang", "source").alias("tags"))
    return tagged.filter(catalog.matches(tags="SRC1", tag_mode="substring"))


@_query(r"SELECT doc_id, substr(text, 1, 120) || '...' AS snippet, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n_words, md5(regexp_replace(regexp_replace(chr(10) || text || repeat(chr(10), 4) || text || ' ', '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')) AS normalized FROM documents")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d)
    padded = F.concat(F.lit("\n"), "text", F.lit("\n\n\n\n"), "text", F.lit(" "))
    return docs.select("doc_id", T.snippet("text").alias("snippet"), T.word_count("text").cast("long").alias("n_words"), F.md5(T.normalize_whitespace(padded)).alias("normalized"))


@_query("SELECT vec_id, round(sqrt(list_sum(list_transform(list_transform(embedding, lambda x: x::DOUBLE * 3), lambda x: x * x))) / 3, 6) AS norm, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS first FROM embeddings")
def normalized_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = _vectors(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) / 3
    return own.select("vec_id", F.round(norm, 6).alias("norm"), F.round(T.l2_normalized("v")[0], 6).alias("first"))


@_query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN length(text) <= 20 THEN 'empty' WHEN source = 'src2' THEN 'skipped' ELSE 'ok' END AS status FROM documents) GROUP BY status")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    from .plans.store import status_counts

    status = F.when(F.length("text") <= 20, "empty").when(F.col("source") == "src2", "skipped").otherwise("ok")
    return status_counts(_texts(spark, d).select(status.alias("status")))


@_query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_extract(regexp_extract(url, '^https?://(.*)$', 1), '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1'), '[_-]', ' ', 'g')), '[\p{L}]+|[^\p{L}]+'), lambda w: upper(w[1]) || w[2:]), '') AS title FROM pages""")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", T.title(F.regexp_extract("url", "^https?://(.*)$", 1)).alias("title"))


@_query()
def web_pages(spark: SparkSession, d: str) -> DataFrame:
    from .sources.files import html_pages

    return html_pages(_t(spark, d, "pages"))


_STEMS = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "sky": "sky"}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in _STEMS.items()) + ") v(word, stem)")
def porter_stems(spark: SparkSession, d: str) -> DataFrame:
    """The examples of the published rules."""
    words = spark.createDataFrame([(w,) for w in _STEMS], "word string")
    return words.select("word", stemmed(F.array("word"))[0].alias("stem"))


@_query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def date_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy(T.date_prefix("ts").alias("day")).agg(F.count("*").alias("n"))


@_query(f"WITH {_bm25_sql(_WORDS)} SELECT DISTINCT d.lang || ' ' || d.source AS title FROM bm JOIN documents d ON d.doc_id = chunk_id")
def distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("title"), "text")
    return catalog.titles(bm25(docs.select("chunk_id", "text"), _WORDS).join(docs.select("chunk_id", "title"), "chunk_id"))


@_query(f"WITH {_bm25_sql(_WORDS)} SELECT chunk_id, round(score, 9) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT 20")
def bm25_from_index(spark: SparkSession, d: str) -> DataFrame:
    """The same top 20 from an inverted index as a store keeps it."""
    index, lengths = postings(_texts(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    found = bm25_postings(index.join(lengths, "chunk_id"), _WORDS, stats.n, stats.average)
    return best(found, 20).withColumn("score", F.round("score", 9))


@_query()
def stemmed_terms(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.array_join(stemmed(T.terms("text")), " ").alias("stems"))


@_query()
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    from .functions.models import HashedEmbedder, embed

    each = _texts(spark, d).select("doc_id", F.posexplode(T.chunks("text", 200, 40)).alias("seq", "text"))
    return each.select("doc_id", "seq", embed("text", HashedEmbedder()).alias("embedding"))
