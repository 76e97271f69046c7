"""Weighted reciprocal rank fusion of a vector leg and a keyword leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keyword import best, bm25, bm25_postings, query_terms
from .vector import candidate_pool, nearest, within_cutoff

K = 60


def ranked(hits: DataFrame, name: str, *order) -> DataFrame:
    """hits with their 0-based rank; only ever at most a pool of rows, so one task ranks them."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*([] if "query_id" not in hits.columns else ["query_id"])).orderBy(*order)) - 1)


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, top_k: int, *, key: str = "chunk_id", vector_weight: float = 0.6, keyword_weight: float = 0.4) -> DataFrame:
    """key, score (6 places) and both ranks of the top_k. Rows of the keyword leg alone are let in below rank 2 * top_k.
    Legs with a query_id are fused query by query."""
    keys = ["query_id", key] if "query_id" in vector_hits.columns else [key]
    rv, rf = F.col("vector_rank"), F.col("keyword_rank")
    both = vector_hits.select(*keys, "vector_rank").join(keyword_hits.select(*keys, "keyword_rank"), keys, "full_outer")
    score = F.coalesce(vector_weight / (K + rv), F.lit(0.0)) + F.coalesce(keyword_weight / (K + rf), F.lit(0.0))
    own = both.filter(rv.isNotNull() | (rf < 2 * top_k)).withColumn("_rrf", score)
    order = [F.desc("_rrf"), rv.asc_nulls_last(), rf.asc_nulls_last(), F.col(key)]
    if len(keys) == 1:
        kept = own.orderBy(*order).limit(top_k)
    else:
        kept = own.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("_n") <= top_k)
    return kept.select(*keys, F.round("_rrf", 6).alias("score"), "vector_rank", "keyword_rank")


def search(
    chunks: DataFrame, query_vector: list[float], query_text: str, *, top_k: int = 5, only: DataFrame | None = None, key: str = "chunk_id", column: str = "embedding",
    metric: str = "l2", cutoff: float = 1.15, vector_weight: float = 0.6, keyword_weight: float = 0.4, keyword_mode: str = "terms", match: str = "any", stem: bool = False, n_chunks: int | None = None, vectors: DataFrame | None = None, index: tuple[DataFrame, int, float] | None = None,
) -> DataFrame:
    """Hybrid search over chunks (key, text, embedding; rows without a vector are met by keyword alone). Where vectors are
    kept in a table of their own (key, embedding), it is given as `vectors`, and neither leg reads the other's table.

    Where an inverted index is kept, it is given as `index` (postings, number of chunks, average length), and no text is read.

    The pool is sized by the whole store. `only` is applied before the vector ranking and after keyword scoring.
    Legs carry keys and ranks only; the caller joins text to the top_k."""
    n_chunks = index[1] if index is not None and n_chunks is None else n_chunks
    pool = candidate_pool(chunks.count() if n_chunks is None else n_chunks, top_k)
    with_vector = (chunks if vectors is None else vectors).filter(F.col(column).isNotNull())
    near = within_cutoff(nearest(with_vector, query_vector, pool, key=key, column=column, metric=metric, only=only), cutoff)
    words = query_terms(query_text, keyword_mode, stem)
    match = "all" if keyword_mode == "strict" else match
    scores = bm25(chunks, words, key=key, match=match, stem=stem) if index is None or stem else bm25_postings(index[0], words, index[1], index[2], key=key, match=match)
    found = best(scores, pool, key=key, only=only)
    return fuse(ranked(near, "vector_rank", "dist", key), ranked(found, "keyword_rank", F.desc("score"), key), top_k, key=key, vector_weight=vector_weight, keyword_weight=keyword_weight)
