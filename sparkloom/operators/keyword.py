"""BM25 keyword search."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import porter, stemmed
from ..functions.text import terms

K1, B = 1.2, 0.75
_TERM = re.compile("[a-z0-9\x80-\U0010ffff]+")


def query_terms(text: str, mode: str = "terms", stem: bool = False) -> list[str]:
    """Distinct terms of a query in order. strict: none at all if the text has any other character than ASCII letters,
    digits, _, non-ASCII and white space, as a query grammar would reject it; terms: what remains is searched."""
    if mode not in ("terms", "strict"):
        raise ValueError(f"unknown keyword mode {mode!r}")
    if mode == "strict" and re.search(r"[^A-Za-z0-9_\s\x80-\U0010ffff]", text):
        return []
    found = _TERM.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return list(dict.fromkeys(porter(t) for t in found) if stem else dict.fromkeys(found))


def postings(chunks: DataFrame, *, key: str = "chunk_id", stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """(term, key, tf) and (key, length): the inverted index, to be written once and read by every search."""
    own = terms("text")
    tokens = chunks.select(key, (stemmed(own) if stem else own).alias("t"))
    index = tokens.select(key, F.explode("t").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return index, tokens.select(key, F.size("t").alias("length"))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """term, df, cf of every term, in one shuffle of partial sums by term: a row's terms are sorted, and the first of equal ones counts for df."""

    def marked(t: Column) -> Column:
        return F.transform(t, lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (F.get(t, i - 1) != x), 1).otherwise(0).alias("new")))

    each = chunks.select(F.inline(F.flatten(F.transform(F.array(F.sort_array(terms("text"))), marked))))  # transform binds the sorted terms
    return each.groupBy("term").agg(F.sum("new").cast("long").alias("df"), F.count("*").alias("cf"))


def _weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _split(text: str | None) -> list[bytes]:
    """The terms of a text, as terms() gives them, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _statistics(chunks: DataFrame, words: list[bytes], stem: bool = False) -> tuple[int, float, list[int]]:
    """Number of chunks, their average length in terms, and in how many each word is. A task sends one row for each of the words it has seen."""
    ids = {w: i for i, w in enumerate(words)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(ids), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = _split(text)
                n, total = n + 1, total + len(own)
                df[list({i for t in set(own) if (i := ids.get(_stem(t) if stem else t)) is not None})] += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, [-1, -2])), pa.array(np.append(df[hit], [n, total]))], names=["i", "n"])

    sums = {r.i: r.n for r in chunks.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n, total = sums.get(-1, 0), sums.get(-2, 0)
    return n, (total / n if n and total else 1.0), [sums.get(i, 0) for i in range(len(words))]


def _stem(t: bytes) -> bytes:
    return porter(t.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")


def bm25(chunks: DataFrame, words: list[str], *, key: str = "chunk_id", match: str = "any", stem: bool = False) -> DataFrame:
    """key, score of every chunk that holds any (or with match="all" every) word. Statistics are over all chunks given.
    Texts are scanned twice, for statistics and for scores, split as bytes in Arrow batches (four times the speed of a regular
    expression in the plan), and nothing of them is shuffled; where an index is kept, bm25_postings reads that instead."""
    if not words:
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    n, average, df = _statistics(chunks, encoded, stem)
    weight, need = {w: _idf(n, d) for w, d in zip(encoded, df)}, len(words) if match == "all" else 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, scores = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = _split(text)
                if stem:
                    own = [_stem(t) for t in own]
                tf = [(w, c) for w in weight if (c := own.count(w))]
                if len(tf) >= need:
                    at.append(i)
                    scores.append(sum(weight[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(own) / average)) for w, c in tf))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(scores, pa.float64())], names=[key, "score"])

    return chunks.select(key, "text").mapInArrow(score, f"{key} {chunks.schema[key].dataType.simpleString()}, score double")


def bm25_postings(index: DataFrame, words: list[str], n: int, average: float, *, key: str = "chunk_id", match: str = "any") -> DataFrame:
    """key, score from an inverted index (term, key, tf, length) over n chunks. The filter on term reaches the files, which are
    sorted by it; statistics of the few terms are one row each."""
    if not words:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    hits = index.filter(F.col("term").isin(words))
    df = {r.term: r.df for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
    if not df:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    of = F.create_map(*[F.lit(x) for t, d in df.items() for x in (t, _idf(n, d))])
    part = of[F.col("term")] * _weight(F.col("tf"), F.col("length"), F.lit(float(average or 1.0)))
    scores = hits.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("_n"))
    return (scores.filter(F.col("_n") == len(words)) if match == "all" else scores).select(key, "score")


def _idf(n: float, df: float) -> float:
    raw = math.log((n - df + 0.5) / (df + 0.5))
    return 1e-6 if raw <= 0 else raw


def bm25_batch(chunks: DataFrame, queries: DataFrame, k: int, *, key: str = "chunk_id", digits: int = 9, block: int = 1 << 21) -> DataFrame:
    """query_id, key, score (rounded), rank (from 1) of the k best chunks of every query (query_id, text), ties by key.

    The query set is stated by the caller. Its terms' weights go to every task as a matrix, in blocks of queries of bounded
    size; a task multiplies its chunks' weights with it and keeps k rows a query, and only those are shuffled. A first pass
    counts just the asked terms."""
    spark = chunks.sparkSession
    asked = {r.query_id: sorted(set(_split(r.text))) for r in queries.select("query_id", "text").collect()}
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in asked.values() for t in ts}))}
    shared = spark.sparkContext.broadcast(vocabulary)
    n, average, df = _statistics(chunks, list(vocabulary))
    parts, names = [], list(asked)
    step = max(1, block // max(1, len(vocabulary)))
    key_type = chunks.schema[key].dataType.simpleString()
    for at in range(0, len(names), step):
        own = names[at : at + step]
        matrix = np.zeros((len(vocabulary), len(own)))
        for j, q in enumerate(own):
            for t in asked[q]:
                if df[vocabulary[t]]:
                    matrix[vocabulary[t], j] = _idf(n, df[vocabulary[t]])
        held = spark.sparkContext.broadcast((own, matrix, average))

        def score(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, (own, matrix, average) = shared.value, held.value
            keys: list = []
            scores = np.zeros((0, len(own)))

            def cut() -> None:
                nonlocal keys, scores
                rows, cols = [], []
                order = np.argsort(np.array(keys, object)) if keys else np.zeros(0, np.int64)
                for j in range(scores.shape[1]):
                    c = order[scores[order, j] > 0]
                    c = c[np.argsort(-scores[c, j], kind="stable")][:k]
                    rows.append(c)
                    cols.append(np.full(len(c), j))
                kept.append([(keys[i], j, scores[i, j]) for i, j in zip(np.concatenate(rows).tolist(), np.concatenate(cols).tolist())] if rows else [])
                keys, scores = [], np.zeros((0, scores.shape[1]))

            kept: list[list[tuple]] = []
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    w = np.zeros((part.num_rows, len(ids)))
                    for i, text in enumerate(part.column(1).to_pylist()):
                        tokens = _split(text)
                        found = Counter(x for t in tokens if (x := ids.get(t)) is not None)
                        if found:
                            tf = np.fromiter(found.values(), float, len(found))
                            w[i, list(found)] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / average))
                    keys += part.column(0).to_pylist()
                    scores = np.concatenate([scores, np.round(w @ matrix, digits)])
                    if len(keys) >= 4096:
                        cut()
            cut()
            rows = [r for part in kept for r in part]
            if rows:
                k_, j, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([own[x] for x in j]), pa.array(k_), pa.array(s)], names=["query_id", key, "score"])

        parts.append(chunks.select(key, "text").mapInArrow(score, f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {key_type}, score double"))
    if not parts:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {key_type}, score double, rank int")
    return best_of_each(reduce(DataFrame.unionByName, parts), k, key=key)


def best(scores: DataFrame, k: int, *, key: str = "chunk_id", only: DataFrame | None = None) -> DataFrame:
    """The k best rows, ties by key; `only` (a frame of keys) filters after scoring, so statistics stay those of all."""
    kept = scores if only is None else scores.join(only.select(key), key, "left_semi")
    return kept.orderBy(F.desc("score"), key).limit(k)


def best_of_each(scores: DataFrame, k: int, *, key: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
