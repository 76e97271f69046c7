"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_pool(n_chunks: int, top_k: int) -> int:
    """Candidates of each leg of a search: a third of the store, between 3 and 10 times top_k."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    return min(10 * top_k, max(3 * top_k, n_chunks // 3))


def distance(vector: Column | str, query: list[float], metric: str = "l2") -> Column:
    """Distance in double precision between an array column and one query vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*[F.lit(float(x)) for x in query])
    zero = F.lit(0.0)
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(v, q, lambda x, y: (x - y) * (x - y)), zero, lambda a, x: a + x))
    if metric == "cosine":
        dot = F.aggregate(F.zip_with(v, q, lambda x, y: x * y), zero, lambda a, x: a + x)
        norm = F.sqrt(F.aggregate(v, zero, lambda a, x: a + x.cast("double") * x))
        return 1 - dot / F.greatest(norm * F.lit(float(np.sqrt(sum(float(x) ** 2 for x in query)))), F.lit(1e-12))
    raise ValueError(f"unknown metric {metric!r}")


def nearest(vectors: DataFrame, query: list[float], k: int, *, key: str = "chunk_id", column: str = "embedding", metric: str = "l2", only: DataFrame | None = None) -> DataFrame:
    """key and dist of the k nearest rows, ties by key. `only` (a frame of keys) restricts them before the ranking."""
    pool = vectors if only is None else vectors.join(only.select(key), key, "left_semi")
    return pool.select(key, distance(column, query, metric).alias("dist")).orderBy("dist", key).limit(k)


def within_cutoff(hits: DataFrame, ratio: float = 1.15) -> DataFrame:
    """Hits (of each query_id, if there is one) no further than ratio times the best; all of them if that is at distance 0.
    hits is at most a pool for each query."""
    best = F.min("dist").over(Window.partitionBy(*[c for c in ("query_id",) if c in hits.columns]))
    return hits.withColumn("_best", best).filter((F.col("_best") <= 0) | (F.col("dist") <= F.col("_best") * ratio)).drop("_best")


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, *, key: str = "chunk_id", column: str = "embedding", metric: str = "l2", block: int = 1 << 13, most: int = 1 << 24) -> DataFrame:
    """query_id, key, dist, rank (from 1) of the k nearest rows of every query (query_id, vector), ties by key.

    The query set is stated by the caller; it is sent to every task in blocks of at most `most` numbers. Each task takes the
    candidates of a query by a matrix product, measures these exactly and keeps k rows a query; only those are shuffled."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = vectors.sparkSession
    asked = queries.select("query_id", "vector").orderBy("query_id").toPandas()
    names, all_q = asked["query_id"].tolist(), np.array(asked["vector"].tolist(), np.float64)
    step = max(1, most // max(1, all_q.shape[1] if len(names) else 1))
    ddl = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, dist double"
    parts = []
    for at in range(0, len(names), step):
        held = spark.sparkContext.broadcast((names[at : at + step], all_q[at : at + step]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, q = held.value
            length = np.sqrt((q**2).sum(1))
            rows: list[list[tuple]] = [[] for _ in own]
            for batch in batches:
                for lo in range(0, batch.num_rows, block):
                    part = batch.slice(lo, block)
                    keys = part.column(0).to_pylist()
                    m = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    size = np.sqrt((m**2).sum(1))
                    dot = m @ q.T
                    near = (size**2)[:, None] - 2 * dot if metric == "l2" else -dot / np.maximum(size, 1e-12)[:, None]
                    for i in range(len(own)):
                        c = np.arange(len(m))
                        if len(m) > k:  # the product's rounding is allowed for
                            edge = np.partition(near[:, i], k - 1)[k - 1]
                            c = np.flatnonzero(near[:, i] <= edge + 1e-9 * (1 + abs(edge) + length[i] ** 2))
                        d = np.sqrt(((m[c] - q[i]) ** 2).sum(1)) if metric == "l2" else 1 - dot[c, i] / np.maximum(size[c] * length[i], 1e-12)
                        rows[i] = sorted([*rows[i], *zip(d.tolist(), (keys[x] for x in c))])[:k]
            out = [(n, kk, d) for n, own_rows in zip(own, rows) for d, kk in own_rows]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["query_id", key, "dist"])

        parts.append(vectors.select(key, column).filter(F.col(column).isNotNull()).mapInArrow(run, ddl))
    local = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ddl)
    w = Window.partitionBy("query_id").orderBy("dist", key)
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
