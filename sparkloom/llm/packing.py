"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most `capacity`; the histogram of piece lengths (at most `capacity` entries,
whatever the corpus holds) is packed on the driver: complements of one, two and three lengths that fill a gap exactly
are consumed under availability counts, the rest goes best-fit. The plan is then applied to the pieces by their rank
within their length.

Edge cases: a null text is empty and gives the single end token; repeated rows, and rows with one doc_id or none, are
packed each on its own; a special token's string in a text is that token (or, if so asked, ordinary text); a text of any
length is cut into as many pieces as it needs; an empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k"


def _encoder(vocabulary: str, special_as_text: bool = False):
    """text -> ids, as the tokenizers library gives them for {name}.json with add_special_tokens=False, at four times its
    speed (tested over every code point). A special token's string in a text is that token, as in the library's plain call;
    with special_as_text it is ordinary text."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"))}
    special = {t["content"]: t["id"] for t in json.load(open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8"))["added_tokens"]}
    own = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={} if special_as_text else special)
    allowed = own.special_tokens_set
    return lambda text: own.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, special_as_text: bool = False) -> DataFrame:
    """One row a piece; (part, length, local_rank) is a key as long as this frame is written before it is used."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = _encoder(vocabulary, special_as_text), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                start, k = 0, 0
                while start < len(ids):
                    stop = start + ((len(ids) - start - 1) % capacity + 1 if start == 0 else capacity)
                    length = stop - start
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start:stop].tobytes()), part, seen[length]))
                    seen[length] += 1
                    start, k = stop, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences filled so; counts: pieces by length. Every piece is used once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= n * k
        plan.append((lengths, n))

    def free(x: int, *taken: int) -> bool:
        return left[x] > taken.count(x)

    def pair(gap: int, *taken: int) -> tuple[int, int] | None:
        """The two available lengths of that sum whose larger is largest."""
        have = left > 0
        ok = have[1:gap] & have[1:gap][::-1]
        for a in np.flatnonzero(ok)[::-1] + 1:
            a = int(a)
            if a < gap - a:
                return None
            if free(a, *taken) and free(gap - a, *taken, a):
                return a, gap - a
        return None

    def triple(gap: int, taken: int) -> tuple[int, int, int] | None:
        for a in np.flatnonzero(left[1:gap] > 0)[::-1] + 1:
            a = int(a)
            if a * 3 < gap:
                return None
            if free(a, taken) and (found := pair(gap - a, taken, a)):
                return a, *found
        return None

    for big in range(capacity, 0, -1):
        while left[big] > 0:
            gap = capacity - big
            if gap == 0:
                use((big,))
                continue
            if free(gap, big):
                use((big, gap))
                continue
            if found := pair(gap, big):
                use((big, *found))
                continue
            if not (found := triple(gap, big)):
                break  # this length has no exact complement
            use((big, *found))

    # best fit of what is left, longest first: bins of the same filling are kept together with their number
    bins: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(gap: int, lengths: tuple[int, ...], n: int) -> None:
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append([lengths, n])

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                each = capacity // length
                if todo >= each:
                    put(capacity - each * length, (length,) * each, todo // each)
                if rest := todo % each:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            gap = gaps[i]
            kind = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(i)
            each = min(gap // length, todo)
            n = min(kind[1], todo // each)
            if kind[1] > n:
                put(gap, kind[0], kind[1] - n)
            put(gap - each * length, kind[0] + (length,) * each, n)
            todo -= n * each
    return plan + [(lengths, n) for kinds in bins.values() for lengths, n in kinds]


def _slots(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first sequence, offset), by rank: a piece takes the place of the last row not beyond its rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank = [0] * (capacity + 1)
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            rows.setdefault(x, []).append((rank[x], sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces, _ = materialize(token_pieces(docs, capacity, vocabulary, special_as_text))
    local = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = local.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base, _ = materialize(base.select("part", "length", "n", F.coalesce("base", F.lit(0)).alias("base")))
    counts = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(_slots(plan_packing(counts, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own, s = np.flatnonzero(length == x), slots.value[int(x)]
                i = np.searchsorted(s[:, 0], rank[own], "right") - 1
                sequence[own], offset[own] = s[i, 1] + rank[own] - s[i, 0], s[i, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES[:5]), pa.array(sequence), pa.array(offset)], names=[*_NAMES[:5], "sequence_id", "offset"])

    ranked = pieces.join(base.select("part", "length", "base").hint("merge"), ["part", "length"]).select(*_NAMES[:5], (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


def op9_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
