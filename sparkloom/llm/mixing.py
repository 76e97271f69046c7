"""Mixing sources to target weights over fixed-length blocks.

Every source's words, in order of doc_id, are packed into blocks of a fixed number of words (the last may be shorter). For
each output shard the numbers of slots that go to the sources are drawn from a multinomial whose chances are the targets'
shares. What all shards together drew for a source is then settled to its target: surplus slots are taken from shards
drawn without replacement, missing ones given to shards drawn anew, so the mix keeps its weights and a shard its chance.
A source's slots are numbered shard by shard; slot j takes block permutation(j mod blocks), a keyed pseudorandom permutation
of the source's block numbers, so every block is used once before any is used again; the last slot takes the first words of
its block that are still wanted. The mix joins blocks to slots by (source, block number).

Edge cases: a null text has size 0; a null source is a source of its own, ordered last; empty documents are never taken;
rows with equal doc_id are separate units, ordered by size and content; an empty table gives an empty result; further
columns are ignored or, by mix_documents, carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shielded, table, utf8


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    total: float = 1.5
    most_repeats: float = 2.0
    block_words: int = 256
    shards: int = 64
    seed: int = 20240117


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, uid (a digest of doc_id, source and text), size: one row a document."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, sizes = [], []
            for doc_id, text, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = utf8(text)
                uids.append(_uid(doc_id, data, text, source))
                sizes.append(len(data.split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(uids, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "source", "uid", "size"])

    return docs.select("doc_id", "text", "source").mapInArrow(size, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, uid binary, size long")


def _uid(doc_id, data: bytes, text: str | None, source: str | None) -> bytes:
    return hashlib.blake2b(data, digest_size=12, key=hashlib.blake2b(repr((doc_id, text is None, source)).encode(), digest_size=16).digest()).digest()


def _ranked(by: DataFrame) -> DataFrame:
    """by with the rank of each source: numbered within range partitions, whose own numbers of rows are summed up, so no task orders all sources."""
    ordered, _ = materialize(by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")  # a row a partition
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ordered.withColumn("rank", own).join(base.hint("merge"), "part").withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")


def _with_source(rows: DataFrame, sources: DataFrame, *columns: str, salts: int = 16) -> DataFrame:
    """rows with columns of their source. Where sources are too many to be sent to every task, the join is by source and salt,
    as one source may have a third of all rows."""
    many = sources.select(F.col("source").alias("_s"), *columns, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    own = rows.withColumn("_own", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    return own.join(many, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_own") == F.col("_salt"))).drop("_s", "_salt", "_own")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source, rank (by code point, null last, from 0), source_size, target: the level of water at which
    min(most_repeats * size, level * weight) sums to total * all sizes. Only sums over the sources leave Spark."""
    by = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("rank") % len(mix.weights) + 1).cast("int"))
    by, _ = materialize(by.withColumn("weight", weight).withColumn("most", mix.most_repeats * F.col("source_size")))
    total = mix.total * (by.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("most") < level * F.col("weight") if capped >= 0 else F.lit(False)
        r = by.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("used"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if r.n == capped or not r.open:
            break
        capped, level = r.n, (total - r.used) / r.open
    return by.select("source", F.col("rank").cast("long").alias("rank"), "source_size", F.least("most", level * F.col("weight")).alias("target"))


def permuted(x: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(n) at x, or with back its inverse: a balanced Feistel network over the next power of
    four, walked until within n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "little")) for r in range(rounds)]

    def scrambled(v: np.ndarray, k: np.uint64) -> np.ndarray:
        f = (v + k) * np.uint64(0x9E3779B97F4A7C15)
        f ^= f >> np.uint64(29)
        f *= np.uint64(0xBF58476D1CE4E5B9)
        return (f ^ (f >> np.uint64(32))) & mask

    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> shift, v & mask
        for k in reversed(keys) if back else keys:
            left, right = (right ^ scrambled(left, k), left) if back else (right, left ^ scrambled(right, k))
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def wanted_words(target: float, size: int, most_repeats: float) -> int:
    return min(int(target + 0.5), int(most_repeats * size))


def slot_count(wanted: int, size: int, block_words: int, key: int) -> int:
    """Slots that hold the wanted words: all blocks for each whole pass, then as many of the next, in permuted order, as it takes."""
    blocks = -(-size // block_words)
    passes, rest = divmod(wanted, size)
    missing = blocks * block_words - size  # words that the last block lacks
    n = -(-rest // block_words)
    if missing and n and _place(blocks - 1, blocks, key) < n and n * block_words - missing < rest:
        n += 1
    return passes * blocks + n


def _place(block: int, blocks: int, key: int) -> int:
    return int(permuted(np.array([block]), blocks, key, back=True)[0])


def slot_words(j: np.ndarray, block: np.ndarray, wanted: int, size: int, block_words: int, key: int) -> np.ndarray:
    """Words that slots j of a source, with these blocks, take: whole blocks, but for the last slot, which takes what is left."""
    blocks = -(-size // block_words)
    missing = blocks * block_words - size
    short = _place(blocks - 1, blocks, key)
    passes, within = j // blocks, j % blocks
    before = passes * size + within * block_words - np.where(within > short, missing, 0)
    own = np.where(block == blocks - 1, block_words - missing, block_words)
    return np.clip(wanted - before, 0, own)


def shard_counts(sources: DataFrame, mix: Mix) -> DataFrame:
    """rank, counts (slots by shard) of each source; sources has rank, slots.

    A shard's multinomial is drawn source by source as binomials of what is left, in one pass over rows sorted by
    (shard, rank), so no task holds the sources. Settling a source takes its row a shard."""
    totals = sources.agg(F.sum("slots")).first()[0] or 0

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rng, left, chance = -1, None, 0, 0
        for batch in batches:
            own, ranks, slots = (batch.column(c).to_pylist() for c in ("shard", "rank", "slots"))
            drawn = []
            for s, n in zip(own, slots):
                if s != shard:
                    shard, rng, chance = s, np.random.default_rng([mix.seed, 1, s]), totals
                    left = totals // mix.shards + (s < totals % mix.shards)
                k = left if n >= chance else int(rng.binomial(left, n / chance)) if n else 0
                left, chance = left - k, chance - n
                drawn.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(slots, pa.int64()), pa.array(own, pa.int32()), pa.array(drawn, pa.int64())], names=["rank", "slots", "shard", "drawn"])

    each = sources.select("rank", "slots", F.explode(F.sequence(F.lit(0), F.lit(mix.shards - 1))).alias("shard"))
    drawn = each.repartition("shard").sortWithinPartitions("shard", "rank").mapInArrow(draw, "rank long, slots long, shard int, drawn long")
    rows = drawn.groupBy("rank").agg(F.first("slots").alias("slots"), F.sort_array(F.collect_list(F.struct("shard", "drawn"))).alias("drawn"))  # mix.shards structs

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, slots, drawn = (batch.column(c).to_pylist() for c in ("rank", "slots", "drawn"))
            counts = [settled(np.array([d["drawn"] for d in own], np.int64), n, r, mix).tolist() for r, n, own in zip(ranks, slots, drawn)]
            yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array(counts, pa.list_(pa.int64()))], names=["rank", "counts"])

    return rows.mapInArrow(settle, "rank long, counts array<long>")


def settled(drawn: np.ndarray, slots: int, rank: int, mix: Mix) -> np.ndarray:
    """The drawn counts with the surplus over `slots` taken away, or what is missing given out, at random."""
    rng, out = np.random.default_rng([mix.seed, 2, rank]), drawn.copy()
    over = int(out.sum()) - slots
    if over < 0:
        return out + rng.multinomial(-over, np.full(len(out), 1 / len(out)))
    rest = int(out.sum())
    for s in range(len(out)):
        if not over:
            break
        own = int(out[s])
        gone = int(_hypergeometric(rng, own, rest - own, over))
        out[s], rest, over = own - gone, rest - own, over - gone
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good; beyond what numpy takes, of a binomial within its bounds."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    return int(np.clip(rng.binomial(n, good / (good + bad)), max(0, n - bad), min(n, good)))


def mix_slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """rank, slot, shard, block, words of every slot of the mix; sources has rank, source_size, wanted, blocks, slots, counts."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank, size, wanted, blocks, n, counts, first, stop in zip(*(batch.column(c).to_pylist() for c in ("rank", "source_size", "wanted", "blocks", "slots", "counts", "first", "stop"))):
                key = _source_key(rank, mix)
                j = np.arange(first, min(stop, n), dtype=np.int64)
                block = permuted(j % blocks, blocks, key)
                shard = np.searchsorted(np.cumsum(counts), j, "right").astype(np.int32)
                words = slot_words(j, block, wanted, size, mix.block_words, key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), rank, np.int64)), pa.array(j), pa.array(shard), pa.array(block), pa.array(words)], names=["rank", "slot", "shard", "block", "words"])

    step = 1 << 18  # slots of a source are made in runs, so that a large source is spread over tasks
    runs = sources.filter("slots > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(step).cast("long")))).withColumn("stop", F.col("first") + step)
    return runs.select("rank", "source_size", "wanted", "blocks", "slots", "counts", "first", "stop").repartition("rank", "first").mapInArrow(slots, "rank long, slot long, shard int, block long, words long")


def _source_key(rank: int, mix: Mix) -> int:
    return mix.seed * 1_000_003 + rank


def _with_slots(sources: DataFrame, mix: Mix) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, slots = [], []
            for rank, size, target in zip(*(batch.column(c).to_pylist() for c in ("rank", "source_size", "target"))):
                w = wanted_words(target, size, mix.most_repeats)
                wanted.append(w)
                slots.append(slot_count(w, size, mix.block_words, _source_key(rank, mix)) if w else 0)
            blocks = [-(-n // mix.block_words) for n in batch.column("source_size").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in (wanted, blocks, slots))], names=[*batch.schema.names, "wanted", "blocks", "slots"])

    return sources.mapInArrow(run, "source string, rank long, source_size long, target double, wanted long, blocks long, slots long")


def _spans(sizes: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """uid, occurrence, rank, block, at (first word within the document), words, b_at (that word's place in the block): the
    part of each block that a document fills. Places are running sums over range partitions, so a source with most of the
    rows is summed by many tasks."""
    ranked = _with_source(sizes.filter("size > 0"), sources, "rank").select("doc_id", "rank", "uid", "size")
    ordered, _ = materialize(ranked.repartitionByRange("rank", "doc_id", "uid").sortWithinPartitions("rank", "doc_id", "uid").withColumn("part", F.spark_partition_id()))
    parts = ordered.groupBy("rank", "part").agg(F.sum("size").alias("n"))
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("rank", "part", "base")
    w = Window.partitionBy("rank", "part").orderBy("doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    occurrence = F.row_number().over(Window.partitionBy("rank", "part", "doc_id", "uid").orderBy("size"))
    placed = ordered.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0))).withColumn("occurrence", occurrence).join(base.hint("merge"), ["rank", "part"]).withColumn("start", F.col("start") + F.col("base"))
    b = F.lit(block_words)
    first, last = F.floor(F.col("start") / b).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / b).cast("long")
    each = placed.withColumn("block", F.explode(F.sequence(first, last)))
    at = F.greatest(F.lit(0), F.col("block") * b - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * b - F.col("start"))
    return each.select("doc_id", "uid", "occurrence", "rank", "block", at.alias("at"), (end - at).alias("words"), (F.col("start") + at - F.col("block") * b).alias("b_at"))


def plan_mix(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes of documents, sources with targets and slots, uses): a use is the part of a document that one slot takes, with
    uid, occurrence, at, words, shard and slot."""
    sizes, _ = materialize(_sizes(docs))
    sources, _ = materialize(_with_slots(source_targets(sizes, mix), mix))
    counted = sources.join(shard_counts(sources, mix).hint("merge"), "rank")
    spans = _spans(sizes, sources, mix.block_words)
    slots = mix_slots(counted, mix).withColumnRenamed("words", "slot_words")
    uses = spans.join(slots.hint("merge"), ["rank", "block"])
    words = F.least(F.col("words"), F.col("slot_words") - F.col("b_at"))  # the last slot of a source may end within its block
    return sizes, sources, uses.withColumn("words", words).filter("words > 0").select("doc_id", "uid", "occurrence", "at", "words", "shard", "slot")


def taken_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and by_shard (shard, words: what each output shard takes of it) of every document."""
    sizes, sources, uses = plan_mix(docs, mix)
    # one shuffle by uid serves both sums; a document has at most mix.shards entries
    by = uses.repartition("uid").groupBy("uid", "occurrence", "shard").agg(F.sum("words").alias("words"))
    taken = by.groupBy("uid", "occurrence").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("by_shard"))
    numbered = sizes.withColumn("occurrence", F.row_number().over(Window.partitionBy("uid").orderBy("size")))  # rows alike in all that counts
    full = _with_source(numbered.join(taken.hint("merge"), ["uid", "occurrence"], "left"), sources, "source_size", "target")
    none = F.array().cast("array<struct<shard:int,words:bigint>>")
    return full.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("by_shard", none).alias("by_shard"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), shards: bool = False) -> DataFrame:
    """The mix as documents: a row for each time a document is used, its text the words taken that time, one space between
    (a document taken whole keeps its text as it is); n_chars, where there is such a column, is that text's. What isn't taken
    goes. With shards a row is what one output shard takes of a document that time, and a last column `shard` says which."""
    docs, back = shielded(docs, "_uid", "_used", "_k", *(["shard"] if shards else []))
    _, _, uses = plan_mix(docs, mix)
    group = F.col("shard") if shards else F.lit(-1)
    parts = F.struct(group.alias("shard"), "at", "slot", "words")
    used = uses.groupBy("uid", "occurrence").agg(F.sort_array(F.collect_list(parts)).alias("used"))  # what one document's blocks hold
    fields = docs.schema.fields
    names = [f.name for f in fields]

    def add_uid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(names.index(c)).to_pylist() for c in ("doc_id", "text", "source")]
            uid = pa.array([_uid(d, utf8(t), t, s) for d, t, s in zip(*cols)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, uid], names=[*names, "_uid"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, texts, where = [], [], []
            for i, (text, used) in enumerate(zip(batch.column(names.index("text")).to_pylist(), batch.column("_used").to_pylist())):
                words = utf8(text).split()
                times: dict[tuple[int, int], list] = {}  # (shard, the how-manieth use of its place) -> parts in order
                seen: dict[tuple[int, int], int] = {}
                for u in used:
                    n = seen[u["shard"], u["at"]] = seen.get((u["shard"], u["at"]), 0) + 1
                    times.setdefault((u["shard"], n), []).append(u)
                for (shard, _), own in sorted(times.items()):
                    kept = [w for u in own for w in words[u["at"] : u["at"] + u["words"]]]
                    take.append(i)
                    where.append(shard)
                    texts.append(text if len(kept) == len(words) else b" ".join(kept).decode("utf-8", "surrogatepass"))
            out = batch.take(pa.array(take, pa.int64())) if take else None
            cols = []
            for f, field in zip(fields, batch.schema):
                if out is None:
                    cols.append(pa.array([], field.type))
                elif f.name == "text":
                    cols.append(pa.array(texts, field.type))
                elif f.name == "n_chars":
                    cols.append(pa.array([len(t) for t in texts], field.type))
                else:
                    cols.append(out.column(f.name))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where, pa.int32())], names=[*names, "shard"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    keyed = docs.mapInArrow(add_uid, f"{ddl}, _uid binary").withColumn("_k", F.row_number().over(Window.partitionBy("_uid").orderBy("_uid")))
    own = used.select(F.col("uid").alias("_uid"), F.col("occurrence").alias("_k"), F.col("used").alias("_used"))
    joined = keyed.join(own.hint("merge"), ["_uid", "_k"]).select(*[F.col(f"`{n}`") for n in names], "_used")
    return joined.mapInArrow(cut, f"{ddl}, shard int").select(*back, *(["shard"] if shards else []))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def op10_multinomial_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
