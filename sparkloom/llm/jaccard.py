"""N-gram Jaccard join by chosen paths.

Texts become sets of word n-grams; equal sets are one class. A class's set is embedded as minhash tokens (place, value).
From the root every tree node samples two places, and a class goes on to the child of each by the token it has there, so
classes meet where they share the sampled tokens. After `depth` levels buckets of one are dropped, buckets of up to `small`
classes are brute-forced by their sketches, and the classes of larger ones go down further trees of their own, as many as keep
a pair at the threshold together with the chance `deep_recall`. What is still larger is compared in pairs of blocks of
`small` classes, so no task holds a large bucket and none is dropped or cut. Runs of the first tree are repeated until a pair at
the threshold meets with the target recall, whatever the size of its buckets. Connected candidates are then verified exactly: all
pairs within them, in blocks of bounded size, by set intersection. Only a spanning forest of links and the number of links
of each class leave a block, never its pairs.

Edge cases: a null text is empty; a text of fewer than n words is the one gram of all its words; texts without words link to
nothing, not even each other; repeated rows and copies are one class, linked to each other; rows with equal doc_id and
different texts are told apart; a null doc_id comes after all others, and texts without one that link only to one another have a null
class_id; ties need no rule, as links are a set; an empty table gives an empty result; columns beyond
doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, shielded, table
from .components import connected_components
from .hashing import mix, slices


def _meeting(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a leaf of a tree in which every node samples two places."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - threshold * q) ** 2
    return q


@dataclass(frozen=True)
class Join:
    """slack: how far below the threshold a sketch's estimate may be for a pair to be verified (64 places: 2.4 deviations)."""

    n: int = 3
    threshold: float = 0.5
    target_recall: float = 0.97
    places: int = 64
    depth: int = 3
    small: int = 4096
    deep: int = 4
    deep_recall: float = 0.98
    slack: float = 0.15
    block_weight: int = 1 << 21
    seed: int = 7

    def runs(self) -> int:
        """Trees until a pair at the threshold meets with the target recall, be its buckets small or split further."""
        q = _meeting(self.threshold, self.depth) * self.deep_recall
        return math.ceil(math.log(1 - self.target_recall) / math.log(1 - q))

    def deep_runs(self) -> int:
        """Trees below a large bucket until a pair at the threshold meets again with deep_recall."""
        return math.ceil(math.log(1 - self.deep_recall) / math.log(1 - _meeting(self.threshold, self.deep)))


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each distinct n-gram, its 64-bit hash) by slice; sorted by row and hash."""
    for s in slices(texts):
        rows = len(s.offsets) - 1
        p = s.prefix(s.lower())
        start, stop, doc = s.words()
        if not len(start):
            yield s.first, rows, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        w = s.run_hash(p, start, stop)
        count = np.bincount(doc, minlength=rows)
        place = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        own = np.minimum(count, n)[doc]  # words in a gram of this text
        full = place <= count[doc] - own
        at = np.flatnonzero(full)
        g = np.zeros(len(at), np.uint64)
        for k in range(n):
            use = own[at] > k
            g[use] = mix(g[use] * np.uint64(0x9E3779B97F4A7C15) + w[at[use] + k])
        d = doc[at]
        order = np.lexsort((g, d))
        g, d = g[order], d[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        yield s.first, rows, d[keep], g[keep]


def _minhash(d: np.ndarray, g: np.ndarray, rows: int, places: int, seed: int) -> np.ndarray:
    """rows x places of 32-bit minima; rows without grams hold zeros."""
    out = np.zeros((rows, places), np.uint32)
    if not len(g):
        return out
    have, first = np.unique(d, return_index=True)
    h = (g >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, places, np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, places, np.uint64).astype(np.uint32)
    for k in range(places):
        x = (h ^ b[k]) * a[k]
        x ^= x >> np.uint32(15)
        out[have, k] = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), first)
    return out


def _fold(d: np.ndarray, g: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 63-bit digest of each row's set, and its size."""
    size = np.bincount(d, minlength=rows)
    total = np.zeros(rows, np.uint64)
    if len(g):
        have, first = np.unique(d, return_index=True)
        total[have] = mix(np.add.reduceat(mix(g), first) * np.uint64(3) + size[have].astype(np.uint64))
    return (total >> np.uint64(1)).astype(np.int64), size


def sketches(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, h (hash of the text), class (digest of the set; null if empty), n_grams, sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, d, g in gram_sets(batch.column(1), join.n):
                digest, size = _fold(d, g, rows)
                sig = _minhash(d, g, rows, join.places, join.seed).astype("<u4")
                none = size == 0
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(digest, mask=none), pa.array(size), pa.array([None if e else r.tobytes() for r, e in zip(sig, none)], pa.binary())],
                    names=["doc_id", "h", "class", "n_grams", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, f"doc_id {kind}, h long, class long, n_grams long, sketch binary")


def _tree(join: Join) -> list[list[int]]:
    """The places on the way to each leaf of every run: two are sampled at each node, none twice on a way."""
    rng, leaves = np.random.default_rng(join.seed + 1), []
    for _ in range(join.runs()):
        level: list[list[int]] = [[]]
        for _ in range(join.depth):
            level = [[*way, int(p)] for way in level for p in rng.choice([x for x in range(join.places) if x not in way], 2, replace=False)]
        leaves += level
    return leaves


def _signatures(c: pa.Array, join: Join) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, join.places).astype(np.uint64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def leaf_keys(classes: DataFrame, join: Join) -> DataFrame:
    """key, class: the leaves that each class reaches."""
    leaves = _tree(join)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column(1), join)
            keys = np.empty((len(sig), len(leaves)), np.uint64)
            for i, way in enumerate(leaves):
                k = np.full(len(sig), i * int(_STEP) & (1 << 64) - 1, np.uint64)
                for p in way:
                    k = mix(k * _STEP + sig[:, p])
                keys[:, i] = k
            ids = np.repeat(batch.column(0).to_numpy(), len(leaves))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "class"])

    return classes.select("class", "sketch").mapInArrow(run, "key long, class long")


def deep_keys(rows: DataFrame, join: Join) -> DataFrame:
    """key, class: the leaves that the rows (key, class, sketch) of large buckets reach below these. Every node samples by its
    own key, and no place twice on the way through one of these trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                sig, root = _signatures(part.column(2), join), part.column(0).to_numpy().view(np.uint64)
                every = np.arange(len(root))
                out = []
                for r in range(join.deep_runs()):
                    level = [(mix(root * _STEP + np.uint64(r + 1)), np.zeros((len(root), join.places), bool))]
                    for _ in range(join.deep):
                        below = []
                        for k, used in level:
                            order = mix(k[:, None] + np.arange(1, join.places + 1, dtype=np.uint64) * _STEP)
                            order[used] = np.iinfo(np.uint64).max
                            for p in np.argpartition(order, 2, axis=1)[:, :2].T:
                                on = used.copy()
                                on[every, p] = True
                                below.append((mix(k * _STEP + p.astype(np.uint64)) ^ mix(sig[every, p] + _STEP), on))
                        level = [(mix(k), on) for k, on in below]
                    out += [k for k, _ in level]
                keys = np.stack(out, 1)
                ids = np.repeat(part.column(1).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["key", "class"])

    return rows.select("key", "class", "sketch").mapInArrow(run, "key long, class long")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups, by the first `keys` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def shared_leaves(keys: DataFrame, join: Join) -> DataFrame:
    """key, class, block: rows of keys that aren't alone with their key; every `small` rows of a key are a block of it. One
    pass over sorted partitions that holds one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_class = None
        last_out, last_rank = False, -1

        def rows(k, c, rank) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array((np.asarray(rank) // join.small).astype(np.int32))], names=["key", "class", "block"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = k[1:] == k[:-1]
            out = np.zeros(n, bool)
            out[1:] |= same
            out[:-1] |= same
            first = np.append(True, ~same)
            rank = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
            if last_key is not None and k[0] == last_key:
                out[0] = True
                rank[: int(np.argmax(first[1:])) + 1 if first[1:].any() else n] += last_rank + 1
                if not last_out:
                    yield rows([last_key], [last_class], [last_rank])
            last_key, last_class, last_out, last_rank = k[-1], c[-1], bool(out[-1]), int(rank[-1])
            yield rows(k[out], c[out], rank[out])

    return keys.repartition("key").sortWithinPartitions("key", "class").mapInArrow(run, "key long, class long, block int")


def _large(met: DataFrame) -> tuple[DataFrame, int]:
    """(key, last: number of its last block) of the keys with more than one block, as a hinted frame, and how many there are.
    Of `small` rows one key at most is large; where these are few enough, they are sent to every task."""
    large, _ = materialize(met.filter("block > 0").groupBy("key").agg(F.max("block").alias("last")))
    n = large.count()
    return (F.broadcast(large) if n <= 100_000 else large.hint("merge")), n


def _near(sketch: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Components (arrays of rows) of the graph of rows that agree in at least `least` places. A row taken off is only
    compared with rows not yet reached, so a dense group costs little more than its size."""
    left, open_ = np.arange(len(sketch)), np.ascontiguousarray(sketch.T)
    counts = np.min_scalar_type(sketch.shape[1])  # agreements are added up place by place, in bytes where they fit
    while len(left):
        found, todo, left, open_ = [left[:1]], [left[0]], left[1:], open_[:, 1:]
        while todo and len(left):
            u = todo.pop()
            near = (open_ == sketch[u][:, None]).view(np.uint8).sum(0, dtype=counts) >= least
            if near.any():
                found.append(left[near])
                todo.extend(left[near])
                left, open_ = left[~near], open_[:, ~near]
        yield np.concatenate(found)


def split_bucket(ids: np.ndarray, sketch: np.ndarray, join: Join) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of the candidate pairs among rows that were brought together: all that agree in enough places."""
    if len(ids) < 2:
        return
    for part in _near(sketch, int(math.ceil((join.threshold - join.slack) * join.places))):
        if len(part) > 1:
            own = ids[part]
            yield own[own != own.min()], np.full(int((own != own.min()).sum()), own.min())


def buckets(classes: DataFrame, join: Join) -> DataFrame:
    """key, i, j, class: classes to be compared with one another, by bucket and pair of blocks."""
    met, path = materialize(shared_leaves(leaf_keys(classes, join), join))
    whole = lambda rows: rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "class")
    large, n = _large(met)
    if not n:
        return whole(met)
    small = whole(met.join(large, "key", "left_anti"))
    signed = met.join(large.select("key"), "key", "left_semi").join(classes.select("class", "sketch").hint("merge"), "class")
    below, _ = materialize(shared_leaves(deep_keys(signed, join), join))
    large, n = _large(below)
    if not n:
        return small.unionByName(whole(below))
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    grid = below.join(large, "key").withColumn("other", other).filter("other <> block")
    grid = grid.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class")
    return small.unionByName(whole(below.join(large, "key", "left_anti"))).unionByName(grid)


def candidate_edges(classes: DataFrame, join: Join) -> DataFrame:
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, join.places).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sig], pa.binary())], names=["class", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0) if a else np.zeros((0, 2), np.int64)
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for _, group in grouped(batches, 3):
            ids = group.column(3).to_numpy()
            sketch = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint8).reshape(len(ids), join.places)
            for x, y in split_bucket(ids, sketch, join):
                a.append(x)
                b.append(y)
            if len(a) > 100_000:
                yield out()
        yield out()

    joined = buckets(classes, join).join(classes.select("class", "sketch").mapInArrow(short, "class long, sketch binary").hint("merge"), "class").select("key", "i", "j", "class", "sketch")
    edges, _ = materialize(joined.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "class").mapInArrow(run, "a long, b long").distinct())
    return edges


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """left x right booleans: whether the two sets have at least that Jaccard similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, col, df = np.unique(tokens, return_inverse=True, return_counts=True)
    used = df[col] > 1  # a token of one set is in no intersection
    row, col = row[used], np.unique(col[used], return_inverse=True)[1]
    width = int(col.max()) + 1 if len(col) else 0
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, width, 4096):
        a, b = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(sets), min(4096, width - c)), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        common += m[left] @ m[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common >= threshold * union - 1e-6


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect: at most one for each row."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(left)):
        for j in np.flatnonzero(link[i]):
            a, b = root(int(left[i])), root(int(right[j]))
            if a != b:
                parent[a] = b
                out.append((int(left[i]), int(right[j])))
        if len(out) >= len(left) + len(right):
            break
    return out


def verified(docs: DataFrame, classes: DataFrame, components: DataFrame, join: Join) -> DataFrame:
    """a, b, links: spanning edges of exact links (links null), and counts of rows linked to class a (b null)."""
    spark = docs.sparkSession
    own = components.join(classes.select(F.col("class").alias("node"), "rep", "rep_h", "copies", "n_grams").hint("merge"), "node")
    weight = F.sum(F.col("n_grams") + 4096).over(Window.partitionBy("root").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    placed, placed_path = materialize(own.withColumn("block", F.floor(F.coalesce(weight, F.lit(0)) / join.block_weight).cast("int")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, d, g in gram_sets(batch.column(1), join.n):
                g = (g >> np.uint64(32)).astype("<u4")
                bounds = np.searchsorted(d, np.arange(rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array([g[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.large_binary()).cast(pa.binary())], names=["node", "grams"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    wanted = texts.join(placed.select("node", "rep", "rep_h").hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))).select("node", "text")
    held, held_path = materialize(wanted.mapInArrow(sets, "node long, grams binary").dropDuplicates(["node"]))
    blocks = placed.groupBy("root").agg(F.max("block").alias("last"))
    tasks = placed.join(blocks.hint("merge"), "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    tasks = tasks.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies")
    rows = tasks.join(held.hint("merge"), "node").select("root", "i", "j", "block", "node", "copies", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in grouped(batches, 3):
            block, ids, copies = group.column(3).to_numpy(), group.column(4).to_numpy(), group.column(5).to_numpy()
            own = [np.frombuffer(b, "<u4") for b in group.column(6).to_pylist()]
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            link = _links(own, left, right, join.threshold)
            if i == j:
                np.fill_diagonal(link, False)
            forest = _forest(link, left, right)
            counts = [(left, link @ copies[right])] if i == j else [(left, link @ copies[right]), (right, link.T @ copies[left])]
            a = [int(ids[x]) for x, _ in forest] + [int(ids[x]) for side, _ in counts for x in side]
            b = [int(ids[y]) for _, y in forest] + [None] * sum(len(side) for side, _ in counts)
            n = [None] * len(forest) + [int(x) for _, c in counts for x in c]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

    out, _ = materialize(rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long, links long"))
    drop_scratch(spark, placed_path, held_path)
    return out


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, h, class_id (least doc_id of those it is connected to by links, itself included), copy_of (least doc_id with
    the same set of grams), n_links (other rows linked to it directly, copies included) of every row."""
    spark = docs.sparkSession
    rows, _ = materialize(sketches(docs, join))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    classes = rows.filter("class is not null").groupBy("class").agg(first.alias("f"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"), F.max("sketch").alias("sketch"))
    classes, class_path = materialize(classes.select("class", F.col("f.doc_id").alias("rep"), F.col("f.h").alias("rep_h"), "copies", "n_grams", "sketch"))
    found, found_path = materialize(connected_components(candidate_edges(classes, join)))
    checked = verified(docs, classes, found, join)
    groups = connected_components(checked.filter("b is not null").select("a", "b"))
    degree = checked.filter("links is not null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    light = classes.select("class", "rep", "copies")
    full = light.join(groups.withColumnRenamed("node", "class").hint("merge"), "class", "left").join(degree.hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    full, _ = materialize(full)
    least = full.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_class = full.join(least.hint("merge"), "root").select("class", "class_id", F.col("rep").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # copies of one text may be a third of all rows: the join is salted on the rows' side and its small side repeated
    salts = 16
    salted = rows.select("doc_id", "h", "class", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    repeated = by_class.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = salted.filter("class is not null").join(repeated.hint("merge"), ["class", "salt"]).select("doc_id", "h", "class_id", "copy_of", "n_links")
    alone = rows.filter("class is null").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    drop_scratch(spark, found_path, class_path)
    return out.unionByName(alone)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row of least doc_id, with its columns; rows without words all stay, once each."""
    own, back = shielded(docs, "_id", "_h", "_text_h")
    kept = near_duplicates(own).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    keyed = own.withColumn("_text_h", F.xxhash64("text"))
    left = keyed.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_h") == F.col("_h")), "left_semi")
    return left.dropDuplicates(["doc_id", "_text_h"]).select(*back)


def op1_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("h")
