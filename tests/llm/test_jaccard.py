from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from helpers import SCHEMA, awkward, edited, prose

from sparkloom.llm.components import connected_components
from sparkloom.llm.jaccard import Join, _meeting, candidate_edges, jaccard_stage, near_duplicates, shared_leaves, split_bucket


def brute(rows, n=3, threshold=0.5):
    """(class_id, n_links) of rows (doc_id, text), by comparing all of them."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(low).split()
        k = min(n, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    links = [{j for j, b in enumerate(sets) if j != i and a and b and len(a & b) / len(a | b) >= threshold} for i, a in enumerate(sets)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(known, default=None), len(links[i])))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_awkward_rows(docs):
    assert got(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert got(near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == brute([(r["doc_id"], r["text"]) for r in t])


def test_large_group_in_many_blocks(spark):
    """A group of near copies, split over blocks of a few sets, has the links that comparing all of them finds."""
    base = prose(7, 120)
    rows = [(i, edited(base, i, 0.08)) for i in range(90)] + [(200 + i, prose(i + 50, 100)) for i in range(60)] + [(300 + i, base) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, want = got(near_duplicates(df, Join(block_weight=40_000))), brute(rows)
    assert found == want


def test_split_bucket_finds_what_is_there():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 256, (400, 64)).astype(np.uint8)
    sketch[:150] = sketch[0]
    sketch[:150][rng.random((150, 64)) < 0.2] = 9
    edges = [np.concatenate(x) for x in zip(*split_bucket(np.arange(400), sketch, Join()))]
    assert set(edges[0]) | set(edges[1]) >= set(range(150))
    assert max(edges[0]) < 150


@pytest.mark.parametrize("similarity", [0.5, 0.55, 0.6])
def test_large_bucket_loses_no_pair(similarity):
    """Pairs at and just over the threshold in a bucket of 4,000, whose rows share hot tokens, are met as in a small one."""
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 256, (4000, 64)).astype(np.uint8)
    hot = rng.random((4000, 64)) < 0.2
    sketch[hot] = rng.integers(0, 4, int(hot.sum()))
    same = rng.random((2000, 64)) < similarity
    sketch[1::2][same] = sketch[::2][same]
    met = {frozenset((int(a), int(b))) for x, y in split_bucket(np.arange(4000), sketch, Join()) for a, b in zip(x, y)}
    pairs = [frozenset((2 * i, 2 * i + 1)) for i in range(2000)]
    assert all(p in met for p, agree in zip(pairs, (sketch[::2] == sketch[1::2]).sum(1)) if agree >= 23)
    assert sum(p in met for p in pairs) >= 0.98 * len(pairs)


def pairs_with_hot_tokens(n, similarity, rng, hot=0.25):
    """Sketches of n // 2 pairs that agree at each place with the given chance. A quarter of the pairs share a passage: 20 of
    their 64 tokens are the same in all of these, too few to make others a candidate."""
    sketch = rng.integers(0, 1 << 32, (n, 64), dtype=np.uint64).astype("<u4")
    same = rng.random((n // 2, 64)) < similarity
    sketch[1::2][same] = sketch[::2][same]
    share = np.repeat(np.arange(n // 2) < hot * (n // 2), 2)
    sketch[np.ix_(share, np.arange(20))] = 7
    return sketch, share[::2]


@pytest.mark.parametrize("small", [16, 128, 4096])
def test_recall_does_not_depend_on_the_size_of_buckets(spark, small):
    """Pairs at the threshold, among rows that share a passage and so meet in buckets of hundreds, which are split and, where
    that doesn't help, compared in blocks: those that their sketches tell are found as often as promised."""
    rng = np.random.default_rng(6)
    sketch, hot = pairs_with_hot_tokens(6000, 0.5, rng)
    cold = np.arange(64) >= 20
    agree = (sketch[::2, cold] == sketch[1::2, cold]).sum(1)
    want = [i for i in range(3000) if (12 if hot[i] else 22) <= agree[i]]  # at the threshold or just over, hot tokens included
    classes = spark.createDataFrame([(i + 1, r.tobytes()) for i, r in enumerate(sketch)], "class long, sketch binary").repartition(3)
    roots = {r.node: r.root for r in connected_components(candidate_edges(classes, Join(small=small))).collect()}
    met = np.array([roots.get(2 * i + 1) is not None and roots.get(2 * i + 1) == roots.get(2 * i + 2) for i in want])
    for own in (hot[want], ~hot[want]):
        assert own.sum() > 100 and met[own].mean() >= 0.96, met[own].mean()
    assert len(set(roots.values())) >= 0.95 * met.sum()  # and others aren't candidates


def test_trees_are_as_many_as_the_recall_needs():
    j = Join()
    assert 1 - (1 - _meeting(0.5, 3) * j.deep_recall) ** j.runs() >= j.target_recall
    assert 1 - (1 - _meeting(0.5, j.deep)) ** j.deep_runs() >= j.deep_recall


def test_blocks_of_shared_leaves(spark):
    """Keys of one row go, and every `small` rows of a key are a block, also over batches."""
    rows = [(k, 1000 * k + c) for k, n in enumerate([1, 2, 5, 1, 23, 1, 1, 7]) for c in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = shared_leaves(spark.createDataFrame(rows, "key long, class long"), Join(small=3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.key, r["class"], r.block) for r in got) == [(k, c, c % 1000 // 3) for k, c in rows if k in (1, 2, 4, 7)]


def test_whole_table_with_split_buckets(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert got(near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Join(small=2))) == brute([(r["doc_id"], r["text"]) for r in t])


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (20, 3)] + [(100, 100 + i) for i in range(1, 50)] + [(i, i + 1) for i in range(200, 240)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[x] for x in (1, 2, 3, 20)} == {1} and {roots[x] for x in (7, 8, 9)} == {7}
    assert {roots[x] for x in range(100, 150)} == {100} and {roots[x] for x in range(200, 241)} == {200} and 5 not in roots


def test_empty(nothing):
    assert near_duplicates(nothing).count() == 0 and jaccard_stage(None, nothing, "").count() == 0


def test_stage(spark, docs):
    kept = jaccard_stage(spark, docs, "")
    assert kept.columns == docs.columns
    groups = {(r.doc_id, r.class_id) for r in near_duplicates(docs).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {c for d, c in groups if c is not None and d == c}
    assert ids.count(1) == 1 and ids.count(3) == 2  # repeated rows once, another text of the same id stays
    assert awkward() and SCHEMA
