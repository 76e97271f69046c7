import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from helpers import prose

from sparkloom.llm.substrings import Repeats, RunIndex, _repeated_here, _send, _slices, remove_repeats, repeated, suffix_array


def brute(rows, length=50):
    first = {}
    data = [((1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            first[g] = min(first.get(g, 1 << 64), i)
    out = []
    for (doc_id, _), (i, b) in zip(rows, data):
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                m[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((doc_id, len(b), sum(m), spans, hashlib.sha256(bytes(c for c, x in zip(b, m) if not x)).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_awkward_rows(docs):
    assert got(remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert got(remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == brute([(r["doc_id"], r["text"]) for r in t])


def test_runs_periods_and_borders(spark):
    """Repeats of exactly 49, 50 and 51 bytes, long runs of one byte, periodic texts, and small slices, buckets and chunks."""
    rng = random.Random(3)
    p = prose(1, 300)
    texts = ["a" * 500, "a" * 49, "a" * 50, "b" + "a" * 120 + "c", "ab" * 200, "abc" * 100, "xy" + "abc" * 30]
    for k in (49, 50, 51, 52, 80, 200):
        at = rng.randint(0, 300)
        texts.append(prose(100 + k, 20) + "|" + p[at : at + k] + "|" + prose(200 + k, 20))
    texts += [p, p[:700], p[300:900] + "!" + p[300:900], "é" * 60, "x" + "é" * 60, "é" * 24 + "e" + "é" * 24]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[9]), (None, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for params in (Repeats(), Repeats(slice_bytes=700, bucket_bytes=300, chunk_bytes=200), Repeats(gram=37)):
        assert got(remove_repeats(df, params)) == brute(rows)


def test_equal_hashes_of_unlike_bytes_are_told_apart():
    data = np.frombuffer(b"abcdefgh" + b"abcdefgh" + b"abcdefgX" + b"abcd", np.uint8)
    one = np.ones(4, np.uint64)
    got = _repeated_here(data, one, one, np.array([3, 1, 5, 7]), np.array([0, 8, 16, 24]), np.array([8, 8, 8, 4]))
    assert got.tolist() == [True, False, False, False]


def test_a_passage_in_every_document_is_sent_once_a_slice(spark):
    passage = prose(9, 60)
    rows = [(i, prose(100 + i, 5) + " | " + passage + " | " + prose(300 + i, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(remove_repeats(df)) == brute(rows)
    sent = _send(_slices(df, Repeats()), 4, Repeats()).filter("bucket >= 0").collect()
    entries = sum(len(r["size"]) for r in sent)
    alone = sum(len(r["size"]) for r in _send(_slices(df, Repeats(slice_bytes=1)), 4, Repeats()).filter("bucket >= 0").collect())
    assert entries < 0.6 * alone


def test_index_against_sorting():
    rng = np.random.default_rng(5)
    for _ in range(30):
        parts = [rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8).tobytes() for _ in range(6)]
        text = np.frombuffer(b"".join(x + b"\xff" for x in parts), np.uint8)
        ends = [i for i, c in enumerate(text) if c == 255]
        key = lambda i: [(1, int(c)) if c != 255 else (0, k + i) for k, c in enumerate(text[i : next(e for e in ends if e >= i) + 1])]
        # a separator is smaller than any byte only among separators; as bytes go, it is placed by its own order
        sa = suffix_array(text)
        assert sorted(sa.tolist()) == list(range(len(text)))
        plain = [bytes(text[i : next(e for e in ends if e >= i)]) for i in sa]
        assert plain == sorted(plain)
        lcp = RunIndex.build(text, sa).plcp(text)[sa]
        want = [0] + [next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(plain, plain[1:])]
        assert lcp.tolist() == want and key(0)


def test_repeated_needs_an_earlier_document():
    text = np.frombuffer(b"abcdefgh\xffabcdefgh\xffxbcdefg\xff", np.uint8)
    doc = np.array([2] * 9 + [1] * 9 + [3] * 8)
    assert sorted(repeated(text, doc, 5).tolist()) == [0, 1, 2, 3, 19, 20]


def test_kept_text(spark):
    a, b = prose(1, 40), prose(2, 40)
    rows = {r.doc_id: r.kept for r in remove_repeats(spark.createDataFrame([(1, a), (2, b + "#" + a)], "doc_id long, text string"), with_text=True).collect()}
    assert rows[1] == a.encode() and rows[2] == (b + "#").encode()


def test_empty(nothing):
    assert remove_repeats(nothing).count() == 0
