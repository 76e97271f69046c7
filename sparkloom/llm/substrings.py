"""Repeated-substring removal with a run-length index.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id is removed.

Texts are laid end to end in slices. Each window of `length` bytes has an anchor, its run of `gram` bytes with the least
hash; windows with the same anchor lie next to each other, and their union (a span, under twice the window's length) is
sent to the bucket of the anchor's hash as hashes, not text. Equal windows have equal anchors, so they meet there.
Of equal spans all but that of the least document are removed whole: within a slice, by comparing their bytes, before anything
is sent, so that a passage which very many documents share is sent once a slice; between slices, by 112 bits of hash (anchor
and span; among 5e12 spans, as 100 TB have, one wrong pair is expected in 4e8 runs). Only where an anchor has different spans
in different documents, one span of each kind is fetched as text. Over these, bucket by bucket and in chunks of bounded size, a
run-compressed Burrows-Wheeler transform is built with suffix samples at run ends; matching statistics against the
preceding suffix are compared at run heads only and streamed in text order from there, each one less than the one before;
runs of suffixes that match for `length` bytes are marked beyond their least document.

Edge cases: a null text is empty; texts shorter than `length` lose nothing; rows with equal doc_id don't count as earlier to
one another, so repeated rows are judged alike; a null doc_id is later than any other; an empty table gives an empty result;
columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, table, utf8
from .hashing import Slice
from .jaccard import grouped

_LATEST = np.iinfo(np.int64).max
_SEPARATOR = 255  # in no UTF-8 text


@dataclass(frozen=True)
class Repeats:
    """bucket_bytes: text whose anchors one bucket takes, on average; chunk_bytes: span text that one index holds, unless
    the spans of a single anchor have more."""

    length: int = 50
    gram: int = 20
    slice_bytes: int = 1 << 21
    bucket_bytes: int = 1 << 23
    chunk_bytes: int = 1 << 20


def _slices(docs: DataFrame, p: Repeats) -> DataFrame:
    """slice, ids, ends, data: runs of whole texts; ids and ends as packed integers, a null id as -2**63."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size, seq, part = 0, 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            nonlocal size, seq
            ids = np.array([i for i, _ in held], "<i8").tobytes()
            ends = np.cumsum([len(d) for _, d in held], dtype="<i8").tobytes()
            data = b"".join(d for _, d in held)
            batch = pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([ids], pa.binary()), pa.array([ends], pa.binary()), pa.array([data], pa.binary())], names=["slice", "ids", "ends", "data"])
            held.clear()
            size, seq = 0, seq + 1
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = utf8(text)
                if held and size + len(data) > p.slice_bytes:
                    yield out()
                held.append((-(1 << 63) if doc_id is None else doc_id, data))
                size += len(data)
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "slice long, ids binary, ends binary, data binary")


def _unpack(ids: bytes, ends: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids as ordered (null last), offsets, and bytes of a slice."""
    i = np.frombuffer(ids, "<i8")
    return np.where(i == -(1 << 63), _LATEST, i), np.concatenate([[0], np.frombuffer(ends, "<i8")]), np.frombuffer(data, np.uint8)


def anchors(data: np.ndarray, offsets: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, span hash, text number, begin, end) of every span; the windows of a span begin at begin .. end - length."""
    z = np.zeros(0, np.int64)
    if len(data) < p.length:
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    s = Slice(0, data, offsets)
    sums = s.prefix(data)
    cur, size, w = s.gram_hash(sums, p.gram), 1, p.length - p.gram + 1
    while size * 2 <= w:
        cur, size = np.minimum(cur[:-size], cur[size:]), size * 2
    least = np.minimum(cur[: len(cur) - (w - size)], cur[w - size :]) if w > size else cur
    lens = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int8)  # window begins within one text
    ok = lens >= p.length
    inside[offsets[:-1][ok]] += 1
    inside[offsets[1:][ok] - p.length + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    if not len(at):
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    h = least[at]
    first = np.ones(len(at), bool)
    first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
    f = np.flatnonzero(first)
    # a text's last window and the next text's first are neighbours in `at` only if no place lies between
    begin, last = at[f], at[np.append(f[1:], len(at)) - 1]
    # a run longer than the window span of one anchor is cut (the same gram again and again): spans stay under 2 * length
    most = w
    n = (last - begin) // most + 1
    if (n > 1).any():
        k = np.repeat(np.arange(len(begin)), n)
        j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        begin, last, h = begin[k] + j * most, np.minimum(begin[k] + (j + 1) * most - 1, last[k]), h[f][k]
    else:
        h = h[f]
    end = last + p.length
    doc = np.searchsorted(offsets, begin, "right") - 1
    return h, s.run_hash(sums, begin, end), doc, begin, end


def _repeated_here(data: np.ndarray, h: np.ndarray, span: np.ndarray, doc: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of a slice are, byte by byte, one that the slice has in a smaller document."""
    order = np.lexsort((doc, span, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (span[order][1:] != span[order][:-1])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    out = np.zeros(len(order), bool)
    late = np.flatnonzero((doc[order] > doc[first]) & (size[order] == size[first]))
    for k in range(0, len(late), 1 << 16):
        own, other = order[late[k : k + (1 << 16)]], first[late[k : k + (1 << 16)]]
        same = np.ones(len(own), bool)
        for at in range(int(size[own].max())):
            same &= (at >= size[own]) | (data[np.minimum(begin[own] + at, len(data) - 1)] == data[np.minimum(begin[other] + at, len(data) - 1)])
        out[own[same]] = True
    return out


def _send(slices: DataFrame, buckets: int, p: Repeats) -> DataFrame:
    """bucket, slice and the columns of its entries, one row for each bucket that a slice has spans for. A row with a bucket
    below 0 has the spans that are judged already: they repeat others of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, ends, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, offsets, data = _unpack(ids, ends, data)
                h, span, doc, begin, end = anchors(data, offsets, p)
                doc, size = ids[doc], end - begin
                gone = _repeated_here(data, h, span, doc, begin, size)
                rows = [(-1 - int(number) % buckets, number, None, None, None, begin[gone].astype("<u4").tobytes(), size[gone].astype(np.uint8).tobytes())] if gone.any() else []
                h, span, doc, begin, size = (x[~gone] for x in (h, span, doc, begin, size))
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((h, bucket))
                h, span, doc, begin, size, bucket = (x[order] for x in (h, span, doc, begin, size, bucket))
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                rows += [(int(b[0]), number, (a >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), s.astype("<u8").tobytes(), d.astype("<i8").tobytes(), x.astype("<u4").tobytes(), y.astype(np.uint8).tobytes())
                         for b, a, s, d, x, y in zip(*(np.split(c, cuts) for c in (bucket, h, span, doc, begin, size))) if len(b)]
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "slice", "anchor", "span", "doc", "begin", "size"])

    return slices.mapInArrow(run, "bucket int, slice long, anchor binary, span binary, doc binary, begin binary, size binary")


def _six(b: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(b), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8")


def _judge(sent: DataFrame) -> DataFrame:
    """slice, bucket, fetch, anchor, doc, begin, size: fetch false are spans to remove whole, true those whose text is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in grouped(batches, 1):
            if bucket < 0:
                for part in group.select(["slice", "bucket", "begin", "size"]).to_batches(max_chunksize=512):
                    none = pa.nulls(part.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([False] * part.num_rows), none, none, part.column(2), part.column(3)], names=["slice", "bucket", "fetch", "anchor", "doc", "begin", "size"])
                continue
            cols = {c: group.column(c).to_pylist() for c in ("anchor", "span", "doc", "begin", "size")}
            count = np.array([len(x) for x in cols["size"]])
            slice_ = np.repeat(group.column("slice").to_numpy(), count)
            anchor, span = _six(cols["anchor"]), np.frombuffer(b"".join(cols["span"]), "<u8")
            doc, begin, size = (np.frombuffer(b"".join(cols[c]), t) for c, t in (("doc", "<i8"), ("begin", "<u4"), ("size", np.uint8)))
            del cols, group
            order = np.lexsort((doc, span, anchor))
            a, s, d = anchor[order], span[order], doc[order]
            new_a = np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_s = new_a.copy()
            new_s[1:] |= s[1:] != s[:-1]
            at_a, at_s = np.flatnonzero(new_a), np.flatnonzero(new_s)
            kind = np.cumsum(new_s) - 1
            remove = d > d[at_s][kind]
            group_of = np.cumsum(new_a) - 1
            kinds = np.bincount(group_of, new_s)
            least, most = np.minimum.reduceat(d, at_a), np.maximum.reduceat(d, at_a)
            # ties of the least document: each is judged, but one text of them is enough to fetch for all in one slice's place
            fetch = ~remove & ((kinds > 1) & (least < most))[group_of]
            for flag, mask in ((False, remove), (True, fetch)):
                own = order[mask]
                own = own[np.argsort(slice_[own], kind="stable")]
                cuts = np.flatnonzero(np.diff(slice_[own])) + 1
                parts = [x for x in np.split(own, cuts) if len(x)]
                for k in range(0, len(parts), 512):
                    chunk = parts[k : k + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(slice_[x[0]]) for x in chunk]), pa.array([int(bucket)] * len(chunk), pa.int32()), pa.array([flag] * len(chunk)), *(pa.array([v[x].tobytes() for x in chunk] if flag or c > 1 else [None] * len(chunk), pa.binary()) for c, v in enumerate((anchor, doc, begin, size)))],
                        names=["slice", "bucket", "fetch", "anchor", "doc", "begin", "size"],
                    )

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "slice long, bucket int, fetch boolean, anchor binary, doc binary, begin binary, size binary")


def _fetch(slices: DataFrame, judged: DataFrame) -> DataFrame:
    """bucket, slice and the wanted spans with their text."""
    wanted = judged.filter("fetch").groupBy("slice").agg(F.collect_list(F.struct("bucket", "anchor", "doc", "begin", "size")).alias("w"))  # within one slice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, wants in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = []
                for w in wants:
                    begin, size = np.frombuffer(w["begin"], "<u4").astype(np.int64), np.frombuffer(w["size"], np.uint8)
                    text.append(b"".join([data[b : b + n] for b, n in zip(begin.tolist(), size.tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["bucket"] for w in wants], pa.int32()), pa.array([number] * len(wants), pa.int64()), *(pa.array([w[c] for w in wants], pa.binary()) for c in ("anchor", "doc", "begin", "size")), pa.array(text, pa.binary())],
                    names=["bucket", "slice", "anchor", "doc", "begin", "size", "text"],
                )

    joined = slices.join(wanted.hint("merge"), "slice").select("slice", "data", "w")
    return joined.mapInArrow(run, "bucket int, slice long, anchor binary, doc binary, begin binary, size binary, text binary")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order. Every separator is a symbol of its own, smaller the earlier, so no two suffixes tie and
    none is compared beyond its separator. Eight bytes are compared first, then ranks of twice that length again and again."""
    n = len(text)
    padded = np.concatenate([text, np.full(8, _SEPARATOR, np.uint8)])
    is_sep = padded == _SEPARATOR
    following = np.full(n + 8, n + 8, np.int64)
    where = np.flatnonzero(is_sep)
    following = where[np.searchsorted(where, np.arange(n))]  # the separator that ends each suffix
    room = np.minimum(following - np.arange(n), 8)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        inside = room > k
        key |= np.where(inside, padded[k : n + k].astype(np.uint64) + np.uint64(1), 0).astype(np.uint64) << np.uint64(56 - 8 * k) if k else np.where(inside, padded[:n].astype(np.uint64) + np.uint64(1), 0).astype(np.uint64) << np.uint64(56)
    tie = np.where(room < 8, following, 0)
    order = np.lexsort((tie, key))
    k, t = key[order], tie[order]
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    h = 8
    while not new.all():
        # only suffixes that still tie are sorted again, each within its tie
        tied = ~new
        tied[:-1] |= ~new[1:]
        pos = np.flatnonzero(tied)
        own = order[pos]
        after = rank[np.minimum(own + h, n - 1)]
        sub = np.lexsort((after, rank[own]))
        own = own[sub]
        order[pos] = own
        r, a = rank[own], after[sub]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1])
        new[pos] = fresh
        rank[order] = np.cumsum(new) - 1
        h *= 2
    return order


@dataclass
class RunIndex:
    """Run-compressed Burrows-Wheeler transform: heads (first row of each run), symbols, and the suffixes at run heads and
    ends. From these alone plcp() streams, in text order, how far each suffix matches the one before it in suffix order."""

    heads: np.ndarray
    symbols: np.ndarray
    head_suffix: np.ndarray
    tail_suffix: np.ndarray
    size: int

    @classmethod
    def build(cls, text: np.ndarray, sa: np.ndarray) -> RunIndex:
        bwt = text[sa - 1]  # the row of the first suffix gets the last symbol
        change = np.ones(len(sa), bool)
        change[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == _SEPARATOR)  # separators are symbols of their own
        heads = np.flatnonzero(change)
        return cls(heads, bwt[heads], sa[heads], sa[np.append(heads[1:], len(sa)) - 1], len(sa))

    def plcp(self, text: np.ndarray) -> np.ndarray:
        """Within a run the suffix one to the left matches its neighbour one symbol further; so only heads are compared."""
        before = np.append(-1, self.tail_suffix[:-1])  # the suffix before a run's head is the last run's end
        x, y = self.head_suffix, before
        match = np.zeros(len(x), np.int64)
        live = np.flatnonzero(y >= 0)
        n = self.size
        while len(live):
            i, j = x[live] + match[live], y[live] + match[live]
            ok = (i < n) & (j < n)
            ok[ok] = (text[i[ok]] == text[j[ok]]) & (text[i[ok]] != _SEPARATOR)
            live = live[ok]
            match[live] += 1
        order = np.argsort(x)
        at, own = x[order], match[order]
        k = np.searchsorted(at, np.arange(n), "right") - 1
        return np.maximum(own[k] - (np.arange(n) - at[k]), 0) if len(at) and at[0] == 0 else np.where(k >= 0, np.maximum(own[k] - (np.arange(n) - at[k]), 0), 0)


def repeated(text: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Places of text (spans, each followed by a separator) whose `length` bytes also stand in a span of a smaller document."""
    sa = suffix_array(text)
    match = RunIndex.build(text, sa).plcp(text)[sa]
    group = np.flatnonzero(np.append(True, match[1:] < length)) if len(sa) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(doc[sa], group)
    later = doc[sa] > np.repeat(least, np.diff(np.append(group, len(sa))))
    # a group of one has nothing earlier, so every later suffix matches another for the whole length
    return sa[later]


def _index(fetched: DataFrame, p: Repeats) -> DataFrame:
    """slice, begin, size: runs of bytes to remove, found among the fetched spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in grouped(batches, 1):
            cols = {c: group.column(c).to_pylist() for c in ("anchor", "doc", "begin", "size", "text")}
            count = np.array([len(x) for x in cols["size"]])
            slice_ = np.repeat(group.column("slice").to_numpy(), count)
            anchor, doc, begin, size = (np.frombuffer(b"".join(cols[c]), t) for c, t in (("anchor", "<u8"), ("doc", "<i8"), ("begin", "<u4"), ("size", np.uint8)))
            blob = np.frombuffer(b"".join(cols["text"]), np.uint8)
            del cols, group
            size = size.astype(np.int64)
            start = np.cumsum(size) - size
            order = np.argsort(anchor, kind="stable")
            a = anchor[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            weight = np.add.reduceat(size[order] + 1, first)
            chunk = (np.cumsum(weight) - weight) // p.chunk_bytes
            bounds = np.append(first[np.flatnonzero(np.append(True, np.diff(chunk) > 0))], len(order))
            for lo, hi in zip(bounds, bounds[1:]):
                own = order[lo:hi]
                n = size[own] + 1
                to = np.cumsum(n) - n
                which = np.repeat(np.arange(len(own)), n)
                within = np.arange(len(which)) - to[which]
                text = np.full(len(which), _SEPARATOR, np.uint8)
                body = within < size[own][which]
                text[body] = blob[(start[own][which] + within)[body]]
                at = np.sort(repeated(text, doc[own][which], p.length))
                if not len(at):
                    continue
                # neighbouring places of one span make one run of bytes
                span = which[at]
                cut = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(span) > 0)))
                stop = at[np.append(cut[1:], len(at)) - 1] + p.length
                s = span[cut]
                begin_of = begin[own][s].astype(np.int64) + at[cut] - to[s]
                yield pa.RecordBatch.from_arrays([pa.array(slice_[own][s]), pa.array(begin_of), pa.array(stop - at[cut])], names=["slice", "begin", "size"])

    return fetched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "slice long, begin long, size long")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(slices: DataFrame, whole: DataFrame, parts: DataFrame, with_text: bool) -> DataFrame:
    marks = whole.groupBy("slice").agg(F.collect_list(F.struct("begin", "size")).alias("whole"))  # within one slice
    more = parts.groupBy("slice").agg(F.collect_list(F.struct("begin", "size")).alias("parts"))
    joined = slices.join(marks.hint("merge"), "slice", "left").join(more.hint("merge"), "slice", "left").select("ids", "ends", "data", "whole", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ends, raw, whole, parts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = np.frombuffer(ids, "<i8")
                _, offsets, data = _unpack(ids, ends, raw)
                edge = np.zeros(len(data) + 1, np.int32)
                for m in whole or []:
                    b = np.frombuffer(m["begin"], "<u4").astype(np.int64)
                    np.add.at(edge, b, 1)
                    np.add.at(edge, b + np.frombuffer(m["size"], np.uint8), -1)
                if parts:
                    b = np.array([m["begin"] for m in parts])
                    np.add.at(edge, b, 1)
                    np.add.at(edge, b + np.array([m["size"] for m in parts]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[offsets[1:]] - total[offsets[:-1]]
                rows = []
                for k in range(len(own)):
                    a, b = int(offsets[k]), int(offsets[k + 1])
                    cut = gone[a:b]
                    text = raw[a:b] if not removed[k] else data[a:b][~cut].tobytes()
                    n = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + cut[0]) if removed[k] else 0
                    rows.append((None if own[k] == -(1 << 63) else int(own[k]), b - a, int(removed[k]), n, hashlib.sha256(text).hexdigest(), text if with_text else None))
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _OUT.split(", ")])

    return joined.mapInArrow(run, _OUT)


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (what remains; null without with_text) of every row."""
    spark = docs.sparkSession
    slices, _ = materialize(_slices(docs, p))
    total = slices.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(1, -(-total // p.bucket_bytes))
    judged, _ = materialize(_judge(_send(slices, buckets, p)))
    parts, _ = materialize(_index(_fetch(slices, judged), p))
    return _apply(slices, judged.filter("not fetch").select("slice", "begin", "size"), parts, with_text)


def op5_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
