from collections import Counter, defaultdict

import numpy as np
from helpers import prose, words

from sparkloom.llm.mixing import Mix, _source_key, mix_documents, permuted, settled, taken_words


def targets(sizes, weights=(5, 2, 1), total=1.5):
    """Reshared again and again, as it would be by hand."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = total * sum(sizes.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(df, rows):
    got = df.collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets(sizes)
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    by = Counter((i, len(words(t)), s) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(x.words for x in r.by_shard)
        source = next(s for (i, n, s) in by if i == r.doc_id and n == r["size"] and sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6)
        taken[source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6, (s, taken[s], t)


def test_awkward_rows(docs):
    check(taken_words(docs), [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_many_sources_and_reruns(spark):
    rows = [(i, prose(i, 20 + i % 90), f"s{i % 11}" if i % 3 else "hot") for i in range(500)] + [(900, "one", "tiny"), (901, "", "none"), (902, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = taken_words(df), taken_words(df.repartition(7))
    check(first, rows)
    assert plain(first) == plain(again)


def plain(df):
    return Counter((r.doc_id, r["size"], r.source_size, r.target, r.taken, tuple((x.shard, x.words) for x in r.by_shard)) for r in df.collect())


def brute(rows, mix):
    """doc_id -> words taken, slot by slot and word by word: rows are (doc_id, text, source) with distinct doc_ids."""
    want, out = targets(Counter({s: sum(len(words(t)) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})), Counter()
    for rank, source in enumerate(sorted(want, key=lambda s: (s is None, s or ""))):
        owner = [i for i, t, s in sorted(rows) if s == source for _ in words(t)]
        blocks = [owner[k : k + mix.block_words] for k in range(0, len(owner), mix.block_words)]
        left, j = int(want[source] + 0.5), 0
        while left:
            block = blocks[permuted(np.array([j % len(blocks)]), len(blocks), _source_key(rank, mix))[0]][:left]
            out.update(block)
            left, j = left - len(block), j + 1
    return out


def test_taken_against_brute_force(spark):
    """Also with blocks longer than a source, where the short last block comes early in the order, and with blocks of one word."""
    rows = [(i, prose(i, 1 + (i * 37) % 90), f"s{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for mix in (Mix(), Mix(block_words=7), Mix(block_words=64, seed=3), Mix(block_words=1)):
        got = {r.doc_id: r.taken for r in taken_words(df, mix).collect()}
        assert +Counter(got) == brute(rows, mix)


def test_draws_decide_the_shards(spark):
    rows = [(i, prose(i, 60), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")

    def by_shard(mix):
        out = defaultdict(Counter)
        for r in taken_words(df, mix).collect():
            for x in r.by_shard:
                out[x.shard][rows[r.doc_id][2]] += x.words
        return out

    base = by_shard(Mix(block_words=16, shards=8))
    assert set(base) == set(range(8)) and by_shard(Mix(block_words=16, shards=8)) == base
    assert by_shard(Mix(block_words=16, shards=8, seed=1)) != base and set(by_shard(Mix(block_words=16, shards=3))) == {0, 1, 2}
    total = sum(sum(c.values()) for c in base.values())
    for c in base.values():
        assert abs(sum(c.values()) - total / 8) < 0.15 * total / 8  # a shard has its number of slots, but for what is settled
        for s in "s0", "s1", "s2":
            share = sum(x[s] for x in base.values()) / total
            assert abs(c[s] / sum(c.values()) - share) < 5 * (share * (1 - share) / (total / 8 / 16)) ** 0.5
    mixed = Counter()
    for r in mix_documents(df, Mix(block_words=16, shards=8), shards=True).collect():
        mixed[r.shard, r.source] += len(words(r.text))
    assert mixed == Counter({(k, s): n for k, c in base.items() for s, n in c.items()})


def test_settling():
    rng = np.random.default_rng(1)
    for _ in range(200):
        drawn, slots = rng.integers(0, 9, 5), int(rng.integers(0, 40))
        out = settled(drawn, slots, 3, Mix())
        assert out.sum() == slots and (out >= 0).all() and ((out <= drawn).all() or (out >= drawn).all())


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4096):
        p = permuted(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n)) and permuted(p, n, 5, back=True).tolist() == list(range(n))
    assert permuted(np.arange(100), 100, 1).tolist() != permuted(np.arange(100), 100, 2).tolist()


def test_documents_hold_the_words_taken(docs):
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    got, want = Counter(), Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] += len(words(r.text))
    for r in taken_words(docs).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_every_word_before_any_repeat(spark):
    """No word is used a second time while another of its source is unused."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), "ab"[i % 2]) for i in range(40)]
    used = Counter()
    for r in mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), Mix(block_words=8)).collect():
        used.update(r.text.split())
    for s in (0, 1):
        counts = {used[f"w{i}x{k}"] for i in range(40) if i % 2 == s for k in range(50)}
        assert max(counts) - min(counts) <= 1


def test_empty(nothing):
    assert taken_words(nothing).count() == 0 and mix_documents(nothing).count() == 0
