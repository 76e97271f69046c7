import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import prose
from tokenizers import Tokenizer

from sparkloom.llm.packing import _encoder, pack, plan_packing


def brute(rows, capacity):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return Counter(out)


def check(df, rows, capacity=2048):
    got = df.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(rows, capacity)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r.length for r in got)


def test_awkward_rows(docs):
    n, total = check(pack(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= total / 2048 + 2


def test_small_capacity(spark):
    rows = [(i, prose(i, i % 37)) for i in range(300)] + [(7, "<|endoftext|> a  b\n\n c")]
    n, total = check(pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), capacity=64), rows, 64)
    assert n <= 1.05 * total / 64 + 1


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([5, 16, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(0, 30))}
        used = Counter()
        for lengths, n in plan_packing(counts, capacity):
            assert 0 < sum(lengths) <= capacity and n > 0
            for x in lengths:
                used[x] += n
        assert used == counts


def test_complements_fill_exactly():
    assert sorted(n for _, n in plan_packing({60: 3, 40: 3}, 100)) == [3]
    assert sum(n for _, n in plan_packing({70: 2, 20: 2, 10: 2, 85: 1, 5: 3}, 100)) == 3


@pytest.mark.parametrize("as_text", [False, True])
def test_same_ids_as_the_tokenizers_library(as_text):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = as_text
    own = _encoder("byte_bpe_50k", as_text)
    points = [c for c in range(0, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}b  {chr(c)} '{chr(c)}s\n" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "'s", "1", "<|", "|>", "é", "名"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    for text, e in zip(texts, tk.encode_batch(texts, add_special_tokens=False)):
        assert own(text).tolist() == e.ids


def test_empty(nothing):
    assert pack(nothing).count() == 0
