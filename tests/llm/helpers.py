"""Rows that hold every awkward case, and small brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _uid string, size string, h string, class string, part string, n_email int"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def edited(text: str, seed: int, share: float = 0.06) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 10**6)}" for w in text.split(" "))


def awkward(extra=()):
    """Documents with nulls in any column, empty and very long texts, copies, near copies, repeated rows and equal doc_ids."""
    base = [prose(i, 60 + 40 * i) for i in range(6)]
    long = prose(99, 60_000)
    texts = [*base, base[0], edited(base[1], 1), edited(base[1], 2), edited(base[3], 3), None, "", "   \n\t ", "one", "two words", "ünï cödé 名前 😀 text", long, long, "\n".join([base[2]] * 3), base[4][: len(base[4]) // 2]]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1]]  # repeated rows
    rows += [(3, prose(500, 80), "en", "s1", None), (None, prose(501, 90), None, None, None), (None, base[5], "en", "s2", None)]  # equal and null ids
    rows += [(100 + i, t, "en", "s9", len(t)) for i, t in enumerate(extra)]
    return [(*r, 7, "u", "z", "q", "c", "p", 5) for r in rows]


def words(text):
    return (text or "").encode("utf-8", "surrogatepass").split()
