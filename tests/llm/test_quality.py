from collections import Counter

import duckdb
from helpers import words

from sparkloom.llm.quality import NAMES, OP6_SQL, QualityRules, base_counts, op6_distribution_divergence, quality_stage, score_quality


def brute_base(text):
    text = text or ""
    w = words(text)
    chars = sum(len(x.decode()) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return chars, symbols, dup, len(covered)


def test_base_counts(docs):
    for t in [*(r.text for r in docs.collect()), "a b c a b c", "a a a a a", "x\n\nx\n \n \ny", "# # |", "a b c d a b c d e a b"]:
        assert base_counts(t or "", words(t)) == brute_base(t)


def test_awkward_rows(docs):
    got = score_quality(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        chars, symbols, dup, rep = brute_base(r.text)
        n = len(words(r.text))
        failed = n < 50 or 100 * rep > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, rep, failed)
        assert not (failed and r.kept)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(OP6_SQL)
    names = [c[0] for c in want.description]
    got = op6_distribution_divergence(spark, sf_dir).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_divergent_documents_go_and_clean_ones_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = spark.createDataFrame([(10**6, " ".join(f"{i}{i % 7}%$" for i in range(300)), "en", "x", 1), (10**6 + 1, " ".join("QZXW KJV PFG"[i % 12] * (1 + i % 5) + str(i) for i in range(200)), "en", "x", 1)], docs.schema)
    got = {r.doc_id: r for r in score_quality(docs.unionByName(junk)).collect()}
    assert not got[10**6].kept and not got[10**6 + 1].kept and not got[10**6].base_failed
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [r for d, r in got.items() if labels.get(d) == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_stage(docs, nothing):
    kept = quality_stage(None, docs, "")
    assert kept.columns == docs.columns and {r.n_words for r in kept.collect()} == {7}
    assert quality_stage(None, nothing, "").count() == 0 and NAMES[0] == "n_words"


def test_rare_languages_are_judged_by_their_own(spark, docs):
    """However few references are sent to every task, verdicts and distances are the same; '*' is a language like any other."""
    rows = [(i, " ".join([f"word{i % 5} other thing"] * 20 + [f"x{i}"] * (i % 9)) if i % 7 else None, f"l{i % 5}" if i % 5 else "*") for i in range(40)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(docs.select("doc_id", "text", "lang"))
    key = lambda r: (repr(r.doc_id), r.text or "", r.lang or "", r.n_words, r.kept, r.char_distance is None or round(r.char_distance, 12), r.word_distance is None or round(r.word_distance, 12))
    all_near, few = (sorted(map(key, score_quality(own, QualityRules(max_languages=n)).collect())) for n in (200, 2))
    assert all_near == few and len(few) == own.count() and {r[2] for r in few} == {"*", "l1", "l2", "l3", "l4", "en", "de", ""}


def test_labelled_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 0").select("doc_id").distinct()
    junk = score_quality(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").collect()
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)
