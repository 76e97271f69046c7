"""Quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are compared with those of its language
(counted over all documents) by Jensen-Shannon distance; short documents are guarded from either test.

Edge cases: a null text counts as empty; a null lang shares the reference of language ''; a language of a single document is
its own reference, so that document is at distance 0; a document without words fails the base rules, and its distances are
null if its language has no words at all; ties among common words go to the smaller word; repeated rows each get their own
verdict; an empty table gives an empty result; columns beyond text and lang are carried, and those named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, materialize, shielded, table, utf8

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punct", "other")
_SPACES = " \t\n\x0b\x0c\r"
_CLASS_OF = np.full(256, 6, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b >= 0x80:
        _CLASS_OF[_b] = 7 if _b < 0xC0 else 6  # continuation bytes aren't characters of their own
    elif _c in _SPACES:
        _CLASS_OF[_b] = 3
    elif _c in SYMBOLS:
        _CLASS_OF[_b] = 4
    elif "a" <= _c <= "z":
        _CLASS_OF[_b] = 0
    elif "A" <= _c <= "Z":
        _CLASS_OF[_b] = 1
    elif "0" <= _c <= "9":
        _CLASS_OF[_b] = 2
    elif 0x21 <= _b < 0x7F:
        _CLASS_OF[_b] = 5


@dataclass(frozen=True)
class QualityRules:
    """max_languages: so many references are sent to every task, those of the languages with the most words; documents of any
    other language are joined to theirs. max_word_distance is 0.025 beyond the farthest document labelled clean of 20,000."""

    common_words: int = 64
    common_share: int = 2000
    max_char_distance: float = 0.30
    max_word_distance: float = 0.48
    min_chars: int = 200
    min_words: int = 50
    max_languages: int = 200


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_CLASS_OF[np.frombuffer(data, np.uint8)], minlength=8)[:7]


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(_SPACES))
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            end = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return chars, symbols, dup, repeat


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits, from 0 to 1, of two histograms with at least one count each."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return math.sqrt(max(0.0, ((p[a] * np.log2(p[a] / m[a])).sum() + (q[b] * np.log2(q[b] / m[b])).sum()) / 2))


_REF = pa.schema([("lang", pa.string()), ("kind", pa.int8()), ("item", pa.binary()), ("n", pa.int64())])
_REF_DDL = "lang string, kind byte, item binary, n long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_REF.types)], schema=_REF)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, Counter], dict[str, np.ndarray]]]:
    """Word counts and class counts by language, of chunks of documents that keep a task's memory bounded."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = utf8(text)
            if lang not in words:
                words[lang], classes[lang] = Counter(), np.zeros(7, np.int64)
            classes[lang] += class_counts(data)
            words[lang].update(data.translate(ASCII_LOWER).split())
        if sum(map(len, words.values())) > 300_000:
            yield words, classes
            words, classes = {}, {}
    yield words, classes


@dataclass
class References:
    """near: language -> (class counts, common words, their counts and last that of all others), of the max_languages
    languages with the most words. far: the same as a table (lang, classes, words, total) for all others; None if there are none."""

    near: dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]
    far: DataFrame | None


def language_references(docs: DataFrame, rules: QualityRules) -> References:
    """Common are the up to common_words most frequent words of a language of which there is at least one in common_share.
    Counts are exact and over every document, in two passes. The first adds up, of each chunk of documents, the words that
    reach half that share within it. What a chunk leaves out is less than half the share of the chunk, so a common word's sum
    reaches the other half: at most 2 * common_share words of a language do, whatever the corpus. The second counts just those.
    Languages beyond max_languages have at most one in max_languages of the words each; theirs are counted by a shuffle."""
    spark = docs.sparkSession
    own = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"))
    half = 2 * rules.common_share

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, classes in _by_language(batches):
            rows = [(lang, 0, b"%d" % k, int(n)) for lang, c in classes.items() for k, n in enumerate(c) if n]
            for lang, c in words.items():
                total = c.total()
                rows.append((lang, 2, b"", total))
                rows += [(lang, 1, w, n) for w, n in c.items() if n * half >= total]
            yield _rows(rows)

    sums, _ = materialize(own.mapInArrow(first, _REF_DDL).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    totals = sums.filter("kind = 2 and n > 0").select("lang", F.col("n").alias("total"))
    total = {r.lang: r.total for r in totals.orderBy(F.desc("total"), "lang").limit(rules.max_languages).collect()}
    known = F.broadcast(spark.createDataFrame(list(total.items()), "lang string, total long"))  # max_languages rows at most
    kept = sums.join(known, "lang")
    out: dict[str, tuple[np.ndarray, list[bytes], list[int]]] = {lang: (np.zeros(7), [], []) for lang in total}
    for r in kept.filter("kind = 0").collect():
        out[r.lang][0][int(bytes(r.item))] = r.n
    likely: dict[str, set[bytes]] = {lang: set() for lang in total}
    for r in kept.filter(f"kind = 1 and n * {half} >= total").select("lang", "item").collect():
        likely[r.lang].add(bytes(r.item))
    shared = spark.sparkContext.broadcast(likely)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = {lang: dict.fromkeys(ws, 0) for lang, ws in shared.value.items()}
        for words, _ in _by_language(batches):
            for lang, c in words.items():
                for w in exact.get(lang, ()):
                    exact[lang][w] += c.get(w, 0)
        yield _rows([(lang, 1, w, n) for lang, ws in exact.items() for w, n in ws.items() if n])

    counts = own.mapInArrow(second, _REF_DDL).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    for r in sorted(counts.collect(), key=lambda r: (-r.n, bytes(r.item))):
        ws, ns = out[r.lang][1:]
        if len(ws) < rules.common_words and r.n * rules.common_share >= total[r.lang]:
            ws.append(bytes(r.item))
            ns.append(r.n)
    near = {lang: (c, w, np.array([*n, total[lang] - sum(n)], float)) for lang, (c, w, n) in out.items()}
    more = len(total) == rules.max_languages and totals.count() > rules.max_languages
    return References(near, _far_references(own, sums, totals, list(total), rules) if more else None)


def _far_references(own: DataFrame, sums: DataFrame, totals: DataFrame, near: list[str], rules: QualityRules) -> DataFrame:
    """lang, classes (counts by class), words (common ones with their counts, most frequent first), total of languages not in near."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _by_language(batches):
            yield _rows([(lang, 1, w, n) for lang, c in words.items() for w, n in c.items()])

    rare = ~F.col("lang").isin(near)
    counts = own.filter(rare).mapInArrow(every, _REF_DDL).groupBy("lang", "item").agg(F.sum("n").alias("n"))
    common = counts.join(totals.hint("merge"), "lang").filter(F.col("n") * rules.common_share >= F.col("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))  # common_share rows of a language at most
    words = common.withColumn("r", place).filter(F.col("r") <= rules.common_words).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "item", "n"))).alias("words"))
    classes = sums.filter(rare & (F.col("kind") == 0)).groupBy("lang").agg(F.collect_list(F.struct("item", "n")).alias("classes"))  # one a class
    full = totals.filter(rare).join(words.hint("merge"), "lang", "left").join(classes.hint("merge"), "lang", "left")
    return materialize(full.select("lang", "classes", F.transform("words", lambda w: F.struct(w["item"].alias("item"), w["n"].alias("n"))).alias("words"), "total"))[0]


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
NAMES = [x.split()[0] for x in OUTPUT.split(", ")]


def score_quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with the base counts, both distances (null under their minimum length) and the verdict."""
    refs = language_references(docs, rules)
    shared = docs.sparkSession.sparkContext.broadcast({lang: (c, {w: i for i, w in enumerate(ws)}, n) for lang, (c, ws, n) in refs.near.items()})
    carried = [f for f in docs.schema.fields if f.name.lower() not in NAMES]
    order = docs.select(*[F.col(f"`{f.name}`") for f in carried])
    at_text, at_lang = ([f.name for f in carried].index(n) for n in ("text", "lang"))
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def scored(batch: pa.RecordBatch, references: list) -> pa.RecordBatch:
        rows = [_verdict(t, ref, rules) for t, ref in zip(batch.column(at_text).to_pylist(), references)]
        new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *new], names=[*batch.schema.names[: len(carried)], *NAMES])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield scored(batch, [shared.value.get(g or "") for g in batch.column(at_lang).to_pylist()])

    def score_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, tuple | None] = {}
            references = []
            for i, g in enumerate(batch.column(at_lang).to_pylist()):
                if g not in made:
                    made[g] = _reference(*(batch.column(c)[i].as_py() for c in ("_classes", "_words", "_total")))
                references.append(made[g])
            yield scored(batch, references)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + f", {OUTPUT}"
    if refs.far is None:
        return order.mapInArrow(score, ddl)
    near = F.coalesce("lang", F.lit("")).isin(list(refs.near))
    salts = 16  # rows without words may be many of any language
    far = refs.far.select(F.col("lang").alias("_lang"), F.col("classes").alias("_classes"), F.col("words").alias("_words"), F.col("total").alias("_total"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    on = (F.coalesce("lang", F.lit("")) == F.col("_lang")) & (F.pmod(F.xxhash64("text"), F.lit(salts)) == F.col("_salt"))
    others = order.filter(~near).join(far.hint("merge"), on, "left").select(*[F.col(f"`{f.name}`") for f in carried], "_classes", "_words", "_total")
    return order.filter(near).mapInArrow(score, ddl).unionByName(others.mapInArrow(score_far, ddl))


def _reference(classes: list | None, words: list | None, total: int | None) -> tuple | None:
    if total is None:
        return None
    counts = np.zeros(7)
    for c in classes or []:
        counts[int(bytes(c["item"]))] = c["n"]
    n = [w["n"] for w in words or []]
    return counts, {bytes(w["item"]): i for i, w in enumerate(words or [])}, np.array([*n, total - sum(n)], float)


def _verdict(text: str | None, ref: tuple | None, rules: QualityRules) -> tuple:
    text = text or ""
    data = utf8(text)
    words = data.split()
    chars, symbols, dup, repeat = base_counts(text, words)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    by_char = by_word = None
    if ref is not None:
        if len(text) >= rules.min_chars:
            by_char = js_distance(class_counts(data).astype(float), ref[0])
        if len(words) >= rules.min_words:
            own, index = np.zeros(len(ref[2])), ref[1]
            for w in data.translate(ASCII_LOWER).split():
                own[index.get(w, -1)] += 1
            by_word = js_distance(own, ref[2])
    kept = not failed and not (by_char is not None and by_char > rules.max_char_distance) and not (by_word is not None and by_word > rules.max_word_distance)
    return len(words), chars, symbols, dup, repeat, failed, kept, by_char, by_word


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose verdict is kept, with their columns."""
    own, back = shielded(docs, *NAMES)
    return score_quality(own).filter("kept").select(*back)


def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang", "char_distance", "word_distance")


def _classes_sql(where: str) -> str:
    kinds = ("a-z", "A-Z", "0-9", " \\x09-\\x0D", "#*$%&|<>")
    counts = [f"length(regexp_replace({where}, '[^{k}]', '', 'g'))" for k in kinds]
    ascii_ = f"length(regexp_replace({where}, '[^\\x21-\\x7E]', '', 'g'))"
    other = f"length(regexp_replace({where}, '[\\x00-\\x7F]', '', 'g'))"
    return "[" + ", ".join([*counts, f"{ascii_} - {counts[0]} - {counts[1]} - {counts[2]} - {counts[4]}", other]) + "]"


def _distance_sql(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    term = "CASE WHEN {0}[i] > 0 THEN {0}[i] / list_sum({0}) * log2(({0}[i] / list_sum({0})) / (({0}[i] / list_sum({0}) + {1}[i] / list_sum({1})) / 2)) ELSE 0.0 END"
    return f"sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term.format(p, q)} + {term.format(q, p)})) / 2))"


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS ws, {_classes_sql("t")} AS classes FROM d
), lw AS (
  SELECT row, lang, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM (SELECT row, lang, unnest(ws) AS u FROM w)
), total AS (
  SELECT lang, count(*) AS total FROM lw GROUP BY lang
), counts AS (
  SELECT lang, word, count(*) AS n FROM lw GROUP BY lang, word
), common AS (
  SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r
  FROM counts JOIN total USING (lang) WHERE n * 2000 >= total QUALIFY r <= 64
), class_ref AS (
  SELECT lang, list(n::DOUBLE ORDER BY i) AS q FROM (
    SELECT lang, i, sum(n) AS n FROM (SELECT lang, unnest(range(1, 8)) AS i, unnest(classes) AS n FROM w) GROUP BY lang, i
  ) GROUP BY lang
), word_ref AS (
  SELECT lang, list(n::DOUBLE ORDER BY r) AS ns, max(total)::DOUBLE AS total FROM common JOIN total USING (lang) GROUP BY lang
), refs AS (
  SELECT lang, q, list_append(ns, total - list_sum(ns)) AS wq FROM class_ref JOIN word_ref USING (lang)
), hits AS (
  SELECT lw.row, c.r, count(*) AS n FROM lw JOIN common c USING (lang, word) GROUP BY lw.row, c.r
), hist AS (
  SELECT o.row, list(coalesce(h.n, 0)::DOUBLE ORDER BY c.r) AS ns FROM w o JOIN common c USING (lang) LEFT JOIN hits h ON h.row = o.row AND h.r = c.r GROUP BY o.row
), lines AS (
  SELECT row, sum(n - 1) AS n_dup FROM (
    SELECT row, line, count(*) AS n FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY row, line
  ) GROUP BY row
), tri AS (
  SELECT row, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), twice AS (
  SELECT row, i FROM tri QUALIFY count(*) OVER (PARTITION BY row, g) > 1
), repeats AS (
  SELECT row, count(DISTINCT i + k) AS n_rep FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row
), base AS (
  SELECT o.row, o.doc_id, o.t, o.classes, r.q, r.wq, list_append(h.ns, len(ws) - list_sum(h.ns)) AS wp, len(ws) AS n_words,
         length(regexp_replace(t, '[ 	-
]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words
  FROM w o LEFT JOIN refs r ON r.lang = o.lang LEFT JOIN hist h ON h.row = o.row LEFT JOIN lines l ON l.row = o.row LEFT JOIN repeats p ON p.row = o.row
), verdict AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         length(t) >= 200 AND coalesce({_distance_sql("list_transform(classes, lambda c: c::DOUBLE)", "q")} > 0.30, false) AS by_char,
         n_words >= 50 AND coalesce({_distance_sql("wp", "wq")} > 0.48, false) AS by_word
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT by_char AND NOT by_word AS kept FROM verdict
"""
