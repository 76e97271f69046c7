"""License scans by template-markup matching.

A template is plain text with <<beginOptional>> ... <<endOptional>> and <<var;min;max>> regions. It is compiled into an
automaton over words: literal edges must match exactly, optional regions may be skipped, a variable takes between min and
max words. A text is accepted where a run of its words takes the automaton from start to end, so all mandatory wording is there.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters, as places where a phrase's
words stand consecutively may lie anywhere in the text.

Edge cases: a null text is empty; a text without words has no places and no labels; overlapping places all count; labels are
distinct and sorted; repeated rows are scanned each; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, utf8

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices in template markup; every one holds a literal run of at least two words before any variable.
TEMPLATES = {
    "apache-2.0-notice": "licensed under <<beginOptional>>the <<endOptional>>Apache License<<beginOptional>>,<<endOptional>> <<beginOptional>>Version <<endOptional>>2.0",
    "cc-by-4.0-notice": "<<beginOptional>>this work is <<endOptional>>licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative Commons Attribution <<endOptional>>CC BY 4.0",
    "cc-by-sa-notice": "licensed under <<beginOptional>>a <<endOptional>>CC BY SA <<var;1;2>>",
    "gpl-3.0-notice": "licensed under the <<beginOptional>>GNU <<endOptional>>General Public License<<beginOptional>>,<<endOptional>> version 3<<beginOptional>> or any later version<<endOptional>>",
    "gpl-2.0-notice": "licensed under the <<beginOptional>>GNU <<endOptional>>General Public License<<beginOptional>>,<<endOptional>> version 2<<beginOptional>> or any later version<<endOptional>>",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of <<var;1;4>> and associated documentation files <<beginOptional>>the Software <<endOptional>>to deal in <<var;1;3>> without restriction",
    "mit-notice": "<<beginOptional>>released <<endOptional>><<beginOptional>>licensed <<endOptional>>under the MIT License",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "copyright-reserved": "copyright <<beginOptional>>c <<endOptional>><<var;1;8>> all rights reserved",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;\d+;\d+)>>")
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORDS).split()


class Automaton:
    """Word automaton of a template. edges[s]: (word or None for any, next state); skips[s]: states reached without a word."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.mandatory, runs, run, open_at = 0, [], [], []

        def word(w: bytes | None) -> None:
            self.edges[-1].append((w, len(self.edges)))
            self.edges.append([])
            self.skips.append([])

        at = 0
        for m in [*_MARK.finditer(template), None]:
            for w in words_of(template[at : m.start() if m else len(template)]):
                word(w)
                if not open_at:
                    self.mandatory += 1
                    run.append(w)
            if m is None:
                break
            at = m.end()
            runs, run = [*runs, run], []
            if m[1] == "beginOptional":
                open_at.append(len(self.edges) - 1)
            elif m[1] == "endOptional":
                self.skips[open_at.pop()].append(len(self.edges) - 1)
            else:
                low, high = map(int, m[1].split(";")[1:])
                for k in range(high):
                    if k >= low:
                        self.skips[len(self.edges) - 1].append(len(self.edges) - 1 + high - k)
                    word(None)
        if open_at or self.mandatory == 0:
            raise ValueError(f"unbalanced or without mandatory wording: {template!r}")
        #: A literal run that every accepted text holds: cheap to look for before the automaton is run.
        self.anchor = b" %b " % b" ".join(max([*runs, run], key=len))
        #: Most words before that run.
        self.reach = len(self.edges)
        self.end = len(self.edges) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], start: int) -> int:
        """Words of the longest accepted run from start; 0 if none."""
        states, best, i = self._closure({0}), 0, start
        while states:
            if self.end in states:
                best = i - start
            if i == len(words):
                break
            states = self._closure({t for s in states for w, t in self.edges[s] if w is None or w == words[i]})
            i += 1
        return best


def compile_templates(templates: dict[str, str] = TEMPLATES) -> dict[str, Automaton]:
    return {label: Automaton(t) for label, t in templates.items()}


def _places(joined: bytes, needle: bytes) -> list[int]:
    """Word numbers at which needle, with a space at either end, stands in joined."""
    out, at = [], joined.find(needle)
    n = last = 0
    while at >= 0:
        n += joined.count(b" ", last, at)
        last = at
        out.append(n)
        at = joined.find(needle, at + 1)
    return out


def scan(text: str | None, automata: dict[str, Automaton], phrases: dict[str, str] = PHRASES) -> tuple[int, list[tuple[int, str]], dict[str, tuple[int, int]], float]:
    """Number of words, places of phrases with their labels, label -> first (word, words) of the templates matched, score:
    1 if a template accepts a run of the text's words, 0.5 for a phrase alone, else 0."""
    words = words_of(text)
    joined = b" %b " % b" ".join(words)
    base = [(at, label) for phrase, label in phrases.items() for at in _places(joined, b" %b " % phrase.encode())]
    found: dict[str, tuple[int, int]] = {}
    for label, a in automata.items():
        for at in _places(joined, a.anchor):
            for start in range(max(0, at - a.reach), at + 1):
                if n := a.match(words, start):
                    found.setdefault(label, (start, n))
                    break
            if label in found:
                break
    return len(words), base, found, 1.0 if found else 0.5 if base else 0.0


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compile_templates(templates)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, base, found, score = scan(text, automata, phrases)
                at, own = [p for p, _ in base], {label for _, label in base}
                rows.append((doc_id, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(found))), score))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def op7_template_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _template_regex(template: str) -> str:
    """The template as an RE2 pattern over words that each have a space before them."""
    out, at = "", 0
    for m in [*_MARK.finditer(template), None]:
        out += "".join(f" {w.decode()}" for w in words_of(template[at : m.start() if m else len(template)]))
        if m is None:
            return f"{out} "
        at = m.end()
        out += "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else "(?: [^ ]+){%s,%s}" % tuple(m[1].split(";")[1:])


_ARMS = ", ".join(f"CASE WHEN regexp_matches(j, '{_template_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
OP7_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), j AS (
  SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS j FROM w
), p AS (
  SELECT doc_id, i - 1 AS pos, CASE WHEN ws[i] = 'cc' AND ws[i + 1] = 'by' THEN 'cc-by'
      WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl'
      WHEN ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved' THEN 'reserved' END AS label
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM j)
), b AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws) AS n_words, list_filter([{_ARMS}], lambda x: x IS NOT NULL) AS own FROM j
)
SELECT m.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM m LEFT JOIN b USING (doc_id)
"""
