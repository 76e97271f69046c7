"""Text and scalar expressions. All but YAML front matter and byte-pair windows are built-in columns, so they stay in the JVM."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

SOURCE_TYPES = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".md": "markdown", ".txt": "text", ".py": "code", ".js": "code", ".ts": "code", ".go": "code", ".rs": "code", ".java": "code", ".html": "html", ".htm": "html"}
EXTENSIONS = (*SOURCE_TYPES, ".csv")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    return F.translate(_col(c), _UPPER, _LOWER)


def document_id(collection: Column | str, path: Column | str) -> Column:
    """First 32 hex digits of the SHA-256 of collection:path."""
    return F.substring(F.sha2(F.concat(_col(collection), F.lit(":"), _col(path)), 256), 1, 32)


def is_url(c: Column | str) -> Column:
    return _col(c).rlike("^(?i)https?:")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))


def source_type(path: Column | str) -> Column:
    """Kind of a source by its suffix: url, one of SOURCE_TYPES, or file."""
    known = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    return F.when(is_url(path), "url").otherwise(F.coalesce(known[extension(path)], F.lit("file")))


def hidden(relative_path: Column | str) -> Column:
    """Whether a part of a path below the scanned folder begins with a dot."""
    return _col(relative_path).rlike(r"(^[.])|(/[.])")


def title(path: Column | str) -> Column:
    """A URL as it is; else the file's stem with _ and - as spaces, each run of letters capitalised."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    words = F.regexp_extract_all(F.lower(F.regexp_replace(stem, "[_-]", " ")), F.lit(r"[\p{L}]+|[^\p{L}]+"), 0)
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.when(is_url(path), _col(path)).otherwise(F.array_join(capital, ""))


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of three or more line ends become two; white space at either end goes."""
    return F.regexp_replace(F.regexp_replace(_col(c), "\n{3,}", "\n\n"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def terms(c: Column | str) -> Column:
    """Search terms: runs of ASCII letters (A-Z folded), digits and non-ASCII characters."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), 0)


def tokens(c: Column | str) -> Column:
    """Chunking tokens: a run of non-space with the space before it; joined they give the text up to trailing space."""
    return F.regexp_extract_all(_col(c), F.lit("[ \t\n\r]*[^ \t\n\r]+"), 0)


def check_window(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"0 <= overlap < size must hold, not size {size} and overlap {overlap}")


def windows(token_array: Column | str, size: int, overlap: int) -> Column:
    """Arrays of `size` tokens, `overlap` shared with the next, up to the window that reaches the end."""
    check_window(size, overlap)
    a, step = _col(token_array), size - overlap
    n = F.size(a)
    count = F.when(n <= 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(1), (count - 1) * step + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(a, s, size))


def chunks(c: Column | str, size: int, overlap: int, min_chars: int = 21) -> Column:
    """Stripped window texts of at least min_chars characters, in order."""
    kept = lambda a: F.filter(F.transform(windows(a, size, overlap), lambda w: stripped(F.array_join(w, ""))), lambda t: F.length(t) >= min_chars)
    return F.flatten(F.transform(F.array(tokens(c)), kept))  # transform binds the tokens, which are thus cut once


_FRONT = r"(?s)\A\s*---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def front_matter_block(c: Column | str) -> Column:
    """What stands between the --- lines at the start, white space and \\r aside; empty if there are none."""
    return F.regexp_extract(_col(c), _FRONT, 1)


def strip_front_matter(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), _FRONT, "")


def front_matter_map(c: Column | str) -> Column:
    """key: value lines of the block as a map of strings, quotes and comments gone, the last of equal keys kept;
    a [a, b] value becomes a,b. A fallback for where no YAML parser is wanted."""
    lines = F.filter(F.split(front_matter_block(c), "\r?\n"), lambda x: x.rlike(r"^[^#:]+:") & ~stripped(x).startswith("#"))

    def value(x: Column) -> Column:
        v = stripped(F.regexp_extract(x, r"^[^:]+:(.*)$", 1))
        items = F.transform(F.split(F.regexp_extract(v, r"^\[(.*)\]$", 1), ","), lambda i: F.regexp_replace(stripped(i), r"^[\"']|[\"']$", ""))
        return F.when(v.rlike(r"^\[.*\]$"), F.array_join(F.filter(items, lambda i: i != ""), ",")).otherwise(F.regexp_replace(v, r"^[\"']|[\"']$", ""))

    pair = lambda x: F.struct(stripped(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), value(x).alias("v"))

    def last_kept(pairs: Column) -> Column:
        later = lambda i: F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda p: p["k"] == F.element_at(pairs, i + 1)["k"])
        return F.filter(pairs, lambda p, i: ~later(i))

    bound = F.transform(F.array(F.transform(lines, pair)), last_kept)  # the pairs are made once
    return F.coalesce(F.map_from_entries(F.element_at(bound, 1)), F.create_map().cast("map<string,string>"))


@F.pandas_udf(types.MapType(types.StringType(), types.StringType()))
def _yaml_map(blocks: pd.Series) -> pd.Series:
    """A YAML mapping as strings: scalars as they print, lists of scalars joined by commas, anything nested left out. What
    isn't a mapping, or can't be read, gives none."""
    import yaml

    def flat(v):
        if isinstance(v, list):
            return ",".join(str(x) for x in v if not isinstance(x, (list, dict)) and x is not None)
        return None if v is None or isinstance(v, dict) else str(v)

    def read(block):
        try:
            found = yaml.safe_load(block) if block else None
        except yaml.YAMLError:
            return None
        return {str(k): flat(v) for k, v in found.items() if flat(v) is not None} if isinstance(found, dict) else {}

    return blocks.map(read)


def front_matter(c: Column | str) -> Column:
    """The front matter as a map: read as YAML where that parser is installed, else by its key: value lines."""
    plain = front_matter_map(c)
    if importlib.util.find_spec("yaml") is None:
        return plain
    return F.when(front_matter_block(c) == "", plain).otherwise(F.coalesce(_yaml_map(front_matter_block(c)), plain))


def bpe_chunks(c: Column | str, size: int, overlap: int, ranks: str, min_chars: int = 21) -> Column:
    """As chunks(), in tokens of a byte-pair encoding: ranks is the path of a .tiktoken file that all executors can read.
    A window may cut a character; what is left of one at either end is dropped."""
    check_window(size, overlap)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = _bpe(ranks)
        for texts in batches:
            out = []
            for text in texts:
                ids, step, own = encode(text or ""), size - overlap, []
                for at in range(0, len(ids), step):
                    own.append(decode(ids[at : at + size]).decode("utf-8", "ignore").strip(" \t\n\r"))
                    if at + size >= len(ids):
                        break
                out.append([t for t in own if len(t) >= min_chars])
            yield pd.Series(out, index=texts.index)

    return run(_col(c))


_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bpe(ranks: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks, "rb"))}
    own = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=table, special_tokens={})
    return own.encode_ordinary, own.decode_bytes


def metadata_value(explicit: Column | str, found: Column | str) -> Column:
    """The explicit value, unless it is null or empty, else the one found in the document."""
    return F.coalesce(F.nullif(_col(explicit), F.lit("")), _col(found))


def date_prefix(c: Column | str) -> Column:
    """The day of a time, as yyyy-MM-dd."""
    return F.date_format(_col(c), "yyyy-MM-dd")


def snippet(c: Column | str, n: int = 120) -> Column:
    return F.concat(F.substring(_col(c), 1, n), F.lit("..."))


def word_count(c: Column | str) -> Column:
    return F.size(F.regexp_extract_all(_col(c), F.lit("[^ \t\n\r]+"), 0))


def l2_normalized(v: Column | str) -> Column:
    v = _col(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-9)))
