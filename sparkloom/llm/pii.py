"""Format-preserving pseudonyms by keyed Feistel permutations.

Validated values are replaced within their format, by a permutation of that format's values keyed by a secret: equal values
get equal pseudonyms in every document, different values different ones, and depseudonymize() with the key gives them back.
Equal are values, not spellings: a day has one pseudonym as 2024-01-02 and as 02/01/2024 (one-digit forms, and m/d/y, which
can't hold every day, are permuted among their own), an address whatever its letters' case, a national telephone number
with or without its country code, a card or IBAN however it is spaced.

Kinds: payment cards (Luhn; the check digit is recomputed, the issuer digit kept), IBANs (mod 97), US social security
numbers, calendar dates (ISO, and d/m/y or m/d/y within one month table), IPv4 addresses, phone numbers (punctuation and
country code kept), e-mail addresses (letters and digits permuted within the local part and first domain label), and
secrets (token, key or password assignments, and known key prefixes).

Edge cases: a null text stays null, an empty one empty; numbers that fail validation stay; each row is handled alone, so
repeated rows give repeated results; overlapping candidates go to the kind listed first; further columns are carried,
those named like an output are replaced; an empty table gives an empty result. The key is that of the session setting
spark.sparkloom.pii.key; without one a demonstration key serves, which protects nothing.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shielded, table

KEY = b"sparkloom-demo-key"
KINDS = ("email", "secret", "iban", "card", "ssn", "date", "ip", "phone")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """Permutations of range(n), one for each tweak: an alternating network over a x b >= n with mixed moduli, walked until within n."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = key, rounds

    @lru_cache(maxsize=65536)
    def _f(self, tweak: str, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{x}".encode(), key=self.key[:64], digest_size=16).digest(), "big")

    def _split(self, n: int) -> tuple[int, int]:
        a = max(2, int(n**0.5))
        while a * a < n:
            a += 1
        return a, -(-n // a)

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        a, b = self._split(n)
        while True:
            left, right = divmod(x, b)
            for r in range(0, self.rounds, 2):
                left = (left + self._f(tweak, r, right)) % a
                right = (right + self._f(tweak, r + 1, left)) % b
            x = left * b + right
            if x < n:
                return x

    def invert(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        a, b = self._split(n)
        while True:
            left, right = divmod(x, b)
            for r in range(self.rounds - 2, -1, -2):
                right = (right - self._f(tweak, r + 1, left)) % b
                left = (left - self._f(tweak, r, right)) % a
            x = left * b + right
            if x < n:
                return x


def luhn_digit(body: str) -> str:
    s = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(body)))
    return str(-s % 10)


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


_EMAIL = r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
_SECRET = r"(?P<secret>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b|(?i:\b(?:token|secret|api[_-]?key|passw(?:or)?d)\b)\s*[:=]\s*[\"']?[A-Za-z0-9_+/=-]{16,}[\"']?)"
_REST = (
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    r"(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w]))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]))",
    r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w]))",
)
_SCAN = re.compile("|".join((_EMAIL, _SECRET, *_REST)))
#: Any match holds one of these (an address or a card may have no two digits in a row), so most texts are passed over at once.
_HINT = re.compile(r"@|\d{2}|\d[ .-]\d|AKIA|gh[pousr]_|sk-|[=:]\s*[\"']?[A-Za-z0-9_+/=-]{16}")
_PREFIX = re.compile(r"AKIA|gh[pousr]_|sk-|(?i:token|secret|api[_-]?key|passw(?:or)?d)\s*[:=]\s*[\"']?")
_EPOCH, _DAYS = datetime.date(1900, 1, 1), 73049  # 1900 to 2099


def _spread(digits: str, shape: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes = KEY):
        self.feistel = Feistel(key)

    def _digits(self, d: str, tweak: str, move) -> str:
        return str(move(int(d), 10 ** len(d), f"{tweak}{len(d)}")).zfill(len(d)) if d else d

    def _chars(self, s: str, tweak: str, move, fold: bool = False) -> str:
        """s permuted among the strings of the same classes by place: lower or upper letters, digits; the rest stays. With fold
        letters are permuted as lower case and get the case of their place back."""
        if fold:
            new = self._chars(s.lower(), tweak, move)
            return "".join(c.upper() if old.isascii() and old.isupper() else c for old, c in zip(s, new))
        n, x, bases = 1, 0, []
        for c in s:
            if c.isascii() and c.isalnum():
                base, low = (10, "0") if c.isdigit() else (26, "a" if c.islower() else "A")
                x, n = x * base + ord(c) - ord(low), n * base
                bases.append((base, low))
            else:
                bases.append((1, c))
        shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", s)))
        y, out = move(x, n, f"{tweak}:{shape}"), []
        for base, low in reversed(bases):
            if base == 1:
                out.append(low)
            else:
                y, v = divmod(y, base)
                out.append(chr(ord(low) + v))
        return "".join(reversed(out))

    def replace(self, kind: str, s: str, back: bool = False) -> str | None:
        """The pseudonym of s, or with back the value of which s is the pseudonym; None if s isn't valid for its kind."""
        move = self.feistel.invert if back else self.feistel.permute
        if kind == "email":
            local, domain = s.split("@", 1)
            first, rest = domain.split(".", 1)
            return f"{self._chars(local, 'mail', move, True)}@{self._chars(first, 'host', move, True)}.{rest}"
        if kind == "secret":
            head = _PREFIX.match(s)[0]
            body = s[len(head) :].rstrip("\"'")
            if re.fullmatch(r"[0-9a-f]+", body):
                new = f"{move(int(body, 16), 16 ** len(body), f'hex{len(body)}'):0{len(body)}x}"
            else:
                new = self._chars(body, "secret", move)
            return head + new + s[len(head) + len(body) :]
        digits = re.sub(r"\D", "", s)
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
                return None
            body = digits[0] + self._digits(digits[1:-1], "card" + digits[0], move)
            if len(set(body + luhn_digit(body))) == 1:  # as it can't be one of those that aren't taken for a card
                body = digits[0] + self._digits(body[1:], "card" + digits[0], move)
            return _spread(body + luhn_digit(body), s)
        if kind == "iban":
            plain = s.replace(" ", "")
            if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
                return None
            body = self._chars(plain[4:], "iban" + plain[:2], move)
            new = iter(plain[:2] + iban_check(plain[:2], body) + body)
            return "".join(c if c == " " else next(new) for c in s)
        if kind == "ssn":
            area, group, serial = int(s[:3]), int(s[4:6]), int(s[7:])
            if area in (0, 666) or area > 899 or not group or not serial:
                return None
            place = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
            rest, serial = divmod(move(place, 898 * 99 * 9999, "ssn"), 9999)
            area, group = divmod(rest, 99)
            area += 1 + (area >= 665)
            return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "date":
            return self._date(s, move)
        if kind == "ip":
            parts = s.split(".")
            if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
                return None
            y = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
            return ".".join(map(str, y.to_bytes(4, "big")))
        if not 8 <= len(digits) <= 15:
            return None
        keep = len(re.match(r"\+(\d*)", s)[1]) if s[0] == "+" and re.match(r"\+\d+[ .(-]", s) else 0
        return _spread(digits[:keep] + self._digits(digits[keep:], "tel", move), s)

    def _date(self, s: str, move) -> str | None:
        try:
            if s[4:5] == "-":
                d = datetime.date.fromisoformat(s)
                n, shape = (d - _EPOCH).days, "iso"
            else:
                a, b, y = map(int, s.split("/"))
                day, month = (a, b) if b <= 12 else (b, a)
                d, shape = datetime.date(y, month, day), "dmy" if b <= 12 else "mdy"
                n = (d - _EPOCH).days
        except ValueError:
            return None
        if not 0 <= n < _DAYS:
            return None
        width = [len(x) for x in s.split("/")]
        if shape == "iso" or (shape == "dmy" and width[:2] == [2, 2]):
            d = _EPOCH + datetime.timedelta(move(n, _DAYS, "day"))
            return d.isoformat() if shape == "iso" else f"{d.day:02d}/{d.month:02d}/{d.year}"
        # other slashed dates are permuted among those that are read the same way, so the result is again one of them
        valid = _slashed(shape, width[0], width[1])
        new = valid[0][move(valid[1][n], len(valid[0]), f"{shape}{width[0]}{width[1]}")]
        d = _EPOCH + datetime.timedelta(new)
        a, b = (d.day, d.month) if shape == "dmy" else (d.month, d.day)
        return f"{a:0{width[0]}d}/{b:0{width[1]}d}/{d.year}"

    def text(self, text: str | None, back: bool = False) -> tuple[str | None, dict[str, int]]:
        found: dict[str, int] = {}
        if not text or not _HINT.search(text):
            return text, found

        def put(m: re.Match) -> str:
            new = self.replace(m.lastgroup, m[0], back)
            if new is None:
                return m[0]
            found[m.lastgroup] = found.get(m.lastgroup, 0) + 1
            return new

        return _SCAN.sub(put, text), found


@lru_cache(maxsize=16)
def _slashed(shape: str, w1: int, w2: int) -> tuple[list[int], dict[int, int]]:
    """Days whose slashed form has these widths and is read in this order."""

    def fits(d: datetime.date) -> bool:
        a, b = (d.day, d.month) if shape == "dmy" else (d.month, d.day)
        return (shape == "dmy" or b > 12) and (a > 9 or w1 == 1 or w1 == 2) and len(str(a)) <= w1 and len(str(b)) <= w2 and not (w1 == 1 and a > 9) and not (w2 == 1 and b > 9)

    days = [n for n in range(_DAYS) if fits(_EPOCH + datetime.timedelta(n))]
    return days, {n: i for i, n in enumerate(days)}


COUNTS = [f"n_{k}" for k in KINDS]


def session_key(spark: SparkSession) -> bytes:
    return spark.conf.get("spark.sparkloom.pii.key", KEY.decode()).encode()


def pseudonymize(docs: DataFrame, key: bytes | None = None, back: bool = False, column: str = "text") -> DataFrame:
    """docs with its text pseudonymised (with back: restored) and the number of replacements by kind; key: that of the session
    if none is given."""
    key = session_key(docs.sparkSession) if key is None else key
    fields = [f for f in docs.schema.fields if f.name.lower() not in COUNTS]
    at = [f.name for f in fields].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            done = [own.text(t, back) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            counts = [pa.array([f.get(k, 0) for _, f in done], pa.int32()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*batch.schema.names, *COUNTS])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, ddl + "".join(f", {c} int" for c in COUNTS))


def depseudonymize(docs: DataFrame, key: bytes | None = None, column: str = "text") -> DataFrame:
    """What pseudonymize() with the same key was given, and the number of values restored by kind."""
    return pseudonymize(docs, key, True, column)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with text pseudonymised; n_chars is unchanged in length except where an address has more or fewer digits."""
    own, back = shielded(docs, *COUNTS)
    done = pseudonymize(own)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*back)


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
