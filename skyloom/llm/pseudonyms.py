"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation of each validated value's format."""

from __future__ import annotations

import datetime
import hashlib
import logging
import re
import secrets
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import freeing, kept, small_batches

#: The setting that holds the secret. Whoever knows it can reverse the pseudonyms; Spark redacts settings of such a name in its UI and event logs.
KEY_SETTING = "spark.skyloom.pii.secret"
ROUNDS = 10
KINDS = ("email", "card", "phone", "ip", "iban", "ssn", "date", "secret")

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_month = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS)
#: Between the digits of a phone number with its country code, which has 7 to 15 of them (11 after +1 and +7), and beginnings that no country has.
_gap, _unused = r"[ .()/-]{0,2}", "28|83|89"

#: Every alternative starts at a border of its own characters, so a scan stays linear in the text.
FOUND = re.compile(
    rf"""
    (?P<email>(?<![\w.%+-])[\w.%+-]{{1,320}}@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,}})
  | (?P<secret>(?i:(?<!\w)(?:token|secret|password|api_?key)\s*[=:]\s*["']?)(?P<hex>[0-9A-Fa-f]{{24,128}})(?![0-9A-Za-z]))
  | (?P<iban>(?<!\w)[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
  | (?P<ip>(?<![0-9.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9]|\.[0-9]))
  | (?P<date>(?<![0-9./-])(?:
        (?P<y1>[0-9]{{4}})(?P<s1>[-/.])(?P<m1>[0-9]{{1,2}})(?P=s1)(?P<d1>[0-9]{{1,2}})
      | (?P<a2>[0-9]{{1,2}})(?P<s2>[-/.])(?P<b2>[0-9]{{1,2}})(?P=s2)(?P<y2>[0-9]{{4}})
      | (?P<d3>[0-9]{{1,2}})[ ](?P<n3>{_month})[ ](?P<y3>[0-9]{{4}})
      )(?![0-9/]|[-.][0-9])
    | (?<!\w)(?P<n4>{_month})[ ](?P<d4>[0-9]{{1,2}}),[ ](?P<y4>[0-9]{{4}})(?![0-9]))
  | (?P<ssn>(?<![0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))
  | (?P<phone>(?<![\w+])(?:\+[0-9]{{1,3}}[^\w\s(+]{{0,4}}[ .-]?)?(?:\([0-9]{{3}}\)[^\w\s(+]{{0,4}}[ ]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])
    | (?<![\w+])\+(?:[17](?:{_gap}[0-9]){{10}}|(?![017]|{_unused})[0-9](?:{_gap}[0-9]){{6,14}})(?![0-9])
    | (?<![\w+.,/-])(?=(?:[^\w]{{0,2}}[0-9]){{9,12}}(?![0-9]|[ ./-][0-9]))(?:\(0[1-9][0-9]{{0,4}}\)[ ]?|0[1-9][0-9]{{0,4}}[ ./-])[0-9]{{2,8}}(?:[ ./-][0-9]{{2,8}}){{0,4}}(?![0-9]))
  | (?P<card>(?<![0-9])[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9]))
    """,
    re.X,
)
NEAR, MARGIN = re.compile(r"[0-9@]"), 400


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and @, of which every value has one; the slow expression runs only inside them."""
    begin = end = -1
    m = NEAR.search(text)
    while m:
        at = m.start()
        if at - MARGIN > end:
            if end >= 0:
                yield begin, min(end, len(text))
            begin = max(0, at - MARGIN)
        end = at + MARGIN
        m = NEAR.search(text, at + 1)
    if end >= 0:
        yield begin, min(end, len(text))


class Feistel:
    """A keyed permutation of {0..a-1} x {0..b-1}: the halves take turns in adding a keyed hash of the other."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int) -> int:
        h = hashlib.blake2b(b"%d|%d|%b" % (i, half, tweak), key=self.key, digest_size=32)
        return int.from_bytes(h.digest(), "big")

    def pair(self, left: int, right: int, a: int, b: int, tweak: bytes, back: bool = False) -> tuple[int, int]:
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left)) % b
            else:
                left = (left + sign * self._round(tweak, i, right)) % a
        return left, right

    def number(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of 0..size-1, walking on while the pair falls outside."""
        a = int(size**0.5) + 1
        b = -(-size // a)
        while True:
            left, right = self.pair(x // b, x % b, a, b, tweak, back)
            x = left * b + right
            if x < size:
                return x

    def text(self, value: str, tweak: bytes, back: bool = False, hexadecimal: bool = False) -> str:
        """value with its digits and letters permuted inside their classes; other characters stay where they are."""
        classes = [_class(c, hexadecimal) for c in value]
        spots = [i for i, c in enumerate(classes) if c]
        half = len(spots) // 2
        sizes, numbers = [1, 1], [0, 0]
        for n, i in enumerate(spots):
            side = int(n >= half)
            numbers[side] = numbers[side] * len(classes[i]) + classes[i].index(value[i])
            sizes[side] *= len(classes[i])
        shape = "".join(c[0] if c else "." for c in classes).encode()
        numbers = list(self.pair(*numbers, *sizes, tweak + b"|" + shape, back))
        out = list(value)
        for n in reversed(range(len(spots))):
            i, side = spots[n], int(n >= half)
            numbers[side], at = divmod(numbers[side], len(classes[i]))
            out[i] = classes[i][at]
        return "".join(out)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=4096)
def _alike(c: str) -> str | None:
    """Letters, marks and digits of the same 128 code points and Unicode category as c, itself among them; None for other characters."""
    kind, start = unicodedata.category(c), ord(c) & ~127
    return "".join(x for x in map(chr, range(start, start + 128)) if unicodedata.category(x) == kind) if kind[0] in "LMN" else None


def _class(c: str, hexadecimal: bool) -> str | None:
    if hexadecimal:
        return DIGITS + LOWER[:6] if c in DIGITS + LOWER[:6] else DIGITS + UPPER[:6] if c in UPPER[:6] else None
    return next((k for k in (DIGITS, LOWER, UPPER) if c in k), None) or _alike(c)


def luhn_digit(digits: str) -> int:
    """The check digit that follows digits."""
    doubled = (int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits)))
    return -sum(x - 9 * (x > 9) for x in doubled) % 10


def issued(ssn: str) -> bool:
    """Whether a social security number's parts are ones that are given out."""
    area, group, serial = ssn.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date_parts(m: re.Match) -> tuple[int, int, int, str] | None:
    """(year, month, day, layout) of a real date in 1900 to 2099."""
    g = m.groupdict()
    if g["y1"]:
        y, mo, d, layout = g["y1"], g["m1"], g["d1"], "ymd"
    elif g["y2"]:
        a, b = int(g["a2"]), int(g["b2"])
        month_first = b > 12 or a <= 12 and g["s2"] == "/"
        y, mo, d, layout = g["y2"], b if not month_first else a, a if not month_first else b, "mdy" if month_first else "dmy"
    else:
        name, d, y = (g["n3"], g["d3"], g["y3"]) if g["n3"] else (g["n4"], g["d4"], g["y4"])
        mo = next(i for i, x in enumerate(MONTHS, 1) if x.startswith(name[:3]))
        layout = "d n y" if g["n3"] else "n d y"
    try:
        day = datetime.date(int(y), int(mo), int(d))
    except ValueError:
        return None
    return (day.year, day.month, day.day, layout) if FIRST_DAY <= day.toordinal() <= LAST_DAY else None


class Pseudonyms:
    """Replaces validated values under one key; the same value always gets the same pseudonym of the same form."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.plain = lru_cache(maxsize=100_000)(self._plain)

    def _plain(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if value isn't valid."""
        f = self.feistel
        digits = re.sub("[^0-9]", "", value)
        if kind == "email":
            local, domain = value.rsplit("@", 1)
            names, top = domain.rsplit(".", 1)
            return f.text(local, b"local") + "@" + f.text(names, b"domain") + "." + top
        if kind == "card":
            if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
                return None
            body = f.text(digits[:-1], b"card")
            new = iter(body + str(luhn_digit(body)))
            return "".join(next(new) if c in DIGITS else c for c in value)
        if kind == "phone":  # the digits alone, so that layouts of one number stay linked
            new = iter(f.text(digits, b"phone"))
            return "".join(next(new) if c in DIGITS else c for c in value)
        if kind == "ssn":
            if not issued(value):
                return None
            value = f.text(value, b"ssn")
            while not issued(value):  # walks on inside the cycle, so pseudonyms stay one for one
                value = f.text(value, b"ssn")
            return value
        if kind == "ip":
            parts = [int(p) for p in value.split(".")]
            if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
                return None
            x = f.number(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ip")
            return ".".join(map(str, x.to_bytes(4, "big")))
        if kind == "iban":
            packed = value.replace(" ", "")
            if not 15 <= len(packed) <= 34 or iban_check(packed[:2], packed[4:]) != int(packed[2:4]):
                return None
            rest = f.text(packed[4:], b"iban" + packed[:2].encode())
            new = iter(packed[:2] + f"{iban_check(packed[:2], rest):02d}" + rest)
            return "".join(c if c == " " else next(new) for c in value)
        raise ValueError(kind)

    def date(self, m: re.Match) -> str | None:
        parts = _date_parts(m)
        if not parts:
            return None
        day = datetime.date(*parts[:3]).toordinal() - FIRST_DAY
        new = datetime.date.fromordinal(FIRST_DAY + self.feistel.number(day, LAST_DAY - FIRST_DAY + 1, b"date"))
        g, layout = m.groupdict(), parts[3]
        if layout in ("d n y", "n d y"):
            old_name, old_day = (g["n3"], g["d3"]) if g["n3"] else (g["n4"], g["d4"])
            name = MONTHS[new.month - 1] if len(old_name) > 3 or old_name == "May" else MONTHS[new.month - 1][:3]
            shown = f"{new.day:0{len(old_day)}d}"
            return f"{shown} {name} {new.year}" if layout == "d n y" else f"{name} {shown}, {new.year}"
        first, second = (g["m1"], g["d1"]) if layout == "ymd" else (g["a2"], g["b2"])
        values = {"y": f"{new.year:04d}"}
        for letter, old in zip(layout.replace("y", ""), (first, second)):
            values[letter] = f"{new.month if letter == 'm' else new.day:0{len(old)}d}"
        return (g["s1"] or g["s2"]).join(values[c] for c in layout)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """text with its valid values replaced, and how many of each kind."""
        counts: dict[str, int] = {}

        def new(m: re.Match) -> str:
            kind = next(k for k in KINDS if m[k])
            if kind == "secret":
                got = m[0][: m.start("hex") - m.start()] + self.feistel.text(m["hex"], b"secret", hexadecimal=True)
            else:
                got = self.date(m) if kind == "date" else self.plain(kind, m[0])
            if got is None:
                return m[0]
            counts[kind] = counts.get(kind, 0) + 1
            return got

        out, done = [], 0
        for begin, end in windows(text):
            for m in FOUND.finditer(text, begin, end):
                out += [text[done : m.start()], new(m)]
                done = m.end()
        return "".join([*out, text[done:]]), counts


_drawn: dict[str, bytes] = {}


def secret_key(spark: SparkSession) -> bytes:
    """The secret of KEY_SETTING; without one, a key drawn for this application, so that its pseudonyms can't be reversed or linked to other runs. All
    its tasks and stages share that key. A job that is restarted is another application: where its parts must stay linked, the setting is needed."""
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given.encode()
    app = spark.sparkContext.applicationId
    if app not in _drawn:
        logging.getLogger(__name__).warning("%s isn't set: pseudonyms of this application won't be linked to those of others", KEY_SETTING)
        _drawn[app] = secrets.token_bytes(32)
    return _drawn[app]


def pseudonymise(docs: DataFrame, key: bytes | None = None, text: str = "text", counts: str | None = "pii") -> DataFrame:
    """docs with every validated value of `text` replaced by its pseudonym under the key, or under secret_key without one.

    Kinds: e-mail addresses, in any script; card numbers (Luhn) keep length, layout and a valid check digit; phone numbers with + and
    country code, with a leading 0 and 9 to 12 digits in groups, or in groups of 3, 3 and 4; IPv4
    addresses; IBANs (mod 97 kept valid); social security numbers; dates of 1900 to 2099, also across layouts; hexadecimal secrets with a digit
    after token, secret, password or api key. A number that fails its check is left alone, and so is what no layout above has: IPv6 addresses,
    phone numbers that begin with 00 or (0) or are bare digits, passwords that aren't hexadecimal, and addresses whose local part
    exceeds 320 characters or whose domain exceeds 400. Where kinds could overlap, the first in the
    text wins, then the first in this list. Texts are searched whole, however long. A null text stays null, with
    zero counts; repeated rows stay; an empty table gives an empty one. `counts` names an added map from kind to number (None: not added;
    a column of that name, in any case of letters, is replaced).
    """
    small_batches(docs.sparkSession)
    key = key or secret_key(docs.sparkSession)
    keep = docs.columns if counts is None else kept(docs, (counts,))
    base = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = base.schema if counts is None else base.withColumn(counts, F.lit(None).cast("map<string,int>")).schema
    spot = keep.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            texts = batch.column(spot)
            may = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)
            found = [names.replace(t) for t in texts.filter(may).to_pylist()]
            columns = list(batch.columns)
            columns[spot] = pc.replace_with_mask(texts, may, pa.array([t for t, _ in found], texts.type))
            if counts is not None:
                each = iter(found)
                columns.append(pa.array([list(next(each)[1].items()) if m else [] for m in may.to_pylist()], pa.map_(pa.string(), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(freeing(mask), schema)
