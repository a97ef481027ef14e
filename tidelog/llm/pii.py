"""Format-preserving pseudonyms for personal data.

Candidates are found by shape and validated (check digits, ranges, calendar).
A valid value is a number of a finite domain - all numbers of its format that
are valid themselves.  A keyed Feistel network permutes the domain, walking on
along its cycle while it stands outside, so that pseudonyms are valid, keep the
format, can be undone with the key, and equal values get equal pseudonyms in
every document.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A permutation of 0 ... size - 1, or its inverse: a balanced Feistel network with cycle walking."""
    if not 0 <= value < size:
        raise ValueError("value outside its domain")
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def turn(x: int, step: int) -> int:
        said = hashlib.blake2b(b"%d|%d|" % (step, size) + x.to_bytes(width, "big") + tweak.encode(), key=key[:64], digest_size=max(8, width)).digest()
        return int.from_bytes(said, "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for step in reversed(range(ROUNDS)):
                left, right = right ^ turn(left, step), left
        else:
            for step in range(ROUNDS):
                left, right = right, left ^ turn(right, step)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The sum of a number with its check digit, modulo 10: 0 if it is valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def _spread(text: str) -> tuple[int, int, list[tuple[int, str]]]:
    """Letters and digits of an ASCII text as one number of mixed radix: (value, size, (place, alphabet))."""
    places, value, size = [], 0, 1
    for i, c in enumerate(text):
        alphabet = "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else ""
        if alphabet:
            places.append((i, alphabet))
            value = value * len(alphabet) + alphabet.index(c)
            size *= len(alphabet)
    return value, size, places


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Permutes the letters and digits of a text, each within its own class; other signs stay."""
    value, size, places = _spread(text)
    if size == 1:
        return text
    value, out = permute(value, size, key, tweak, back), list(text)
    for i, alphabet in reversed(places):
        value, at = divmod(value, len(alphabet))
        out[i] = alphabet[at]
    return "".join(out)


def _digits(text: str, digits: str) -> str:
    """``text`` with its digits replaced, in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _email(text: str, key: bytes, back: bool) -> str | None:
    """Capitals don't tell addresses apart, so the pseudonym is in small letters."""
    local, _, domain = text.lower().partition("@")
    labels = domain.split(".")
    if local[0] in ".-" or local[-1] == "." or ".." in local or not labels[-1].isalpha() or len(labels[-1]) < 2 or any(not x or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    name = _mixed(".".join(labels[:-1]), key, "domain", back)
    return f"{_mixed(local, key, 'local', back)}@{name}.{labels[-1]}"


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _mixed(plain[4:], key, "iban" + plain[:2], back)
    new = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Year first, day first (with dots) or month first (with slashes); 1900 to 2099."""
    sign = "." if "." in text else "/" if "/" in text else "-"
    x, y, z = text.split(sign)
    order = ("y", "m", "d") if len(x) == 4 else ("d", "m", "y") if sign == "." else ("m", "d", "y")
    got = dict(zip(order, map(int, (x, y, z)), strict=True))
    try:
        day = datetime.date(got["y"], got["m"], got["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST <= day <= LAST:
        return None
    new = datetime.date.fromordinal(FIRST + permute(day - FIRST, LAST - FIRST + 1, key, "date", back))
    return sign.join(f"{ {'y': new.year, 'm': new.month, 'd': new.day}[k]:0{4 if k == 'y' else 2}d}" for k in order)


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    value = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


# fixed values: country codes of one and two digits; all others have three
SHORT_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The country code stays and the national digits are permuted among those of their code and number, so that a number
    keeps its pseudonym however it is spelled.  Ten digits without a code, or behind a 1, are of code 1."""
    digits = "".join(filter(str.isdigit, text))
    if text[0] == "+":
        code = next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])
    else:
        code = "1" if len(digits) == 11 else ""
    number = digits[len(code) :]
    if not (len(number) == 10 if code in ("", "1") else 7 <= len(number) <= 14):
        return None
    new = permute(int(number), 10 ** len(number), key, f"phone {code or 1} {len(number)}", back)
    return _digits(text, f"{code}{new:0{len(number)}d}")


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = "".join(filter(str.isdigit, text))
    if not 13 <= len(digits) <= 19 or luhn(digits) or not digits.strip("0"):
        return None
    body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, 'card', back):0{len(digits) - 1}d}"
    return _digits(text, body + str(-luhn(body + "0") % 10))


_CHANGE: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
_SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-SU-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]\(?[0-9]{1,4}\)?){2,5})(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\g<sep>[0-9]{4}\g<sep>[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
_SHAPES["card"] = _SHAPES["card"].replace("([ -])", "(?P<sep>[ -])").replace(r"\g<sep>", "(?P=sep)")
_ANY = re.compile("|".join(f"(?P<{k}>{_SHAPES[k]})" for k in KINDS))
#: What any candidate has, of whatever shape (international numbers in short groups and IBANs with few digits in a row
#: too); a quick look for it spares the rest of the text.
HINT = r"@|[0-9]{4}|[0-9]\.[0-9]|[0-9][-/)]|\+[2-9][0-9]{0,2}[ .-]|[A-Z]{2}[0-9]{2}[ A-Z0-9]"


@lru_cache(1 << 16)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value (``back``: the value of a pseudonym), null if it isn't valid."""
    return _CHANGE[kind](text, key, back)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its valid values replaced, and (kind, start, end) of each in the old text."""
    out, found, at, done = [], [], 0, 0
    while m := _ANY.search(text, at):
        kind = m.lastgroup if m.lastgroup != "sep" else "card"
        if (new := pseudonym(kind, m[0], key, back)) is None:
            at = _after(m)
            continue
        out += [text[done : m.start()], new]
        found.append((kind, m.start(), m.end()))
        at = done = m.end()
    return ("".join(out) + text[done:], found) if found else (text, found)


def _after(m: re.Match) -> int:
    """Where to go on behind a candidate that isn't valid: behind its first run of digits or letters."""
    run = re.compile(r"[0-9A-Za-z]+|.", re.S).match(m.string, m.start())
    return run.end()


def _replaced(key: bytes, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            hint = pc.match_substring_regex(texts, HINT).fill_null(False).to_pylist()
            hits = [i for i, h in enumerate(hint) if h]
            done = [replace(texts[i].as_py(), key) for i in hits]
            mask = pa.array(hint)
            new = pc.replace_with_mask(texts, mask, pa.array([t for t, _ in done], texts.type))
            spans: list[str] = [""] * len(hint)
            for i, (_, found) in zip(hits, done, strict=True):
                spans[i] = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
            yield pa.RecordBatch.from_arrays([*[new if i == column else batch.column(i) for i in range(batch.num_columns)], pa.array(spans)], names=[*batch.schema.names, "pii_spans"])

    return run


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the valid values in ``text_col`` replaced, plus pii_spans (kind:start:end in the old text, comma-joined).

    A null text stays null and an empty one empty; neither has spans.  A very long
    text is read whole, in linear time.  Repeated rows change alike, whatever their
    id, and all other columns stay as they are.  A column named pii_spans is
    replaced.  An empty table gives an empty result.
    """
    secret = hashlib.sha256(key.encode()).digest()
    docs = docs.drop("pii_spans")
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_spans", T.StringType())])
    return docs.mapInArrow(_replaced(secret, docs.columns.index(text_col)), schema)
