"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds: email, ip, card (Luhn), phone, iban (mod 97) and ssn. The first four are the base kinds; every confirmed
base span is reported, with its score. An iban needs its country's length and a valid checksum, an ssn a hint among
the words around it, since its shape alone is common. Scores start at the kind's own confidence and move with the words
around the span; an added kind is reported from a score of ``LEAST``, so that context decides: an iban among words
that speak against it, and for nothing, is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Confidence of a confirmed span before its context is read.
PRIOR = {"email": 0.95, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.65, "ssn": 0.35}
#: Score from which a span of a kind that is not a base kind is reported.
LEAST = 0.5
BONUS, MALUS, REACH = 0.25, 0.2, 48
# Words that speak for a kind, and against personal data.
HINTS = {
    "email": {"email", "e-mail", "mail", "contact", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "login", "adresse"},
    "card": {"card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
}
AGAINST = {"version", "example", "test", "sample", "isbn", "build", "release"}
# The shapes of the kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2})[0-9]{2})")
# Characters of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]")
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, str, float]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping ``local@domain.domain``: each @ is extended to the left as far as the last match
    allows, which a pattern tried at every character would do in quadratic time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Codes of their country's length that pass mod 97, closed up or in groups of four; what follows in the next
    group does not belong to them."""
    done = 0
    for m in IBAN.finditer(text):
        size = IBAN_LENGTH.get(m[1])
        if size is None or m.start() < done:
            continue
        for end in (m.start() + size, m.start() + size + (size - 1) // 4):
            code = text[m.start():end]
            if end > m.start() + size:
                groups = code.split(" ")
                code = "".join(groups) if all(len(g) == 4 for g in groups[:-1]) else ""
            after = text[end:end + 1]
            if (len(code) == size and code.isascii() and code.isalnum() and code == code.upper()
                    and not (after.isascii() and after.isalnum()) and mod97(code)):
                done = end
                yield m.start(), end
                break


def octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def proposed(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed spans of every kind, kind by kind."""
    for start, end in emails(text):
        yield start, end, "email"
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            yield m.start(), m.end(), "ip"
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), "card"
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.start(), m.end(), "phone"
    for start, end in ibans(text):
        yield start, end, "iban"
    for m in SSN.finditer(text):
        yield m.start(), m.end(), "ssn"


def scored(text: str, start: int, end: int, kind: str) -> float:
    """The kind's prior, raised by a hint among the words before or just after, lowered by words that speak
    against personal data."""
    near = re.split(r"[^\w-]+", (text[max(0, start - REACH):start] + " " + text[end:end + REACH // 2]).lower())
    score = PRIOR[kind] + BONUS * (not HINTS[kind].isdisjoint(near)) - MALUS * (not AGAINST.isdisjoint(near))
    return round(min(1.0, max(0.0, score)), 4)


def find(text: str | None) -> list[Span]:
    """(start, end, kind, score) by start, then kind as listed; offsets are code points, the end exclusive.
    Null and empty texts have none."""
    if not text:
        return []
    spans = [(a, b, kind, scored(text, a, b, kind)) for a, b, kind in proposed(text)]
    return sorted((s for s in spans if s[2] in BASE or s[3] >= LEAST), key=lambda s: (s[0], KINDS.index(s[2])))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<start, end, kind, score>>) of every row, in one pass without a shuffle.

    Every row gives one row, repeated and null keys included; null and empty texts have no spans; extra columns
    are ignored. A text is searched whole, in time linear in its length.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("start", "end", "kind", "score"), s)) for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found)], ["key", "spans"])

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, spans array<struct<start:long,end:long,kind:string,score:double>>").withColumnRenamed("key", key)
