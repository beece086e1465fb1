"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score of the rest."""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import merged, per_batch, table

#: Kinds of the base contract, in order, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "call")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run that a match could begin in only begins at its first digit: the rest of the pattern is the same from inside it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
CALL = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])")

#: Score before and after context; spans of the added kinds need ACCEPT.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "call": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "call": ("phone", "call", "tel", "mobile", "fax"),
}
BOOST, WINDOW, ACCEPT = 0.35, 48, 0.5
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Mod-10 check of a digit string."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(x * 2 - 9 * (x > 4) for x in map(int, digits[-2::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _octet(digits: str) -> bool:
    """At most 255; the digits may be any number of zeros and more."""
    value = digits.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def _emails(text: str) -> list[tuple[int, int]]:
    """Around each @, in time linear in the text: the local part is the run before it, not reaching into the last match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return found


def _ibans(text: str) -> list[tuple[int, int]]:
    """At each start the stretch of the country's length if its checksum holds, or else the longest of 15 characters or more
    to the end of a word for which it holds."""
    found, at = [], 0
    while m := IBAN.search(text, at):
        s, e = m.span()
        own = re.match(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % IBAN_LENGTHS.get(m[0][:2], 99), m[0])
        if own and mod97(own[0].replace(" ", "")):
            at = s + own.end()
            found.append((s, at))
            continue
        while not mod97(text[s:e].replace(" ", "")):
            e = text.rfind(" ", s, e)
            if e < 0 or len(text[s:e].replace(" ", "")) < 15:
                break
        else:
            found.append((s, e))
            at = e
            continue
        at = s + 1
    return found


def _context(text: str, start: int, end: int, words: tuple[str, ...]) -> bool:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    own = {w.lower() for w in WORD.findall(near)}
    return any(any(o.startswith(w) for o in own) if len(w) > 2 else w in own for w in words)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end (code points, end exclusive), score: by kind as listed, then start. Added spans don't overlap base ones."""
    found = [("email", s, e) for s, e in _emails(text)]
    digits = re.search("[0-9]", text)
    if digits:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(_octet(x) for x in m[0].split("."))] if "." in text else []
        for m in CARD.finditer(text, digits.start()):
            number = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(number) <= 19 and luhn(number):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    base = [(k, s, e, min(1.0, PRIOR[k] + BOOST * _context(text, s, e, CONTEXT[k]))) for k, s, e in found]
    added = []
    if digits:
        starts, ends = merged([(s, e) for _, s, e in found])
        for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("call", CALL)):
            for s, e in _ibans(text) if kind == "iban" else (m.span() for m in pattern.finditer(text)):
                at = bisect_left(ends, s + 1)  # the first taken stretch that ends after the span begins
                if at < len(starts) and starts[at] < e:
                    continue
                score = min(1.0, PRIOR[kind] + BOOST * _context(text, s, e, CONTEXT[kind]))
                if score >= ACCEPT:
                    added.append((kind, s, e, score))
                    starts.insert(at, s)
                    ends.insert(at, e)
    return base + added


def joined(found: list[tuple]) -> str:
    return ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in found)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, score) for every row of docs (doc_id, text).

    A null or empty text has no spans. Repeated rows and rows without a doc_id stay; other columns aren't read. There is no
    shuffle: texts are scanned where they are read.
    """
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"

    def f(batch: pa.RecordBatch) -> dict:
        found = [spans(t or "") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "spans": [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in own] for own in found]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, f)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, in place; of spans that overlap the first, then the longest.

    A null or empty text stays as it is. Repeated rows and all other columns, whatever their names, stay too.
    """
    names, schema = docs.columns, docs.schema

    def f(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column(names.index("text")).to_pylist():
            if text:
                at, parts = 0, []
                for kind, s, e, _ in sorted(spans(text), key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [text[at:s], f"[{kind}]"]
                    at = max(at, e)
                text = "".join(parts) + text[at:]
            out.append(text)
        return {x: out if x == "text" else batch.column(i) for i, x in enumerate(names)}

    return per_batch(docs, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema), f)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of every document."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def f(batch: pa.RecordBatch) -> dict:
        found = [[(x["kind"], x["start"], x["end"]) for x in own] for own in batch.column(1).to_pylist()]
        out = {f"n_{k}": [sum(x[0] == k for x in own) for own in found] for k in BASE}
        return out | {
            "doc_id": batch.column(0),
            "base_sha256": [sha256(joined([x for x in own if x[0] in BASE]).encode()).hexdigest() for own in found],
            "spans": [joined(own) for own in found],
        }

    return per_batch(detect(table(spark, sf_dir, "documents")), schema, f)
