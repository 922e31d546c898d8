"""Personal data: patterns propose spans, checksums confirm, context scores.

Kinds email, ip, card and phone are the base kinds; their spans are fixed by
pattern and check alone and always stay.  The further kind ``iban`` is
proposed by a pattern, confirmed by its country's length and mod-97, and
kept if its score, raised by words such as "IBAN" or "account" and lowered
by words such as "example" within ``CONTEXT`` characters, reaches
``LEAST_SCORE``.  Base spans get a score as well, for consumers that rank.

Plan: one scan and one Arrow map; no shuffle.  Each pattern is linear in the
text: digit runs start where no digit precedes, and addresses are found from
their "@", so a long run without one costs a single pass.

Defined results: a null or empty text has no spans and the SHA-256 of the
empty text; offsets are code points, end exclusive; a match that fails its
check is dropped and not retried; spans that start together stand in the
order of ``KINDS``; repeated rows are treated alike; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
CONTEXT = 40
LEAST_SCORE = 0.6

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A dotted number can only start where its run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
#: Words that make a kind likelier, and words that make any kind less likely.
NEAR = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
AGAINST = ("example", "sample", "test", "dummy", "version")
WORDS = re.compile(r"[^\W\d_]+")
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", end if found else at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def numbers(pattern: re.Pattern, least: int, most: int, check, text: str) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        digits = "".join(c for c in m[0] if "0" <= c <= "9")
        if least <= len(digits) <= most and check(digits):
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal is cut at its country's length; it must end at a word's end there."""
    for m in IBAN.finditer(text):
        want, taken = IBAN_LENGTH.get(m[0][:2]), 0
        for k, c in enumerate(m[0]):
            taken += c != " "
            if taken == want:
                end = m.start() + k + 1
                if (end == len(text) or not text[end].isalnum()) and mod97(m[0][: k + 1].replace(" ", "")):
                    yield m.start(), end
                break


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted, of every confirmed span."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    found += [(a, 1, b) for a, b in ips(text)]
    found += [(a, 2, b) for a, b in numbers(CARD, 12, 19, luhn, text)]
    if "+" in text:
        found += [(a, 3, b) for a, b in numbers(PHONE, 9, 15, lambda _: True, text)]
    found += [(a, 4, b) for a, b in ibans(text)]
    return sorted(found)


def score(text: str, start: int, kind: str, end: int) -> float:
    """Start value of the kind, 0.2 more with a supporting word near, 0.3 less with an opposing one."""
    near = {w.lower() for w in WORDS.findall(text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT])}
    out = START[kind] + 0.2 * any(w in near for w in NEAR[kind]) - 0.3 * any(w in near for w in AGAINST)
    return min(1.0, round(out, 2))


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans kept; base kinds always stay."""
    text = text or ""
    out = [(KINDS[k], a, b, score(text, a, KINDS[k], b)) for a, k, b in spans_of(text)]
    return [x for x in out if x[0] in BASE or x[3] >= LEAST_SCORE]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _map(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], ["doc_id", "found"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: an array of (kind, start, end, score) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_map, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b, _ in find(text):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """The counts, hash and span list of ``found`` by document."""
    as_text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, as_text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", as_text), ",").alias("spans"),
        F.transform("found", lambda x: x["score"]).alias("scores"),
    )


