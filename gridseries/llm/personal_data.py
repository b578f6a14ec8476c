"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move their score.

Every span has a score between 0 and 1: what its pattern alone is worth, more
where a validator confirms it (Luhn, mod 97 of IBANs, the ranges of social security
numbers and addresses), more or less by the words around it. Four kinds
(`KINDS`) are always reported when pattern and validator hold, whatever their
score. The others (`MORE_KINDS`) are reported from `least_score` on: IBANs, social
security numbers, passport and national telephone numbers, and card or telephone numbers
inside a longer run of digit groups that is none as a whole.

Every pattern is anchored so that a scan takes time in proportion to the text,
also for a text that is one endless run of digits or letters.

Cases: a null or empty text has no spans; spans of one kind never overlap, an added
span never overlaps a span that is already there; null ids and repeated rows are
documents of their own; an empty table gives an empty result; other columns are
ignored; a digit is 0 to 9, a number in an address may have leading zeros.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from gridseries.llm.batches import id_and_text, slices

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "passport", "card_part", "phone_part", "local_phone")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
LEAST_SCORE = 0.5
NEAR = 48

# The forms of the four kinds that are always reported.
LOCAL_CHARS = string.ascii_letters + string.digits + "._%+-"
MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
DIGIT_GROUPS = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*+")
CARD_DIGITS = (12, 19)
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PHONE_DIGITS = (9, 15)

# The forms of the added kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
PASSPORT = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z][0-9]{8}|[A-Z]{2}[0-9]{7}|[0-9]{9})(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30|36|38")

# Words near a span that speak for its kind, and words that speak against it.
CONTEXT = {
    "email": "email e-mail mail contact write reach correo courriel kontakt",
    "ip": "ip address host server client login addr adresse dirección",
    "card": "card credit debit visa mastercard amex payment carte tarjeta karte",
    "phone": "phone tel telephone call mobile cell fax teléfono téléphone telefon handy",
    "iban": "iban account bank transfer konto compte cuenta banque",
    "ssn": "ssn social security",
    "passport": "passport passeport pasaporte reisepass",
}
CONTEXT |= {"card_part": CONTEXT["card"], "phone_part": CONTEXT["phone"], "local_phone": CONTEXT["phone"]}
AGAINST = {
    "ip": "version release firmware section chapter",
    "card": "isbn invoice order serial tracking part",
    "ssn": "part serial order",
    "passport": "order invoice part",
}
AGAINST |= {"card_part": AGAINST["card"]}
SUPPORT = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
DOUBT = {kind: frozenset(words.split()) for kind, words in AGAINST.items()}
BASE = {
    "email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.3, "passport": 0.2,
    "card_part": 0.2, "phone_part": 0.5, "local_phone": 0.3,
}
CONFIRMED = {"ip": 0.1, "card": 0.4, "phone": 0.1, "iban": 0.5, "ssn": 0.1, "card_part": 0.3}
CONTEXT_STEP = 0.3
NEAR_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, its digits added: the sum ends in 0."""
    values = [ord(c) - 48 for c in reversed(digits)]
    doubled = (2 * v - 9 * (v > 4) for v in values[1::2])
    return (sum(values[::2]) + sum(doubled)) % 10 == 0


def mod_97(iban: str) -> bool:
    """First four characters moved to the end, letters as 10 to 35: remainder 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: what stands before an @ belongs to it up to the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL_CHARS))
        host = MAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for match in ADDRESS.finditer(text):
        parts = [part.lstrip("0") or "0" for part in match.groups()]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            yield match.span()


def digit_groups(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, digits) of each longest run of digits with single blanks or hyphens between them."""
    for match in DIGIT_GROUPS.finditer(text):
        yield *match.span(), _only_digits(match[0])


def _card_parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole groups, from the left, that are card numbers of a known issuer."""
    groups = [(start + m.start(), start + m.end()) for m in re.finditer("[0-9]+", text[start:end])]
    free = 0
    for first in range(len(groups)):
        if first < free:
            continue
        digits = ""
        for last in range(first, len(groups)):
            a, b = groups[last]
            if len(digits) + b - a > CARD_DIGITS[1]:
                break
            digits += text[a:b]
            if len(digits) >= 13 and ISSUERS.match(digits) and luhn(digits):
                free = last + 1
                yield groups[first][0], b
                break


def _phone_part(match: re.Match) -> tuple[int, int] | None:
    """The longest beginning, ending with a group of digits, that is short enough for a telephone number."""
    least, most = PHONE_DIGITS
    found, digits = None, 0
    for group in re.finditer("[0-9]+", match[0]):
        digits += group.end() - group.start()
        if digits > most:
            break
        if digits >= least:
            found = match.start(), match.start() + group.end()
    return found


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Runs cut to the length of their country, if what follows is not part of the same group."""
    for match in IBAN.finditer(text):
        wanted = IBAN_CHARS.get(match[0][:2])
        places = [k for k, c in enumerate(match[0]) if c != " "]
        if wanted is None or len(places) < wanted:
            continue
        end = places[wanted - 1] + 1
        if (end == len(match[0]) or match[0][end] == " ") and mod_97(match[0][:end].replace(" ", "")):
            yield match.start(), match.start() + end


def social_numbers(text: str) -> Iterator[tuple[int, int]]:
    for match in SSN.finditer(text):
        area, group, serial = match.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield match.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Worth of a span by pattern, validator and the words at most `NEAR` code points away."""
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = {word for found in NEAR_WORD.findall(around.lower()) for word in (found, *found.split("-"))}
    step = bool(words & SUPPORT[kind]) - bool(words & DOUBT.get(kind, frozenset()))
    return round(min(1.0, max(0.0, BASE[kind] + CONFIRMED.get(kind, 0.0) + CONTEXT_STEP * step)), 3)


def base_spans(text: str) -> list[Span]:
    """The four kinds that are always reported, by start, then kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(a, b, "ip") for a, b in addresses(text)]
    least, most = CARD_DIGITS
    found += [(a, b, "card") for a, b, digits in digit_groups(text) if least <= len(digits) <= most and luhn(digits)]
    least, most = PHONE_DIGITS
    found += [(*m.span(), "phone") for m in PHONE.finditer(text) if least <= len(_only_digits(m[0])) <= most]
    spans = [Span(a, b, kind, score(text, kind, a, b)) for a, b, kind in found]
    return sorted(spans, key=lambda span: (span.start, KINDS.index(span.kind)))


def added_spans(text: str, taken: list[Span], least_score: float) -> list[Span]:
    """Spans of the other kinds with a high enough score that overlap nothing found before them."""
    found = [(a, b, "iban") for a, b in ibans(text)]
    found += [(a, b, "ssn") for a, b in social_numbers(text)]
    found += [(*m.span(), "passport") for m in PASSPORT.finditer(text)]
    for start, end, digits in digit_groups(text):
        least, most = CARD_DIGITS
        if len(digits) >= 13 and not (len(digits) <= most and luhn(digits)):
            found += [(a, b, "card_part") for a, b in _card_parts(text, start, end)]
    for match in PHONE.finditer(text):
        part = _phone_part(match) if len(_only_digits(match[0])) > PHONE_DIGITS[1] else None
        found += [(*part, "phone_part")] if part else []
    found += [(*m.span(), "local_phone") for m in LOCAL_PHONE.finditer(text)]
    # `taken` spans of different kinds may overlap each other: the covered places, merged.
    covered: list[tuple[int, int]] = []
    for span in taken:
        if covered and span.start < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(covered[-1][1], span.end))
        else:
            covered.append((span.start, span.end))
    ends = [b for _, b in covered]
    free = []
    for a, b, kind in found:
        k = bisect_left(ends, a + 1)
        if k == len(covered) or covered[k][0] >= b:
            free.append(Span(a, b, kind, score(text, kind, a, b)))
    free = [span for span in free if span.score >= least_score]
    out: list[Span] = []
    for span in sorted(free, key=lambda s: (s.start, -s.score, MORE_KINDS.index(s.kind))):
        if not out or span.start >= out[-1].end:
            out.append(span)
    return out


def personal_spans(text: str, least_score: float = LEAST_SCORE) -> list[Span]:
    """All spans of a text by start, then kind in the order of `KINDS` and `MORE_KINDS`."""
    spans = base_spans(text)
    order = {kind: k for k, kind in enumerate(KINDS + MORE_KINDS)}
    return sorted(spans + added_spans(text, spans, least_score), key=lambda s: (s.start, order[s.kind]))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE
) -> DataFrame:
    """One row per document: (id, spans), places in code points, end exclusive, by start, then kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
        kind = pa.list_(pa.struct(fields))
        for batch in slices(batches):
            rows = [[s._asdict() for s in personal_spans(text, least_score)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, text) with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""

    def clean(text: str) -> str:
        out, at = [], 0
        for span in personal_spans(text, least_score):
            if span.start >= at:
                out += [text[at : span.start], f"<{span.kind}>"]
            at = max(at, span.end)
        return "".join(out) + text[at:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([clean(text) for text in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts], ["id", "text"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(scan, "id long, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
