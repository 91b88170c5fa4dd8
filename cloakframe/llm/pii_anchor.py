"""Personal data by anchor expansion.

An Aho-Corasick automaton finds short anchors (at-signs, schemes, digit pairs,
plus-digit, account cues) in one pass; around each anchor a deterministic local
parser expands to the boundaries of the candidate and validates it. Cost follows
the number of anchors, and no regular expression runs over the text.

Defined results: null text counts as empty (no spans); rows repeat as given;
null ids stay null; extra columns of the input are ignored; offsets are code
points, end exclusive.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from .common import map_texts, span_digest

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban")
DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_STOP = frozenset("<>\"'`{}|\\^")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("IBAN", "iban", "Iban")


def anchors() -> dict[str, str]:
    """Each anchor string and the parser it starts."""
    pairs = {a + sep + b: "digits" for a in DIGITS for sep in ("", " ", "-") for b in DIGITS}
    dots = {f"{a}.{b}": "ip" for a in DIGITS for b in DIGITS}
    return {"@": "email"} | pairs | dots | {f"+{d}": "phone" for d in DIGITS} | dict.fromkeys(SCHEMES, "url") | dict.fromkeys(CUES, "iban")


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in anchors().items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def right(text: str, at: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters from `at`."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def left(text: str, at: int, allowed: frozenset, floor: int) -> int:
    """The start of the run of allowed characters that ends before `at`."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand an at-sign; `floor` is the end of the e-mail address found before."""
    start, end = left(text, at, LOCAL, floor), right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := right(text, end + 1, LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels else None


def chain_end(text: str, start: int, separators: str) -> int:
    """The end of digits joined by single separators, from a digit."""
    end = right(text, start, DIGITS)
    while end + 1 < len(text) and text[end] in separators and text[end + 1] in DIGITS:
        end = right(text, end + 1, DIGITS)
    return end


def chain_start(text: str, at: int, separators: str) -> int:
    start = left(text, at, DIGITS, 0)
    while start > 1 and text[start - 1] in separators and text[start - 2] in DIGITS:
        start = left(text, start - 1, DIGITS, 0)
    return start


def addresses(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Fours of dotted parts, from the left of a chain; a four with a part over 255 is dropped whole."""
    parts, at, out = text[start:end].split("."), start, []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        stop = at + sum(map(len, four)) + 3
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
            out.append((at, stop))
        at = stop + 1
    return out


def phone(text: str, at: int) -> tuple[int, int] | None:
    """Expand a plus sign that a digit follows."""
    end = right(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return None
    return (at, end) if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None


def url(text: str, at: int, body: int) -> tuple[int, int] | None:
    if body >= len(text) or text[body] not in ALNUM:
        return None
    end = body
    while end < len(text) and text[end] not in URL_STOP and not text[end].isspace():
        end += 1
    while end > body and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (at, end) if end > body else None


def iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number after its cue: country, check digits, 11 to 30 characters, remainder 1 by 97."""
    start = at
    while start < len(text) and text[start] in " :=#":
        start += 1
    end, compact = start, ""
    while end < len(text) and (text[end] in ALNUM or text[end] == " " and end + 1 < len(text) and text[end + 1] in ALNUM) and len(compact) < 34:
        compact += text[end].strip().upper()
        end += 1
        size = len(compact)
        boundary = end == len(text) or text[end] not in ALNUM
        if 15 <= size and boundary and compact[:2].isalpha() and compact[2:4].isdigit():
            number = "".join(str(int(c, 36)) for c in compact[4:] + compact[:4])
            if int(number) % 97 == 1:
                return (start, end)
    return None


class AnchorScanner:
    def __init__(self) -> None:
        self.machine = automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by kind as listed, then start."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
        email_end = digits_end = ip_end = url_end = 0
        for last, (kind, size) in self.machine.iter(text):
            at = last - size + 1
            if kind == "email":
                if got := email(text, at, email_end):
                    found["email"].append(got)
                    email_end = got[1]
            elif kind == "digits":
                if at >= digits_end:
                    start = chain_start(text, at, " -")
                    digits_end = chain_end(text, start, " -")
                    number = text[start:digits_end].replace(" ", "").replace("-", "")
                    if 13 <= len(number) <= 19 and luhn(number):
                        found["card"].append((start, digits_end))
            elif kind == "ip":
                if at >= ip_end:
                    start = chain_start(text, at, ".")
                    ip_end = chain_end(text, start, ".")
                    found["ip"] += addresses(text, start, ip_end)
            elif kind == "phone":
                if got := phone(text, at):
                    found["phone"].append(got)
            elif kind == "url":
                if at >= url_end and (got := url(text, at, last + 1)):
                    found["url"].append(got)
                    url_end = got[1]
            elif got := iban(text, last + 1):
                found["iban"].append(got)
        return [(k, a, b) for k, each in found.items() for a, b in each]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (array of kind, start, end; by kind as listed, then start) for every row."""

    def make():
        scanner = AnchorScanner()
        return lambda text: ([{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(text)],)

    return map_texts(df, id_col, text_col, make, "spans array<struct<kind:string,start:int,end:int>>")


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as one string."""

    def make():
        scanner = AnchorScanner()

        def run(text: str) -> tuple:
            spans = scanner.spans(text)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == k for s in base) for k in BASE_KINDS]
            return (*counts, hashlib.sha256(span_digest(base).encode()).hexdigest(), span_digest(spans))

        return run

    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return map_texts(df, id_col, text_col, make, f"{counts}, base_sha256 string, spans string")
