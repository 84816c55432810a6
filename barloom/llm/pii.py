"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Two layers share one result. The base layer has fixed patterns for e-mail addresses, IPv4 addresses, payment cards and
phone numbers; a match that fails its test (octets, Luhn, digit count) is dropped. The scored layer then proposes more
candidates: parts of digit runs in which several numbers stand side by side, IBANs (mod 97), hexadecimal secrets, and
national identity and phone numbers that only a context word makes credible. A candidate is kept from ``threshold`` on.
Base spans always stay.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, per_text

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

# Each run of digits is entered at its first digit and possessively, so long runs take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_INTERNATIONAL = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9])")
_CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])")

#: Words within CONTEXT characters before a candidate that raise its score, by kind.
CONTEXT = 40
WORDS = {
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "secret": ("token", "key", "secret", "password", "api"),
    "id": ("ssn", "social security", "identity", "tax id"),
}
#: Score of a candidate before context, and what a context word adds.
PRIOR = {"card": 0.7, "phone": 0.6, "iban": 0.8, "secret": 0.3, "id": 0.3, "national": 0.3}
BONUS = 0.3


def luhn(digits: str) -> bool:
    """The check digit of payment card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check digits of IBANs: the country code moved to the end, letters as 10 to 35, leave 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # from each "@": the domain to the right, then the longest local part to the left; no pass over runs without "@"
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL_END.match(text[begin - 1]):
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        else:
            done = max(done, begin)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base layer, by kind as in KINDS, then by start."""
    out = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Spans:
    """Spans of one kind that don't overlap, in order; candidates come in runs, each in order of its own."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, start)
        return (i == len(self.starts) or self.starts[i] >= end) and (i == 0 or self.ends[i - 1] <= start)

    def add(self, spans: list[tuple[int, int]]) -> None:
        both = sorted([*zip(self.starts, self.ends, strict=True), *spans])
        self.starts, self.ends = [s for s, _ in both], [e for _, e in both]


def scored_spans(text: str, base: list[tuple[str, int, int]], threshold: float) -> list[tuple[str, int, int, float]]:
    """What the scored layer adds to the base spans of a text."""
    out: list[tuple[str, int, int, float]] = []
    taken: dict[str, Spans] = {}
    for kind in {k for k, *_ in base}:
        taken.setdefault(kind, Spans()).add([(s, e) for k, s, e in base if k == kind])

    def propose(kind: str, spans: Iterable[tuple[int, int]], prior: float) -> None:
        """Spans of one pattern, in order and apart from each other."""
        own, kept = taken.setdefault(kind, Spans()), []
        for start, end in spans:
            if own.free(start, end):
                before = text[max(0, start - CONTEXT) : start].lower()
                score = min(1.0, prior + BONUS * any(w in before for w in WORDS[kind]))
                if score >= threshold:
                    kept.append((start, end))
                    out.append((kind, start, end, score))
        own.add(kept)

    propose("card", (m.span() for m in _CARD_PART.finditer(text) if luhn(_digits(m[0]))), PRIOR["card"])
    if "+" in text:
        propose("phone", (m.span() for m in _INTERNATIONAL.finditer(text) if 9 <= len(_digits(m[0])) <= 15), PRIOR["phone"])
    propose("phone", (m.span() for m in _NATIONAL.finditer(text)), PRIOR["national"])
    propose("iban", (m.span() for m in _IBAN.finditer(text) if 15 <= len(s := m[0].replace(" ", "")) <= 34 and mod97(s)), PRIOR["iban"])
    propose("secret", (m.span() for m in _SECRET.finditer(text)), PRIOR["secret"])
    propose("id", (m.span() for m in _ID.finditer(text)), PRIOR["id"])
    return out


def find_spans(text: str | None, threshold: float) -> list[dict]:
    """All spans of one text; positions are code points, ``end`` exclusive. Sorted by kind (KINDS first), then start."""
    if not text:
        return []
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, "iban", "id", "secret"))}
    found = [(k, s, e, 1.0, True) for k, s, e in base] + [(*x, False) for x in scored_spans(text, base, threshold)]
    return [dict(zip(("kind", "start", "end", "score", "base"), x, strict=True)) for x in sorted(found, key=lambda x: (order[x[0]], x[1]))]


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Spans of personal data in each text: ``doc_id``, ``pii`` (array of kind, start, end, score, base).

    One row per input row, repeated rows included; no shuffle. A null or empty text has an empty array. Other columns
    are not read, so their names can't clash. Takes time in proportion to the text, times the logarithm of its spans.
    """

    def spans(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([find_spans(t, threshold) for t in texts], _ARROW)]

    return per_text(docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), f"pii {SPANS}", spans)


def span_digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the base spans' SHA-256 and all spans as text, from detect_pii()'s rows."""
    base = F.filter("pii", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"))
