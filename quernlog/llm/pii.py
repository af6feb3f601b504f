"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and cue
words.  From each anchor a deterministic local parser expands to the boundaries of an email, ip,
card, phone, url, postal address or account identifier, and validates it.  A parser resumes where
its last match of that kind ended, so base kinds equal the leftmost non-overlapping matches of
their patterns; work stays linear in the text.

Defined results: a null or empty text has no spans; repeated rows give repeated results; an empty
table gives no rows; a null doc_id stays null; other columns are ignored by ``find_pii`` and kept
by ``mask_pii``.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_chunks

#: The order of kinds in results; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "address", "account")
BASE = 4
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

#: The length of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}

#: Cue words that stand before an identifier, and words of street names.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "routing", "passport", "ssn", "token", "api_key", "apikey", "secret", "password", "passwd")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive", "straße", "strasse", "rue", "calle", "avenida")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_TAIL = re.compile(r"[A-Za-z0-9\-._~%!$&'()*+,;=:@/?#\[\]]+")
_ACCOUNT = re.compile(r"(?:\x20(?:no|nr|number|id)\b\.?)?\x20?[:=#]\x20?[\"']?([A-Za-z0-9][A-Za-z0-9_\-]{5,})")
_IBAN = re.compile(r"[:\x20]{1,2}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_HOUSE_BEFORE = re.compile(r"[0-9]{1,5}[A-Za-z]?\x20(?:[^\W\d_][\w'.-]*\x20){1,4}$")
_HOUSE_AFTER = re.compile(r"(?:\x20[^\W\d_][\w'.-]*){0,4},?\x20[0-9]{1,5}[A-Za-z]?\b")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _iban_holds(raw: str) -> bool:
    s = raw.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(text: str, start: int, end: int) -> int:
    """Where an IBAN in the run from ``start`` to ``end`` ends, or 0: at its country's length, else at the last end of a word where it holds."""
    places = [i + 1 for i in range(start, end) if text[i] != " "]
    known = IBAN_LENGTHS.get(text[start : start + 2], 0)
    if 0 < known <= len(places) and _iban_holds(text[start : (own := places[known - 1])]) and (" " in text[start:own] or own == len(text) or not text[own].isalnum()):
        return own
    for own in reversed(places[14:]):
        if (own == len(text) or not text[own].isalnum()) and _iban_holds(text[start:own]):
            return own
    return 0


def anchors():
    """The automaton: each anchor's parser and length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, words in (("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for w in words:
            for form in {w, w.capitalize(), w.upper()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def spans_of(text: str, automaton) -> list[Span]:
    """All spans (kind, start, end) by kind, then start."""
    found: list[Span] = []
    email_end = ip_end = card_end = phone_end = url_end = address_end = account_end = 0
    for last, (kind, width) in automaton.iter(text):
        at = last - width + 1
        if kind == "digit":
            if at >= card_end:
                m = _CARD.match(text, at)
                card_end = m.end() if m else at + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found.append((2, at, card_end))
            if at >= ip_end:
                m = _IP.match(text, at)
                ip_end = m.end() if m else _DIGITS.match(text, at).end()
                if m and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
                    found.append((1, at, ip_end))
        elif kind == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((0, start, email_end))
        elif kind == "plus":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append((3, at, phone_end))
        elif kind == "scheme":
            start = at
            while start > max(url_end, at - 12) and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := _URL_TAIL.match(text, last + 1)):
                end = last + 1 + len(m.group().rstrip(".,;:!?)'"))
                if end > last + 1:
                    url_end = end
                    found.append((4, start, end))
        elif at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            continue  # a cue begins a word
        elif kind == "account":
            if last < account_end:
                continue
            if (m := _IBAN.match(text, last + 1)) and (end := _iban_end(text, m.start(1), m.end(1))):
                account_end = end
            elif (m := _ACCOUNT.match(text, last + 1)) and any(c.isdigit() for c in m.group(1)):
                account_end = m.end(1)
            else:
                continue
            found.append((6, m.start(1), account_end))
        elif last + 1 == len(text) or not text[last + 1].isalnum():
            if at >= address_end and (m := _HOUSE_BEFORE.search(text[max(address_end, at - 80) : at])):
                start = max(address_end, at - 80) + m.start()
                address_end = last + 1
                found.append((5, start, address_end))
            elif at >= address_end and (m := _HOUSE_AFTER.match(text, last + 1)):
                address_end = m.end()
                found.append((5, at, address_end))
    return sorted(found)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, longest one names the whole."""
    out, at = [], 0
    for a, b, k in sorted(((a, -b, k) for k, a, b in spans)):
        b = -b
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = anchors()
    for chunk in text_chunks(batches):
        counts: list[list[int]] = [[], [], [], []]
        digests, everything = [], []
        for text in chunk.column("text").to_pylist():
            spans = spans_of(text or "", automaton)
            base = [s for s in spans if s[0] < BASE]
            for k in range(BASE):
                counts[k].append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            everything.append(spans_text(spans))
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(everything, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts and digest of the base spans, and all spans."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_find, SCHEMA)


def _masker(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for chunk in text_chunks(batches):
            texts = [t and masked(t, spans_of(t, automaton)) for t in chunk.column("text").to_pylist()]
            at = columns.index("text")
            kept = [chunk.column(i) for i in range(chunk.num_columns)]
            kept[at] = pa.array(texts, chunk.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(kept, names=columns)

    return mask


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; n_chars, where present, is set anew."""
    bounded_batches(docs.sparkSession)
    out = docs.mapInArrow(_masker(docs.columns), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
