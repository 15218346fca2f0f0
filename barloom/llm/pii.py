"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, schemes, digits and identifier cues. From each anchor a
deterministic local parser finds the boundary to both sides and validates what it holds; text without anchors
is never parsed. Anchors are found whatever the case of A-Z.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.shared import LOWER, UPPER

#: Kinds in the order that breaks ties of a start; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "secret")
#: Identifier cues, lower case; an account number follows within a few signs. Fixed values.
CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta")
#: Cues of secrets, lower case; an assigned value follows. Fixed values.
SECRET_CUES = ("token", "secret", "api_key", "api-key", "apikey", "access_key", "password", "passwd", "bearer")
#: A-Z lower-cased sign for sign, so that places stay.
FOLD = str.maketrans(UPPER, LOWER)

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
NOT_DIGIT = re.compile(r"[^0-9]+")
URL = re.compile(r"(?:[hH][tT][tT][pP][sS]?|[fF][tT][pP])://[^\s<>\"')\]}]*[^\s<>\"')\]}.,;:!?]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: An account number has 6 to 20 digits, letters before them aside; a longer run of digits or letters is no account number.
ACCOUNT = re.compile(r"(?:\x20?(?:number|no|nr|id))?[\x20.:#=-]{0,3}([A-Z]{0,3}[0-9][0-9-]{4,18}[0-9])(?![0-9A-Za-z])")
GAP = re.compile(r"[\x20:.#=-]{0,3}")
SECRET = re.compile(r"(?:[\"']?\x20{0,3}(?:[:=]|=>)\x20{0,3}[\"']?|\x20)([A-Za-z0-9_+/=.~-]{16,})")
SCHEMES = ("http://", "https://", "ftp://")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for sign in "@+0123456789":
        a.add_word(sign, sign if sign in "@+" else "0")
    for scheme in SCHEMES:
        a.add_word(scheme, scheme)
    for cue in (*CUES, *SECRET_CUES):
        a.add_word(cue, cue)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def secret_valid(value: str) -> bool:
    """A value that no one writes by hand: letters and digits mixed, and at least eight different signs."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 8


def local_start(text: str, at: int, least: int) -> int:
    """Where the run of local-part signs before the at-sign begins, at least or later."""
    step, high = 64, at
    while high > least:
        low = max(least, high - step)
        if m := NOT_LOCAL.search(text[low:high][::-1]):
            return high - m.start()
        high, step = low, step * 8
    return least


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, sorted. Base kinds are leftmost and don't overlap within a kind."""
    found: list[tuple[int, int, int]] = []
    past = dict.fromkeys((*KINDS, "digit"), 0)
    lower = text.lower() if text.isascii() else text.translate(FOLD)
    for last, sign in anchors.iter(lower):
        if sign == "0":
            if last >= past["digit"]:
                past["digit"] = digits(text, last, past, found)
        elif sign == "@":
            start = local_start(text, last, past["email"])
            if start < last and (m := DOMAIN.match(text, last)):
                found.append((start, 0, m.end()))
                past["email"] = m.end()
        elif sign == "+":
            if last >= past["phone"] and (m := PHONE.match(text, last)):
                past["phone"] = m.end()
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((last, 3, m.end()))
        elif sign in SCHEMES:
            if (start := last + 1 - len(sign)) >= past["url"] and (m := URL.match(text, start)):
                found.append((start, 4, m.end()))
                past["url"] = m.end()
        elif sign in SECRET_CUES:
            if last >= past["secret"] and (m := SECRET.match(text, last + 1)) and secret_valid(m[1].rstrip(".")):
                end = m.start(1) + len(m[1].rstrip("."))
                found.append((m.start(1), 7, end))
                past["secret"] = end
        elif last >= past["account"]:
            after = last + 1
            if sign == "iban":
                gap = GAP.match(text, after).end()
                if (m := IBAN.match(text, gap)) and iban_valid(m[0]):
                    found.append((gap, 5, m.end()))
                    past["account"] = m.end()
            elif m := ACCOUNT.match(text, after):
                found.append((m.start(1), 6, m.end()))
                past["account"] = m.end()
    return sorted(found)


def digits(text: str, at: int, past: dict[str, int], found: list[tuple[int, int, int]]) -> int:
    """Parses the run of digits at an anchor as address and as card; returns where the run ends."""
    run = at + 1
    n = len(text)
    while run < n and text[run] in "0123456789":
        run += 1
    if at >= past["ip"] and (m := IP.match(text, at)):
        past["ip"] = m.end()
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((at, 1, m.end()))
    if at >= past["card"] and (m := CARD.match(text, at)):
        past["card"] = m.end()
        number = NOT_DIGIT.sub("", m[0])
        if 14 <= len(number) <= 19 and luhn(number):
            found.append((at, 2, m.end()))
    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all kinds).

    spans lists kind:start:end, by start and then kind, comma-joined; places are code points, end exclusive. Null
    counts as empty. Repeated rows come back each; other columns are neither read nor returned.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                got = spans(text.as_py() or "", anchors)
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in got]
                base = ",".join(s for s, (_, k, _) in zip(said, got, strict=True) if k < 4)
                rows.append((*[sum(k == x for _, k, _ in got) for x in range(4)], hashlib.sha256(base.encode()).hexdigest(), ",".join(said), len(said)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op10(docs: DataFrame) -> DataFrame:
    return find_pii(docs)
