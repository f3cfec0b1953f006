"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits, schemes and words
that introduce an identifier) in one pass over a text; a deterministic parser per kind then walks
outwards from each anchor over the bytes around it and validates what it finds. A text without
anchors costs nothing but that pass.

Kinds email, ip, card and phone are the base kinds; userinfo (credentials in an address), iban
and account (a number that a cue word introduces) are added. Defined results: a null text is
empty and has no span; spans are in code points, end exclusive; kinds may overlap, spans of one
kind don't; repeated rows are reported each; an empty table gives no row; columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "userinfo", "iban", "account")

#: Words that introduce an account or identity number, lower case. Fixed values.
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte", "ssn", "passport")

DIGIT = frozenset(b"0123456789")
ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset(b"._%+-")
LABEL = ALNUM | frozenset(b"-")
PHONE = DIGIT | frozenset(b" ().-")


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, (c if c in "@+" else "digit", 1))
    found.add_word("://", ("scheme", 3))
    found.add_word("iban", ("iban", 4))
    for word in ACCOUNT_CUES:
        found.add_word(word, ("account", len(word)))
    found.make_automaton()
    return found


def run(data: bytes, at: int, among: frozenset) -> int:
    """Where the bytes from at on leave the set."""
    n = len(data)
    while at < n and data[at] in among:
        at += 1
    return at


def email_at(data: bytes, at: int, floor: int) -> tuple[int, int] | None:
    """Email around the at-sign; its local part begins at floor or later."""
    start = at
    while start > floor and data[start - 1] in LOCAL:
        start -= 1
    end = run(data, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(data) and data[end] == 46:
        more = run(data, end + 1, LABEL)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels > 1 else None


def ip_at(data: bytes, at: int) -> tuple[int, bool] | None:
    """End of the four dotted digit runs from at on, and whether each is at most 255."""
    end, valid = at, True
    for k in range(4):
        if k:
            if end >= len(data) or data[end] != 46:
                return None
            end += 1
        more = run(data, end, DIGIT)
        if more == end:
            return None
        part = data[end:more].lstrip(b"0")
        valid &= len(part) <= 3 and int(part or b"0") <= 255
        end = more
    return end, valid


def card_at(data: bytes, at: int) -> int:
    """End of the digits from at on, with at most one space or hyphen between two of them."""
    end, n = at + 1, len(data)
    while end < n:
        if data[end] in DIGIT:
            end += 1
        elif data[end] in b" -" and end + 1 < n and data[end + 1] in DIGIT:
            end += 2
        else:
            break
    return end


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(data: bytes) -> bytes:
    return bytes(c for c in data if c in DIGIT)


def phone_at(data: bytes, at: int) -> int | None:
    """End of the number after the plus sign: its last digit, with something between it and the first."""
    if at + 1 >= len(data) or data[at + 1] not in DIGIT:
        return None
    end = run(data, at + 2, PHONE)
    while end > at + 3 and data[end - 1] not in DIGIT:
        end -= 1
    return end if end > at + 3 else None


def userinfo_at(data: bytes, at: int) -> tuple[int, int] | None:
    """user:password@host after a scheme's slashes, from the user on."""
    stop = run(data, at, LOCAL | frozenset(b":!$&*@~"))
    sign = data.rfind(b"@", at, stop)
    if sign <= at or b":" not in data[at:sign]:
        return None
    end = run(data, sign + 1, LABEL | frozenset(b"."))
    return (at, end) if end > sign + 1 else None


def iban_at(data: bytes, at: int) -> tuple[int, int] | None:
    """A number after the cue that passes mod 97; blanks may group it."""
    while at < len(data) and data[at] in b" :=#.":
        at += 1
    compact, end = b"", at
    i = at
    while i < len(data) and len(compact) < 34:
        if data[i] in ALNUM:
            compact += data[i : i + 1]
            i += 1
            if len(compact) >= 15 and compact[:2].isalpha() and compact[2:4].isdigit():
                turned = (compact[4:] + compact[:4]).upper()
                if int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1 and (i >= len(data) or data[i] not in ALNUM):
                    end = i
        elif data[i] == 32 and i + 1 < len(data) and data[i + 1] in ALNUM:
            i += 1
        else:
            break
    return (at, end) if end > at else None


def account_at(data: bytes, at: int) -> tuple[int, int] | None:
    """6 to 20 digits, hyphens between them, after the cue, an optional 'number', 'no' or 'nr' and marks."""
    marks = frozenset(b" .:#=")
    at = run(data, at, marks)
    for word in (b"number", b"no", b"nr"):
        if data[at : at + len(word)].lower() == word:
            at = run(data, at + len(word), marks)
            break
    end = run(data, at, DIGIT | frozenset(b"-"))
    while end > at and data[end - 1] == 45:
        end -= 1
    if end == at or data[at] == 45 or (end < len(data) and data[end] in ALNUM):
        return None
    return (at, end) if 6 <= len(only_digits(data[at:end])) <= 20 else None


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of every span, in order, in code points."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    digits_end = 0

    def add(kind: str, start: int, end: int) -> None:
        spans.append((start, KINDS.index(kind), end))

    for last, (cue, length) in automaton().iter(data.translate(LOWER).decode("latin-1")):
        at = last + 1 - length
        if cue == "digit":
            if at < digits_end:
                continue
            digits_end = run(data, at, DIGIT)
            if at >= done["ip"] and (found := ip_at(data, at)):
                done["ip"] = found[0]
                if found[1]:
                    add("ip", at, found[0])
            if at >= done["card"]:
                end = done["card"] = card_at(data, at)
                digits = only_digits(data[at:end]) if end - at >= 14 else b""
                if 14 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, end)
        elif cue == "@":
            if found := email_at(data, at, done["email"]):
                done["email"] = found[1]
                add("email", *found)
        elif cue == "+":
            if at >= done["phone"] and (end := phone_at(data, at)):
                done["phone"] = end
                if 10 <= len(only_digits(data[at:end])) <= 15:
                    add("phone", at, end)
        else:
            parse = {"scheme": userinfo_at, "iban": iban_at, "account": account_at}[cue]
            kind = {"scheme": "userinfo"}.get(cue, cue)
            if last + 1 >= done[kind] and (found := parse(data, last + 1)):
                done[kind] = found[1]
                add(kind, *found)
    if not spans:
        return []
    spans.sort()
    if len(data) == len(text):
        return spans
    marks = sorted({x for a, _, b in spans for x in (a, b)})
    points, seen, at = {}, 0, 0
    for m in marks:  # bytes to code points, each byte decoded once
        seen += len(data[at:m].decode("utf-8", "surrogatepass"))
        at = m
        points[m] = seen
    return [(points[a], k, points[b]) for a, k, b in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digests, every, added = [], [], []
            for text in batch.column(1):
                spans = find(text.as_py())
                base = [s for s in spans if s[1] < len(BASE)]
                for k, out in enumerate(counts):
                    out.append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(spans))
                added.append(len(spans) - len(base))
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(longs, counts), pa.array(digests, pa.string()), pa.array(every, pa.string()), longs(added)], names)

    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, schema)


def redacted(text: str | None) -> str | None:
    """The text with every span (overlapping ones as one) replaced by its kind in angle brackets."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in its text column replaced; all rows and columns stay."""
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(t.as_py()) for t in batch.column(place)], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(rows, docs.schema)
