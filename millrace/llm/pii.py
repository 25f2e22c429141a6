"""Personal data by anchors: one pass of an Aho-Corasick automaton, then parsers that look around each anchor only.

Anchors are at-signs, URL schemes, the first two digits of a row of digits (next to each other, or parted by a space, a hyphen
or a dot), a plus before a digit, and words that introduce an account. From an anchor a parser expands to the left and
right and validates what it found. Each kind's spans are the leftmost ones that don't overlap.

Base kinds: email, ip, card, phone. Added to them are cards inside a longer row of digits, and two kinds besides:
`account` (an IBAN of right check digits, or a number of 6 to 20 digits that such a word introduces) and `login` (the user
part and host of a URL that has one).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone", "account", "login")
#: The kinds of the base; of the others, and of added cards, `base` is false.
BASE = KINDS[:4]

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_quad = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_chain = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone_rest = re.compile(r"[ ().0-9-]+").match
_group = re.compile(r"[0-9]+")
_last_digit = re.compile(r"[0-9](?=[^0-9]*\Z)").search
_user = re.compile(r"[^\s/?#@\\\"'<>]+@(?=[A-Za-z0-9])").match
_host = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*").match
_label = re.compile(r"(?:\s?(?:number|no|nr|num)\b\.?)?[\s:#=]{0,3}", re.I).match
_number = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![ -]?[0-9])").match
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").match

Span = tuple[str, int, int, bool]


@functools.cache
def automaton():
    """Anchors with what they anchor and their length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, what in [("@", "at"), *((s, "scheme") for s in SCHEMES), *((x, "cue") for c in CUES for x in (c, c.title(), c.upper()))]:
        found.add_word(word, (what, len(word)))
    for d in "0123456789":
        found.add_word("+" + d, ("plus", 2))
        for e in "0123456789":
            found.add_word(f"{d}.{e}", ("dot", 3))
            for part in ("", " ", "-"):
                found.add_word(d + part + e, ("row", 2 + len(part)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def is_card(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_octet(part: str) -> bool:
    return len(rest := part.lstrip("0")) <= 3 and int(rest or "0") <= 255


def inner_cards(text: str, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Cards made of whole groups of a row of digits that is none itself."""
    groups = [m.span() for m in _group.finditer(text, first, last)]
    i = 0
    while i < len(groups):
        digits, j = "", i
        while j < len(groups) and len(digits) + groups[j][1] - groups[j][0] <= 19:
            digits += text[slice(*groups[j])]
            j += 1
            if is_card(digits):
                yield groups[i][0], groups[j - 1][1]
                i = j - 1
                break
        i += 1


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """What the word that ends at `at` introduces."""
    at = _label(text, at).end()
    if m := _iban(text, at):
        # Letters of the next words may have been taken along: the longest that is valid counts.
        last = m.end()
        while last - at >= 15:
            if text[last - 1] != " " and len(iban := text[at:last].replace(" ", "")) >= 15 and mod97(iban):
                return at, last
            last -= 1
    if m := _number(text, at):
        return m.span()
    return None


def spans_of(text: str) -> list[Span]:
    """(kind, start, end, base), in code points, by kind and start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    past = dict.fromkeys(("at", "row", "dot", "cue", "scheme"), 0)  # where the last match of each ends
    for end, (what, length) in automaton().iter(text):
        end += 1
        start = end - length
        if start < past.get(what, 0):
            continue
        if what == "at":
            if m := _domain(text, end):
                first = start
                while first > past["at"] and text[first - 1] in LOCAL:
                    first -= 1
                if first < start:
                    found["email"].append(("email", first, m.end(), True))
                    past["at"] = m.end()
        elif what == "row":
            past["row"] = last = _chain(text, start).end()
            if last - start >= 16:
                if last - start <= 37 and is_card("".join(_group.findall(text, start, last))):
                    found["card"].append(("card", start, last, True))
                else:
                    found["card"] += [("card", *x, False) for x in inner_cards(text, start, last)]
        elif what == "dot":
            first = start
            while first > past["dot"] and text[first - 1] in DIGITS:
                first -= 1
            if m := _quad(text, first):
                past["dot"] = m.end()
                if all(map(is_octet, m[0].split("."))):
                    found["ip"].append(("ip", *m.span(), True))
        elif what == "plus":
            m = _phone_rest(text, end)
            if m and (d := _last_digit(m[0])) and d.start() >= 1:
                last = end + d.end()
                if 8 <= sum(c in DIGITS for c in text[start:last]) <= 15:
                    found["phone"].append(("phone", start, last, True))
        elif what == "cue":
            known = (start == 0 or not text[start - 1].isalnum()) and not text[end : end + 1].isalnum()
            if known and (x := account_at(text, end)):
                found["account"].append(("account", *x, False))
                past["cue"] = x[1]
        elif (m := _user(text, end)) and (host := _host(text, m.end())):
            found["login"].append(("login", end, host.end(), False))
            past["scheme"] = host.end()
    return [s for kind in KINDS for s in found[kind]]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: the id column and spans (kind, start, end, base), start and end in code points, by kind in the
    order of KINDS and by start.

    base: the spans that are the leftmost matches of the base patterns and pass their check. A null or empty text has no
    spans. Repeated and null ids are rows of their own, an empty table gives no rows, and other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean>>"
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, rows = [0], []
            for text in batch.column(1):
                rows += spans_of(text.as_py())
                offsets.append(len(rows))
            fields = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "base"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], [id_col, "spans"])

    return map_batches(docs.select(F.col(id_col), text_or_empty(text_col).alias("text")), run, schema)
