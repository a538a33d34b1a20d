"""Personal data by anchors that an Aho-Corasick automaton finds and local parsers expand.

One automaton per task holds all anchors: the at-sign, a digit before a dot, a plus before a digit, two
neighbouring digits, the ``://`` of a scheme, and cues that name an identifier (in lower case, capitals
and with a capital). Each hit is handed to the parser of its kind, which walks left and right from it as far
as the kind's grammar reaches, and checks what it found. Anchors come in order, and one inside a
stretch that its parser has read already is passed over, so a text is read once however dense they are.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``; they equal the leftmost matches that do not
overlap of the patterns in the module's tests. Added kinds are ``handle`` (an at-sign and a name), ``login``
(a url with user data, up to its host), ``tel`` (a number after ``tel:``) and ``account`` (an identifier after a cue:
an IBAN of the right check sum, a social security number of three, two and four digits, else six or more
letters and digits, four digits among them). An added span within a base span is not reported.

Defined cases: a null or empty text has no spans; texts of any length are read whole; only ASCII
letters and digits count, other characters end every span; repeated rows are read one by one; null
doc_ids are kept; columns of any name pass unchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stockloom.llm.common import fresh, query, table

Span = tuple[str, int, int]

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "handle", "login", "tel", "account"]
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIAL = re.compile(r"[\x20().0-9-]*")
HANDLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@])")
AUTHORITY = re.compile(r"""[^\s/?#"'<>@]+@[A-Za-z0-9.-]+""")
TEL = re.compile(r"[0-9](?:[\x20().-]?[0-9]){6,14}(?![0-9])")
IDENTIFIER = re.compile(r"(?:\x20?(?:[Nn]umber|[Nn]o\.?|[Nn]r\.?|[Nn]um\.?|N°))?\x20?[:=#]?\x20?([A-Z0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9]{3}-?[0-9]{2}-?[0-9]{4}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
#: Words that announce an identifier, as English, German, French and Spanish texts have them.
CUES = ["account", "acct", "iban", "passport", "ssn", "konto", "kontonummer", "reisepass", "compte", "passeport", "cuenta", "pasaporte"]


@cache
def anchors() -> ahocorasick.Automaton:
    """All anchors, each with the kind of its parser and its length."""
    found = ahocorasick.Automaton()
    known = [("at", "@"), ("scheme", "://")]
    known += [("dot", f"{d}.") for d in DIGITS] + [("plus", f"+{d}") for d in DIGITS]
    known += [("digits", f"{a}{gap}{b}") for a in DIGITS for b in DIGITS for gap in ("", " ", "-")]
    known += [("tel", x) for x in ("tel:", "Tel:", "TEL:")]
    known += [("cue", x) for cue in CUES for x in (cue, cue.title(), cue.upper())]
    for kind, text in known:
        found.add_word(text, (kind, len(text)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and value <= "255")


def iban(text: str) -> bool:
    return IBAN.fullmatch(text) is not None and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def addresses(text: str, lo: int) -> tuple[int, list[Span]]:
    """From the first digit of a chain of numbers and dots: its end, and each four numbers of it that are an address."""
    end, out, parts = DOTTED.match(text, lo).end(), [], []
    for part in re.finditer("[0-9]+", text[lo:end]):
        parts.append(part)
        if len(parts) == 4:
            if all(octet(p[0]) for p in parts):
                out.append(("ip", lo + parts[0].start(), lo + part.end()))
            parts = []
    return end, out


def card(text: str, lo: int) -> tuple[int, list[Span]]:
    """From the first digit of a chain: its end, and the chain if it is a card number."""
    end = DIGIT_CHAIN.match(text, lo).end()
    digits = re.sub("[^0-9]", "", text[lo:end]) if end - lo <= 37 else ""
    return end, [("card", lo, end)] if 13 <= len(digits) <= 19 and luhn(digits) else []


def phone(text: str, lo: int) -> list[Span]:
    """From a plus with a digit after it."""
    run = text[lo + 2 : DIAL.match(text, lo + 2).end()].rstrip(" ().-")
    n = 1 + sum(map(run.count, DIGITS))
    return [("phone", lo, lo + 2 + len(run))] if len(run) > 1 and 9 <= n <= 15 else []


def email(text: str, at: int, lo: int) -> list[Span]:
    """Around an at-sign, not before ``lo``."""
    start = at
    while start > lo and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return [("email", start, domain.end())] if domain else []


def handle(text: str, at: int) -> list[Span]:
    name = HANDLE.match(text, at + 1)
    return [("handle", at, name.end())] if name and (at == 0 or text[at - 1] not in LOCAL) else []


def login(text: str, colon: int) -> list[Span]:
    """Around the ``://`` of a url."""
    start = colon
    while start > max(0, colon - 12) and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    found = AUTHORITY.match(text, colon + 3, colon + 3 + 512) if start < colon else None
    return [("login", start, found.end())] if found else []


def account(text: str, lo: int, end: int) -> list[Span]:
    """After the cue that lies from ``lo`` to ``end``."""
    if lo and text[lo - 1].isalnum():
        return []
    found = IDENTIFIER.match(text, end)
    if not found:
        return []
    value, cue = re.sub("[ -]", "", found[1]), text[lo:end].lower()
    if cue == "iban":
        fits = iban(value)
    elif cue == "ssn":
        fits = SSN.fullmatch(found[1]) is not None
    else:
        fits = sum(c in DIGITS for c in value) >= 4
    return [("account", found.start(1), found.end(1))] if fits else []


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text: kinds in order, and within a kind from left to right."""
    out: list[Span] = []
    done = dict.fromkeys(("email", "ip", "card"), 0)
    for last, (kind, length) in anchors().iter(text or ""):
        lo = last + 1 - length
        if kind == "digits":
            if lo >= done["card"]:
                done["card"], found = card(text, lo)
                out += found
        elif kind == "dot":
            if lo >= done["ip"]:
                while lo > done["ip"] and text[lo - 1] in DIGITS:
                    lo -= 1
                done["ip"], found = addresses(text, lo)
                out += found
        elif kind == "plus":
            out += phone(text, lo)
        elif kind == "at":
            found = email(text, lo, done["email"])
            if found:
                done["email"] = found[0][2]
            out += found or handle(text, lo)
        elif kind == "scheme":
            out += login(text, lo)
        elif kind == "tel":
            number = TEL.match(text, last + 1)
            out += [("tel", number.start(), number.end())] if number else []
        else:
            out += account(text, lo, last + 1)
    return settled(out)


def settled(found: list[Span]) -> list[Span]:
    """The spans in order, each once, without added ones that lie within a base span."""
    place = {kind: i for i, kind in enumerate(KINDS)}
    base = sorted((s, e) for k, s, e in found if k in BASE)
    starts = [s for s, _ in base]
    reach = list(accumulate((e for _, e in base), max))
    kept = set()
    for kind, lo, hi in found:
        i = bisect_right(starts, lo)
        if kind in BASE or i == 0 or reach[i - 1] < hi:
            kept.add((kind, lo, hi))
    return sorted(kept, key=lambda x: (place[x[0]], x[1], x[2]))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each stretch of spans that overlap replaced by the kind of its first one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda x: (x[1], -x[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def as_arrow(rows: list[list[Span]]) -> pa.Array:
    flat = [span for spans in rows for span in spans]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    kinds, starts, stops = ([span[i] for span in flat] for i in range(3))
    parts = [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["kind", "start", "end"]))


def find_pii(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of spans (kind, start, end; code points, end exclusive), and that column's name."""
    name = fresh(docs, ["spans"])["spans"]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, SPANS)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = as_arrow([spans_of(text.as_py()) for text in part.column("text")])
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=schema.names)

    return docs.mapInArrow(rows, schema), name


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                clean = pa.array([masked(x, spans_of(x)) for x in part.column(at).to_pylist()], pa.string())
                yield part.set_column(at, batch.schema.field(at), clean)

    return docs.mapInArrow(rows, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op12_pii")
def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    found, name = find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col(name)
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["kind"].isin(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
