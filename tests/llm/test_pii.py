import hashlib
import random
import re

import pytest

from stockloom.llm import pii
from stockloom.llm.queries import QUERIES
from tests.llm.edge import CLASHES, LONG, documents


def digits(x):
    return re.sub("[^0-9]", "", x)


def valid_card(x):
    d = [int(c) for c in digits(x)]
    total = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(reversed(d)))
    return 13 <= len(d) <= 19 and total % 10 == 0


#: The base kinds by pattern, and what a match must pass.
BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", valid_card),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
}


def plain(text):
    return [(k, *m.span()) for k, (pattern, ok) in BASE.items() for m in re.finditer(pattern, text or "") if ok(m[0])]


BITS = [
    "a", "Z", "0", "1", "4", "25", "255", "256", "007", "999", ".", ".", "-", " ", " ", "@", "@", "+", "(", ")", "%", "_", "é", "漢", "🙂", "\n", ":", "/",
    "a.b@c.de", "x@y.z", "1.2.3.4", "10.0.0.255", "4111 1111 1111 1111", "378282246310005", "+1 (017) 555-7713", "+49", "://", "tel:", "iban", "٣",
]


@pytest.mark.parametrize("seed", range(12))
def test_base_kinds_equal_their_patterns(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choices(BITS, k=rng.randint(0, 40)))
        got = [s for s in pii.spans_of(text) if s[0] in pii.BASE]
        assert got == plain(text), text


@pytest.mark.parametrize("seed", range(4))
def test_base_kinds_on_short_alphabets(seed):
    rng = random.Random(seed)
    for alphabet in ("0.", "01 -", "a@.", "+1 ()-.", "0.-+@a "):
        for _ in range(400):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
            assert [s for s in pii.spans_of(text) if s[0] in pii.BASE] == plain(text), text


@pytest.mark.parametrize(("text", "want"), [
    ("by @jane_doe today", [("handle", "@jane_doe")]),
    ("mail jane@x.org now", [("email", "jane@x.org")]),
    ("see https://bob:pw1@host.example/x", [("email", "pw1@host.example"), ("login", "https://bob:pw1@host.example")]),
    ("see https://host.example/@", []),
    ("call tel:555-123-4567.", [("tel", "555-123-4567")]),
    ("call tel:+1 555 123 4567", [("phone", "+1 555 123 4567")]),
    ("IBAN: DE89 3704 0044 0532 0130 00, ok", [("account", "DE89 3704 0044 0532 0130 00")]),
    ("IBAN: DE88 3704 0044 0532 0130 00, ok", []),
    ("SSN 078-05-1120", [("account", "078-05-1120")]),
    ("SSN 07-805-1120", []),
    ("Kontonummer 12345678", [("account", "12345678")]),
    ("account number: AB12-3456", [("account", "AB12-3456")]),
    ("an account of the events", []),
    ("account 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
])
def test_expansion_from_cues(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.spans_of(text)] == want


@pytest.mark.parametrize("run", [
    lambda n: "a" * n + "@b", lambda n: "@" * n, lambda n: "1." * n, lambda n: "1" * n, lambda n: "1 " * n, lambda n: "+1" * n, lambda n: "+" + "1" * n,
    lambda n: "a@b." * n, lambda n: "0" * n + ".1.2.3", lambda n: "tel:" * n, lambda n: "iban " * n, lambda n: "://" * n, lambda n: "a@" * n,
    lambda n: "-" * n + "@a.b", lambda n: "x@y.z" * n,
])
def test_long_runs_are_read_once(run):
    for n in (7, 16, 300):
        assert [s for s in pii.spans_of(run(n)) if s[0] in pii.BASE] == plain(run(n))
    pii.spans_of(run(300_000))  # the patterns would take hours here


def test_all_rows_and_columns_come_back(spark):
    rows = [
        (None, "x@y.org"), (1, None), (2, ""), (3, LONG + " jane@x.org"), (4, "x@y.org, +1 (017) 555-7713"), (4, "x@y.org, +1 (017) 555-7713"), (5, "漢字 🙂 10.1.2.3"),
    ]
    docs = documents(spark, rows)
    found, name = pii.find_pii(docs)
    got = found.collect()
    assert found.columns == [*docs.columns, name] and name not in docs.columns
    assert all(r[c] == f"kept {c}" for r in got for c in CLASHES)
    assert sorted(((r.doc_id, r.text, [tuple(s) for s in r[name]]) for r in got), key=str) == sorted(((i, t, pii.spans_of(t)) for i, t in rows), key=str)
    clean = pii.mask_pii(docs)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([
        (None, "[EMAIL]"), (1, None), (2, ""), (3, LONG + " [EMAIL]"), (4, "[EMAIL], [PHONE]"), (4, "[EMAIL], [PHONE]"), (5, "漢字 🙂 [IP]"),
    ], key=str)


def test_masks_join_spans_that_overlap():
    text = "see https://bob:pw1@host.example/x"
    assert pii.masked(text, pii.spans_of(text)) == "see [LOGIN]/x"


def test_empty_table(spark):
    docs = documents(spark, [])
    assert pii.find_pii(docs)[0].count() == 0 and pii.mask_pii(docs).count() == 0


def test_query_against_patterns(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_pii"](spark, folder).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        base = plain(docs[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert r.spans == ",".join("%s:%d:%d" % s for s in pii.spans_of(docs[i]))
