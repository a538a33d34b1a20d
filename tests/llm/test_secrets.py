import random
import re

from stockloom.llm import secrets
from tests.llm.edge import LONG, documents

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = [
    ("assign", ASSIGN, lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]
WEAK = [("token", secrets.TOKEN), ("client", secrets.CLIENT), ("endpoint", secrets.ENDPOINT)]


def plain(text, scope=200):
    """Spans of a text by the definition, every pair tried."""
    text = text or ""
    base = [(k, *m.span()) for k, pattern, ok in BASE for m in pattern.finditer(text) if ok(m)]
    weak = [(k, *m.span()) for k, p in WEAK for m in re.finditer(p, text, re.A)]
    weak = [(k, s, e) for k, s, e in weak if not any(b[1] <= s < b[2] for b in base)]
    role = {k: v[1] for k, v in secrets.KINDS.items()}
    parts = base + weak
    near = lambda s, r: any(role[k] == r and abs(a - s) <= scope for k, a, _ in parts)
    return sorted(base + [w for w in weak if all(near(w[1], r) for r in secrets.NEEDS[w[0]])])


def found(spark, rows, **more):
    got = {}
    for r in secrets.secret_spans(documents(spark, rows), **more).collect():
        spans = got.setdefault((r.doc_id, r.copy), [])
        if r.kind is not None:
            spans.append((r.kind, r.start, r.end))
            assert r.value is not None
    return {k: sorted(v) for k, v in got.items()}


BITS = [
    'password = "hunter22hunter"', "token=short", "token=apikey = longvalue12", "AKIA" + "Q7" * 8, "AKIAQQ", "0123456789abcdef" * 2, "0123456789abcde" * 2,
    "aB3/" * 10, "client_id: acme.app", "https://vault.example.org/v1", "SECRET:x", "Api_Key='zz/zz+zz=zz-'", "größe", "plain words", "user=bob", "x" * 150, "🙂",
]


def test_random_texts_against_definition(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(BITS, k=rng.randint(0, 25)))) for i in range(120)]
    got = found(spark, rows)
    assert sorted(got.values()) == sorted(plain(t) for _, t in rows)
    assert {i: v for (i, _), v in got.items()} == {i: plain(t) for i, t in rows}


def test_weak_parts_need_their_complement(spark):
    token = "aB3/" * 10
    rows = [(1, token), (2, f"{'AKIA' + 'Q7' * 8} {token}"), (3, f"{'AKIA' + 'Q7' * 8} {'x ' * 150}{token}"), (4, f"https://vault.example.org {token}")]
    got = {i: [k for k, _, _ in v] for (i, _), v in found(spark, rows).items()}
    assert got == {1: [], 2: ["access", "token"], 3: ["access"], 4: []}


def test_awkward_rows(spark):
    rows = [(None, "password=abcdefgh1"), (1, None), (2, ""), (3, LONG + " password=abcdefgh1"), (4, "token: abcdefgh"), (4, "token: abcdefgh"), (4, "token: other123")]
    got = found(spark, rows)
    assert sorted(map(str, got.values())) == sorted(str(plain(t)) for _, t in set(rows))
    copies = {r.copies for r in secrets.secret_spans(documents(spark, rows)).collect() if r.value == "token: abcdefgh"}
    assert copies == {2}


def test_empty_table(spark):
    assert secrets.secret_spans(documents(spark, [])).count() == 0
