import random
import re

import pytest
from xxhash import xxh64_intdigest

from stockloom.llm import simhash
from tests.llm.edge import CLASHES, LONG, documents


def plain_fingerprint(text, size=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("dense", [1, 64])
def test_components_of_near_prints(spark, most, dense):
    rng = random.Random(most)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])))
            prints.add(signed(base))
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(table, most, dense)).collect()}
    want = plain_components(prints, most)
    assert {p: roots.get(p, p) for p in prints} == want


ROWS = [
    (None, "no id here at all"), (1, None), (2, ""), (3, " \t\n"), (4, "Two words"), (5, "two WORDS"), (6, LONG), (7, LONG),
    (8, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "Größe ÄRGER straße x"), (10, "no id here at all"), (11, "two words one"), (None, "alone"),
]


def test_awkward_rows_against_plain_version(spark):
    got = simhash.near_duplicates(documents(spark, ROWS), 3, 2).collect()
    prints = [plain_fingerprint(t) for _, t in ROWS]
    roots = plain_components(set(prints), 2)
    ids = {}
    for (i, _), p in zip(ROWS, prints):
        ids.setdefault(roots[p], []).append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    want = sorted(((i, p, least[roots[p]]) for (i, _), p in zip(ROWS, prints)), key=str)
    assert sorted(((r.doc_id, r.fp & ((1 << 64) - 1), r.component_id) for r in got), key=str) == want


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, ROWS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows if r.doc_id is not None)) == [1, 4, 6, 8, 9, 10, 11]
    assert [r.text for r in rows if r.doc_id is None] == ["alone"]
    assert all(r[c] == f"kept {c}" for r in rows for c in CLASHES)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0
