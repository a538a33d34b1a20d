import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from stockloom.llm import ngram_table, resampling
from stockloom.llm.queries import QUERIES
from tests.llm.edge import CLASHES, LONG, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return ws, [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain(docs, target, percent, min_words, buckets, seed=42):
    """The draw by the definition: doc_id, n_features, weight, score, rank."""
    bucket = lambda x: crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for _, text in rows for x in features(text)[1]) for rows in (docs, target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for doc_id, text in docs:
        ws, found = features(text)
        weight = sum(gain(bucket(x)) for x in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(ws), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], -math.inf if x[0] is None else x[0]))
    ranks = {id(x): i + 1 for i, x in enumerate(able[: percent * len(able) // 100])}
    return [(x[0], x[2], x[3], x[4], ranks.get(id(x))) for x in out]


def test_hashes_and_crcs_are_those_of_the_libraries():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(33, 255, 5000, dtype=np.uint8).tolist())
    text, start, length = ngram_table.Text(data), rng.integers(0, 4900, 3000), rng.integers(0, 70, 3000)
    cut = [data[a : a + n] for a, n in zip(start, length)]
    assert text.hashes(start, length).tolist() == [xxhash.xxh64_intdigest(x) for x in cut]
    assert text.crcs(start, length).tolist() == [crc32(x) for x in cut]


@pytest.mark.parametrize("key_bits", [64, 3, 0])
def test_equal_keys_do_not_join_different_bytes(key_bits):
    rng = random.Random(3)
    data = b" ".join(rng.choices([b"a", b"bb", b"ab", b"abcdefgh", b"abcdefgi", b"x" * 40, b"x" * 39 + b"y", "größe".encode()], k=400))
    ends = [i for i, c in enumerate(data) if c == 32] + [len(data)]
    start = np.array([0, *(e + 1 for e in ends[:-1])])
    length = np.array(ends) - start
    text = ngram_table.Text(data)
    keys = text.hashes(start, length) & np.uint64((1 << key_bits) - 1)
    table = ngram_table.Table(text, start, length, keys)
    own = [data[a : a + n] for a, n in zip(start, length)]
    assert [data[table.start[r] : table.start[r] + table.length[r]] for r in table.rows] == own
    assert Counter(own) == {data[a : a + n]: c for a, n, c in zip(table.start, table.length, table.counts)}


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_texts_in_parts_keep_every_run(most):
    rng = random.Random(most)
    texts = [[rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.choice([0, 1, 2, 3, 30]))] for _ in range(20)]
    got, want = Counter(), Counter()
    for table, of in ngram_table.interned(texts, 3, most):
        data = table.text.data
        got.update((t, data[table.start[r] : table.start[r] + table.length[r]]) for t, r in zip(of.tolist(), table.rows.tolist()))
    for t, ws in enumerate(texts):
        want.update((t, b" ".join(ws[i : i + n])) for n in (1, 2, 3) for i in range(len(ws) - n + 1))
    assert got == want


def run(spark, docs, target, **more):
    some = {k: more.pop(k) for k in ("percent", "min_words") if k in more}
    found, names = resampling.scored(documents(spark, docs), documents(spark, target), **more)
    out, _ = resampling.ranked(found, names, **some)
    rows = out.collect()
    assert all(r[c] == f"kept {c}" for r in rows for c in CLASHES if c not in names.values() and c in out.columns)
    return sorted(((r["doc_id"], r[names["n_features"]], r[names["weight"]], r[names["score"]], r[out.columns[-1]]) for r in rows), key=str)


def texts_like(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_against_definition(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "Größe", "DELTA-x", "7up", "漢字", "x" * 45, "É"]
    docs = [(i, texts_like(rng, words, rng.randint(0, 60))) for i in range(200)]
    docs += [(None, LONG), (300, None), (301, ""), (302, " ,;!"), (303, "one"), (303, "one"), (304, "w" * 100_000), (None, texts_like(rng, words, 30))]
    target = [(0, texts_like(rng, words[:3], 200)), (1, None), (2, "")]
    got = run(spark, docs, target, percent=25, min_words=20, buckets=101)
    assert got == sorted(plain(docs, target, 25, 20, 101), key=str)


def test_rows_that_repeat_are_ranked_one_by_one(spark):
    docs = [(7, LONG[:2000])] * 300 + [(i, "some words here") for i in range(20)]
    got = run(spark, docs, [(0, LONG[:500])], percent=50, min_words=3)
    assert sorted(r[4] for r in got if r[4] is not None) == list(range(1, 161))
    assert sorted((r[0], *r[1:4]) for r in got) == sorted((r[0], *r[1:4]) for r in plain(docs, [(0, LONG[:500])], 50, 3, 10_000))
    kept = resampling.resample(documents(spark, docs), documents(spark, [(0, LONG[:500])]), percent=50, min_words=3)
    assert kept.count() == 160


def test_drawn_rows_are_whole_and_like_the_target(spark):
    rng = random.Random(6)
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    docs = [(i, texts_like(rng, near if i % 10 == 0 else far, 40)) for i in range(400)]
    source = documents(spark, docs)
    kept = resampling.resample(source, documents(spark, [(0, texts_like(rng, near, 500))]), percent=10)
    rows = kept.collect()
    assert kept.columns == source.columns and all(r[c] == f"kept {c}" for r in rows for c in CLASHES)
    assert sorted(r.doc_id for r in rows) == [i for i, _ in docs if i % 10 == 0]
    assert {r.doc_id: r.text for r in rows}.items() <= dict(docs).items()


def test_empty_tables(spark):
    some, none = [(1, "a b c"), (2, "b c d")], []
    assert run(spark, none, some) == []
    assert run(spark, some, none, min_words=1, percent=100) == sorted(plain(some, none, 100, 1, 10_000), key=str)
    assert resampling.resample(documents(spark, none), documents(spark, none)).count() == 0


def test_query_against_definition(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda name, key: [(r[key], r["text"]) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]
    got = QUERIES["op13_importance_resampling"](spark, folder)
    assert set(got.columns) == {"doc_id", "n_features", "weight", "score", "rank"}
    rows = sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect())
    assert rows == sorted(plain(read("documents", "doc_id"), read("benchmark", "item_id"), 5, 20, 10_000))
