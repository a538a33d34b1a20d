import random
import re

import pytest
from pyspark.sql import functions as F

from stockloom.llm import decontaminate
from stockloom.llm.decontaminate import hit_words, leaks
from tests.llm.edge import CLASHES, LONG, documents


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window):
    ws, hit, found = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1):
            if n and tuple(ws[i : i + n]) in grams:
                hit.update(range(i, i + n))
                if name is not None:
                    found.add(str(name))
    return len(ws), len(hit), sorted(found)


def judged(docs, bench, **more):
    out, names = leaks(docs, bench, **more)
    rows = out.withColumn("hits", hit_words(names["spans"])).collect()
    return sorted(((r.doc_id, r.text, r[names["n_words"]], r.hits, sorted(r[names["items"]])) for r in rows), key=str)


@pytest.mark.parametrize("max_words", [200_000, 25])
def test_random_texts_against_definition(spark, max_words):
    rng = random.Random(5)
    some = lambda lo, hi: rng.choice([" ", ", ", "\n"]).join(rng.choices("abcdEF", k=rng.randint(lo, hi)))
    items = [(i, some(0, 12)) for i in range(12)] + [(None, some(6, 6)), (3, some(5, 9)), (20, None), (21, "a b"), (22, "--")]
    rows = [(i, some(0, 60)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = judged(documents(spark, rows, False), bench, window=5, max_words=max_words)
    live = [x for x in items if x[1] is not None]
    assert got == sorted(((i, t, *plain(t, live, 5)) for i, t in rows), key=str)


def test_awkward_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    rows = [
        (None, f"x {item.upper()} y"), (1, None), (2, ""), (3, LONG), (4, f"{'keep ' * 20}{item.replace(' ', ', ')}; {'rest ' * 20}"),
        (4, "clean"), (4, "clean"), (5, item),
    ]
    docs = documents(spark, rows)
    assert [x[3] for x in judged(docs, bench) if x[0] == 4] == [0, 0, 11]
    kept = decontaminate.decontaminate(docs, bench, max_coverage=0.8)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    cut = f"{'keep ' * 20}; {'rest ' * 20}"
    assert texts == sorted([(1, None), (2, ""), (3, LONG), (4, cut), (4, "clean"), (4, "clean")], key=str)
    assert all(r[c] == f"kept {c}" for r in kept.collect() for c in CLASHES)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b c")])
    assert decontaminate.decontaminate(docs, bench).count() == 1
    assert decontaminate.decontaminate(docs.filter(F.lit(False)), bench).count() == 0
