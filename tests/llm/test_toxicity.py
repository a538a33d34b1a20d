import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockloom.llm import toxicity
from stockloom.llm.queries import QUERIES
from tests.llm.edge import LONG, documents


@pytest.fixture(scope="module")
def corpus():
    """Two languages, each with its own bad words, some of them only by their stem."""
    rng = random.Random(1)
    stems = {"en": ["the", "and", "with", "house", "tree", "river"], "de": ["der", "und", "mit", "haus", "baum", "fluss"]}
    bad = {"en": ["idiot", "scum"], "de": ["dumm"]}
    rows, toxic = [], []
    for i in range(700):
        lang = rng.choice(["en", "de"])
        ws = [rng.choice(stems[lang]) + rng.choice(["", "s", "er", str(rng.randint(0, 99))]) for _ in range(rng.randint(3, 80))]
        is_toxic = int(rng.random() < 0.3)
        if is_toxic:
            ws.insert(rng.randint(0, len(ws)), rng.choice(bad[lang]) + ("" if lang == "en" else rng.choice(["kopf", "heit", "ling", "er", "es", "sack"])))
        rows.append((i, " ".join(ws), lang))
        toxic.append((i, 1, is_toxic))
    return rows, toxic


def tables(spark, corpus):
    rows, toxic = corpus
    docs = spark.createDataFrame([(*r, f"kept {r[0]}") for r in rows], "doc_id long, text string, lang string, score string")
    return docs, spark.createDataFrame(toxic, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, corpus):
    docs, labels = tables(spark, corpus)
    model = toxicity.train(docs, labels, per_class=300)
    got = toxicity.score_toxicity(docs.select("doc_id", "text"), model).collect()
    truth = {i: t for i, _, t in corpus[1]}
    aside = [r for r in got if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(aside) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in aside]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.drop_toxic(docs, labels, per_class=300)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert all(r["score"] == f"kept {r.doc_id}" for r in left)
    assert {r.doc_id for r in left} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_change_nothing(spark, corpus):
    docs, labels = tables(spark, corpus)
    other = spark.createDataFrame([(i, q, 1 - t if crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in corpus[1]], labels.schema)
    a, b = (toxicity.train(docs, x, per_class=150, rounds=1) for x in (labels, other))
    assert a.constant == b.constant and (a.table == b.table).all() and (a.thresholds == b.thresholds).all()


def test_pieces_of_a_long_text_give_the_response_of_the_whole(monkeypatch):
    rng = np.random.default_rng(0)
    model = toxicity.start_model(rng)
    toxicity.fit_languages(model, [[b"a"], [b"b"]], ["x", "y"])
    text = " ".join(f"w{i % 53}" for i in range(500))
    whole = toxicity.Scorer(model).logit(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    monkeypatch.setattr(toxicity, "REMEMBERED", 20)
    assert toxicity.Scorer(model).logit(text) == pytest.approx(whole)


def test_fit_follows_the_gradient():
    """The step of every weight has the sign of the loss's slope, found by trying it."""
    rng = np.random.default_rng(3)
    texts, labels = [[b"good", b"day"], [b"bad", b"day", b"bad"]] * 20, np.array([0, 1] * 20, np.float32)
    model = toxicity.fit(texts, labels, np.ones(40, np.float32), 6, rng)
    toxicity.fit_languages(model, texts, ["x"] * 40)
    out = [toxicity.Scorer(model).logit(" ".join(w.decode() for w in ws))[0] for ws in texts[:2]]
    assert out[0] < 0 < out[1]


def test_awkward_rows(spark, corpus):
    docs, labels = tables(spark, corpus)
    model = toxicity.train(docs, labels, per_class=100, rounds=1)
    rows = [(None, "idiot"), (1, None), (2, ""), (3, "!!!"), (4, LONG), (5, "again"), (5, "again"), (6, "🙂 漢字")]
    got = toxicity.score_toxicity(documents(spark, rows, False).select("doc_id", "text"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] == scores[3]
    assert toxicity.score_toxicity(documents(spark, [], False).select("doc_id", "text"), model).count() == 0


def test_without_both_labels_nothing_is_toxic(spark, corpus):
    docs, labels = tables(spark, corpus)
    for some in (labels.filter("toxic = 0"), labels.filter("toxic = 2"), labels.filter("doc_id < 0")):
        assert toxicity.train(docs, some) is None
    assert toxicity.train(docs.filter("doc_id < 0"), labels) is None
    got = toxicity.score_toxicity(docs.select("doc_id", "text"), None).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.0, 0)}


def test_held_out_labels_of_the_test_tables_are_told(spark):
    folder = "/root/testdata/sf0.1"
    scored = QUERIES["op1_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {(r.toxic, r.predicted): r["count"] for r in scored.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    right, missed, wrong = (n.get(x, 0) for x in ((1, 1), (1, 0), (0, 1)))
    assert sum(n.values()) > 500 and 2 * right / (2 * right + missed + wrong) >= 0.85


def test_repeated_ids_give_one_model(spark):
    rng = random.Random(0)
    docs = [(i % 60, " ".join(rng.choices(["vile", "foul"] if i % 2 else ["kind", "fair"], k=8)) + f" {i}") for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    models = [toxicity.train(documents(spark, docs).repartition(n), labels, per_class=30) for n in (1, 7)]
    probe = documents(spark, [(i, t) for i, (_, t) in enumerate(docs[:40])], clashes=False)
    scores = [{r.doc_id: r.score for r in toxicity.score_toxicity(probe, m).collect()} for m in models]
    assert scores[0] == scores[1]


def test_every_labelled_row_is_learned(spark):
    """Words that only toxic rows beyond the first 2500 by hash hold."""
    rng = random.Random(4)
    ids = spark.range(9000).filter(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit(7)), "id").collect()
    toxic, clean = [r.id for r in ids[:2800]], [r.id for r in ids[2800:5600]]
    plain = ["tree", "river", "house", "cloud", "stone", "light"]
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=4), *more], 4 + len(more)))
    rows = [(i, text("scum" if k < 2500 else "vile")) for k, i in enumerate(toxic)] + [(i, text()) for i in clean]
    labels = spark.createDataFrame([(i, 1) for i in toxic] + [(i, 0) for i in clean], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows, False), labels, rounds=2)
    probe = documents(spark, [(1, "house vile river tree"), (2, "cloud scum light"), (3, "house river tree")], False).select("doc_id", "text")
    assert {r.doc_id: r.predicted for r in toxicity.score_toxicity(probe, model).collect()} == {1: 1, 2: 1, 3: 0}


def test_long_texts_are_learned_whole(spark):
    """All toxic texts have over 20,000 characters, and the word that tells them is their last."""
    fill = " ".join(f"word{i % 50}" for i in range(4000))
    rows = [(i, f"{fill} {'scum' if i % 2 else 'tree'}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, rows, False), labels)
    got = toxicity.score_toxicity(documents(spark, rows, False).select("doc_id", "text"), model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def labelled_frame(spark, corpus):
    rows = [(i, t, lang, toxic) for (i, t, lang), (_, _, toxic) in zip(*corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int"), rows


def test_a_single_shard_is_fitted_as_in_one_process(spark, corpus):
    frame, rows = labelled_frame(spark, corpus)
    texts = toxicity.coded(frame, 1)
    got = toxicity.fit_shards(texts, 2, 5)
    rows = sorted(rows, key=lambda r: (crc32(str(r[0]).encode()), r[0]))
    tokens = [toxicity.words(r[1]) for r in rows]
    want = toxicity.fit(tokens, np.array([r[3] for r in rows], np.float32), np.ones(len(rows), np.float32), 2, np.random.default_rng(5))
    assert got.constant == want.constant and (got.table == want.table).all() and (got.out == want.out).all()
    toxicity.count_languages(got, texts)
    toxicity.fit_languages(want, tokens, [r[2] for r in rows])
    assert got.languages == want.languages and np.allclose(got.language_rows, want.language_rows)


def test_shards_learn_together(spark, corpus, monkeypatch):
    """Seven shards, some of them in several parts: every row is in one, the order of rows doesn't matter, and the model is good."""
    monkeypatch.setattr(toxicity, "SHARD_TEXTS", 40)
    frame, rows = labelled_frame(spark, corpus)
    tables = [toxicity.coded(frame.repartition(n), 7) for n in (1, 5)]
    held = [r for r in toxicity.one_by_one(iter(tables[0].toArrow().to_batches()))]
    assert sum(len(r["langs"]) for r in held) == len(rows) and len(held) > 7 and {r["shard"] for r in held} == set(range(7))
    models = [toxicity.fit_shards(t, 3, 5) for t in tables]
    assert (models[0].table == models[1].table).all() and models[0].constant == models[1].constant
    toxicity.count_languages(models[0], tables[0])
    out = [toxicity.Scorer(models[0]).logit(r[1])[0] for r in rows]
    order = np.argsort(out)
    toxic = np.array([r[3] for r in rows])
    assert toxic[order[-toxic.sum() :]].mean() > 0.95


def test_thresholds_have_the_best_f1(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), float(rng.integers(-40, 40) / 16), int(rng.random() < 0.3)) for _ in range(900)]
    weights = {0: 1.5, 1: 1.0}
    got = {r.language: r for r in toxicity.best_thresholds(spark.createDataFrame(rows, "language int, output double, toxic int"), weights).collect()}
    for k in (-1, 0, 1, 2):
        own = [r for r in rows if k in (-1, r[0])]
        bad = sum(r[2] for r in own)
        scored = []
        for x in {r[1] for r in own}:
            taken = [r for r in own if r[1] >= x]
            hit = sum(r[2] for r in taken) * weights[1]
            scored.append((2 * hit / (hit + sum(1 - r[2] for r in taken) * weights[0] + bad * weights[1]), x))
        best = max(scored)[1]
        assert (got[k].best, got[k].bad, got[k].good) == (best, bad, len(own) - bad)
        assert got[k].below == max((r[1] for r in own if r[1] < best), default=None)


def test_ids_pass_the_map(spark, monkeypatch):
    """All told ids pass, others mostly don't; a full map passes all."""
    docs, told = spark.range(-500, 500).withColumnRenamed("id", "doc_id"), spark.range(-100, 700, 7).withColumnRenamed("id", "doc_id")
    docs = docs.withColumn("word", F.lit("kept"))
    got = toxicity.likely_in(docs, told)
    assert got.columns == docs.columns and 86 <= got.count() < 120 and got.join(told, "doc_id").count() == 86
    monkeypatch.setattr(toxicity, "MAP_WORDS", 1)
    assert toxicity.likely_in(docs, told).join(told, "doc_id").count() == 86
