"""The pipeline's stages against plain versions, and its queries against what they should find."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockloom.llm.queries import QUERIES, TWINS
from tests.llm.edge import CLASHES, LONG, documents
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_line_dedup import expected as plain_lines
from tests.llm.test_packing import TOKENIZER, check_places
from tests.llm.test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and gives, written and read as the pipeline does."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_are_named_and_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]


def test_all_but_the_last_return_documents(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert all(r.n_chars == len(r.text) for r in after.collect())


def test_toxic_documents_go_and_others_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = (set(texts(x)) for x in stages["toxicity"])
    wrong = [i for i, t in before if i in labels and ((i, t) in after) == (labels[i] == 1)]
    assert after <= before and len(wrong) <= 0.1 * len(labels)  # 60 labels to learn from


def test_repeated_lines_go(stages):
    before, after = stages["line_dedup"]
    assert sorted(texts(after), key=str) == plain_lines(texts(before), 50)


def test_one_of_each_group_stays(stages):
    before, after = (dict(texts(x)) for x in stages["simhash"])
    prints = {i: plain_fingerprint(t) for i, t in before.items()}
    roots = plain_components(set(prints.values()), 2)
    first = {}
    for i in sorted(before):
        first.setdefault(roots[prints[i]], i)
    assert after == {i: before[i] for i in first.values()}


def test_benchmark_passages_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = (dict(texts(x)) for x in stages["decontamination"])
    for i, text in before.items():
        n, hit, _ = plain_leaks(text, items, 10)
        assert (i in after) == (hit <= 0.8 * n)
        if i in after:
            assert after[i] == text if not hit else len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", after[i])) <= n - hit + hit // 10


def test_packing_holds_every_token(stages):
    before, after = stages["packing"]
    rows = after.collect()
    check_places([r.length for r in rows], [(r.length, r.sequence_id, r.offset) for r in rows], 1024)
    made = {}
    for r in sorted(rows, key=lambda r: r.start):
        made[r.doc_id] = made.get(r.doc_id, b"") + bytes(r.ids)
    want = {i: b"".join(x.to_bytes(4, "little") for x in [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts(before)}
    assert made == want


AWKWARD = [
    (None, "no id"), (None, None), (1, None), (2, ""), (3, "  "), (4, LONG), (5, LONG), (6, "again again again"), (6, "again again again"),
    (7, "same id, one text"), (7, "same id, another text"), (8, "!!! 🙂 漢字"),
]


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_awkward_rows_and_empty_tables(spark, name, stage):
    docs = documents(spark, AWKWARD).withColumn("source", F.lit(None).cast("string"))
    got = stage(spark, docs, FOLDER)
    rows = got.collect()
    none = stage(spark, docs.filter(F.lit(False)), FOLDER)
    assert none.columns == got.columns and none.count() == 0
    if name == "packing":
        check_places([r.length for r in rows], [(r.length, r.sequence_id, r.offset) for r in rows], 1024)
        assert len({(r.doc_id, r.sequence_id, r.offset) for r in rows if r.piece == 0}) == len(AWKWARD)
        return
    assert got.columns == docs.columns and all(r[c] == f"kept {c}" for r in rows for c in CLASHES)
    left = sorted(((r.doc_id, r.text) for r in rows), key=str)
    if name in ("toxicity", "decontamination"):  # nothing is labelled, nothing is leaked
        assert left == sorted(AWKWARD, key=str)
    elif name == "line_dedup":
        assert left == sorted([(i, "" if i == 5 else t) for i, t in AWKWARD], key=str)
    else:
        kept = [(None, "no id"), (1, None), (4, LONG), (6, "again again again"), (7, "same id, another text"), (7, "same id, one text"), (8, "!!! 🙂 漢字")]
        assert left == sorted(kept, key=str)


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_toxicity", "doc_id held_out score predicted"), ("op3_packing", "doc_id piece start length ids_crc32 sequence_id offset"),
    ("op6_html_extract", "page_id url text n_chars"), ("op7_url_filter", "page_id host path rule verdict"),
    ("op9_simhash", "doc_id fingerprint component_id"), ("op10_secrets", "doc_id n_assign n_access n_hex base_sha256 spans"),
])
def test_queries_without_sql_cover_their_tables(spark, name, columns):
    got = QUERIES[name](spark, FOLDER)
    assert set(columns.split()) <= set(got.columns)
    source = "pages" if "page_id" in columns else "documents"
    ids = [r[0] for r in spark.read.parquet(f"{FOLDER}/{source}.parquet").select(columns.split()[0]).collect()]
    assert {r[0] for r in got.select(columns.split()[0]).collect()} == set(ids)


def test_secret_digests(spark):
    from tests.llm.test_secrets import plain

    order = {"assign": 0, "access": 1, "hex": 2}
    docs = dict(texts(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    for r in QUERIES["op10_secrets"](spark, FOLDER).collect():
        base = sorted((s, order[k], e, k) for k, s, e in plain(docs[r.doc_id]) if k in order)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[3] == k for x in base) for k in order)
