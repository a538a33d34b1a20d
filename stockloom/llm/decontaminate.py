"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

Texts are lower-cased (A to Z) and cut into words. The automaton holds every run of words of every
benchmark item. Training words are streamed through it; after each word the state gives the length
of the longest run that ends there and occurs in some item. Runs of ``window`` words or more are
hits, and so is a whole item of fewer words. Hit words are cut from the text, and a document whose
hit share exceeds a limit goes.

The automaton is built on the driver from at most about ``max_words`` words and broadcast; a larger
benchmark is dealt over several automata by a hash of its rows, and the documents pass through one
after the other, the hits so far being stored between. The result doesn't depend on the number.

Defined cases: null and empty texts have no words and no hits; a null or empty item has no
windows; items without item_id hit but are not counted; repeated items count by their item_id;
repeated documents are judged one by one; an empty benchmark hits nothing; all other columns pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stockloom.llm.common import fresh, query, stored, table

#: 0-9 and a-z as they are, A-Z in lower case, other ASCII as a space; bytes of other characters as they are.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(FOLDED).split()


class Automaton:
    """Suffix automaton of several word sequences, with what a window's state says about items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in ws]) for name, ws in items if ws]
        for _, run in coded:
            last = 0
            for c in run:
                last = self._extend(last, c)
        self.least = min([window, *(len(run) for _, run in coded)])
        #: State of a run of exactly ``window`` words, or of a whole shorter item: the items that hold it.
        self.holders: dict[int, set[str]] = {}
        shorts: dict[int, list[tuple[int, int]]] = {}
        for name, run in coded:
            state, n = 0, min(window, len(run))
            for at, c in enumerate(run, 1):
                state = self.next[state][c]
                if at >= n:
                    state = self._shortened(state, n)
                    self.holders.setdefault(state, set()).update(() if name is None else (name,))
            if len(run) < window:
                shorts.setdefault(state, []).append((len(run), state))
        #: For each state the state of its last ``window`` words, and all short items its run may end with.
        self.tail, self.shorts = [-1] * len(self.link), [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.tail[s] = s if self.length[up] < window <= self.length[s] else self.tail[up]
            self.shorts[s] = (*self.shorts[up], *sorted(set(shorts.get(s, []))))

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(onward)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state that takes over the runs of q that p's runs lead to by c."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _shortened(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (end exclusive) and the items whose windows occur."""
        if len(ws) < self.least or not self.ids:
            return [], set()
        codes = np.fromiter(map(self.ids.get, ws, [0] * len(ws)), np.int32, len(ws))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], codes > 0, [False]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for lo, hi in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= self.least]:
            state = matched = 0
            for at, c in enumerate(codes[lo:hi].tolist(), int(lo) + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if c not in self.next[state]:
                    continue
                state, matched = self.next[state][c], matched + 1
                if matched >= self.window:
                    spans.append((at - matched, at))
                    found |= self.holders[self.tail[state]]
                for n, whole in self.shorts[state]:
                    if n <= matched:
                        spans.append((at - n, at))
                        found |= self.holders[whole]
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text)]
    keep, last = [], 0
    for lo, hi in spans:
        keep.append(text[last : at[lo][0]])
        last = at[hi - 1][1]
    return "".join([*keep, text[last:]])


def automata(benchmark: DataFrame, window: int, max_words: int) -> list[Automaton]:
    """One automaton, or as many as keep each near ``max_words`` words. Built one at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    parts = max(1, -(-size // max_words))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        rows = items.filter(shard == k).collect()
        yield Automaton([(r["item_id"], words(r["text"])) for r in rows], window)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 200_000) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns for n_words, spans (flat list of starts and ends, in words), items and
    the text without hit words; and the names those columns got, as ``docs`` may use any."""
    spark = docs.sparkSession
    names = fresh(docs, ["n_words", "spans", "items", "clean"])
    first = docs.withColumns({
        names["n_words"]: F.lit(0).cast("long"), names["spans"]: F.array().cast("array<long>"),
        names["items"]: F.array().cast("array<string>"), names["clean"]: F.lit(None).cast("string"),
    })
    schema = T.StructType([*docs.schema.fields, *first.schema.fields[-4:]])
    out, shards = first, 0
    for automaton in automata(benchmark, window, max_words):
        held = spark.sparkContext.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            machine = held.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    n_words, spans, items, clean = [], [], [], []
                    before = zip(batch.column(names["spans"]).to_pylist(), batch.column(names["items"]).to_pylist())
                    for text, (old, known) in zip(batch.column("text").to_pylist(), before):
                        ws = words(text)
                        hit, found = machine.hits(ws)
                        hit = merged([*hit, *zip(old[::2], old[1::2])])
                        n_words.append(len(ws))
                        spans.append([x for span in hit for x in span])
                        items.append(sorted(found.union(known)))
                        clean.append(without(text, hit) if hit else text)
                    new = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(clean, pa.string())]
                    old_columns = batch.columns[: len(batch.columns) - 4]
                    yield pa.RecordBatch.from_arrays([*old_columns, *new], names=schema.names)

        shards += 1
        out = (stored(out, "leaks") if shards > 1 else out).mapInArrow(scan, schema)
    return out, names


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.8, max_words: int = 200_000) -> DataFrame:
    """``docs`` with the hit words cut from ``text``, without documents of which more than ``max_coverage`` was hit."""
    found, names = leaks(docs, benchmark, window, max_words)
    n_hit = hit_words(names["spans"])
    kept = found.filter(n_hit <= F.lit(max_coverage) * F.col(names["n_words"]))
    return kept.withColumn("text", F.col(names["clean"])).select(*docs.columns)


def hit_words(spans: str):
    """Words within spans given as a flat list of starts and ends."""
    sign = F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(sign, F.lit(0).cast("long"), lambda a, x: a + x)


SQL = r"""
WITH w AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM w WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
grams AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, ws, n, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
occurs AS (SELECT r, i, g.n, item_id FROM grams g JOIN windows USING (n, gram)),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT r, i, n FROM occurs)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM occurs) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op8_decontaminate", SQL)
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found, names = leaks(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", F.col(names["n_words"]).alias("n_words"), hit_words(names["spans"]).alias("n_hit"),
        F.size(names["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names["items"]), ","), 256).alias("items_sha256"),
        (F.size(names["spans"]) > 0).alias("contaminated"),
    )
