"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of hashed rows for the word, its first three, four and five letters
and its last three, so that unseen words of a known stem count. Filters of several widths run over
the embeddings of a text; the greatest response of each filter over the whole text, if positive,
feeds a logistic output. Every text is fitted and scored whole, in pieces whose maxima are combined.

The classifier is fitted to all labelled rows that are not held out. Their texts are dealt over shards
by hash and stored as numbers of words. In each round every shard goes on from the same weights, text
by text, in a task of its own; for each weight the mean over the shards, by the squared
gradients it met in them, starts the next round. So a weight that few shards touch moves as they say, and
a single shard gives what a fit in one process gives. Shards depend on the rows alone, not on the cluster.

Thresholds are calibrated by language on a quarter of the labelled documents, left out of the fit: of all their
outputs the one with the best F1. The language of a text is guessed from its words alone, by word
frequencies of the fitted texts' languages, so the score is a function of the text. A score is the logistic of
the output minus the threshold: 0.5 lies at it. The driver holds the weights (3 MB) and 96 KB for each language.

Defined cases: null and empty texts have no responses and are scored by the output's constant; if
either label is missing all scores are 0; null labels and labelled null texts are left out, and a document with several
labels is toxic if any says so; labels of unknown documents are ignored; rows that repeat are scored
alike; a null doc_id is never held out; other columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stockloom.llm.common import fresh, query, stored, table

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
LANGUAGE_BUCKETS = 1 << 13
#: Words a worker remembers, and words of a text taken at a time.
REMEMBERED, PIECE = 200_000, 20_000
#: Texts and characters of a shard, about; weights that are merged together.
SHARD_TEXTS, SHARD_CHARS, BLOCK = 4096, 1 << 24, 1024
#: Words of 64 bits in a map of ids.
MAP_WORDS = 1 << 18
#: Weight of a change by gradients too small to show in the sum of their squares.
LEAST = 1e-12
#: Bins of outputs to a unit, from which running sums go on.
BINS = 64
#: ASCII but letters, digits and apostrophes as a space.
FOLDED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").translate(FOLDED).split()


WHOLE, START, END = crc32(b"="), crc32(b"<"), crc32(b">")


def word_rows(word: bytes) -> list[int]:
    """Rows of the embedding table that add up to a word."""
    if word.isascii():
        starts, end = (word[:3], word[:4], word[:5]), word[-3:]
    else:
        text = word.decode("utf-8", "ignore")
        starts, end = [text[:n].encode() for n in (3, 4, 5)], text[-3:].encode()
    return [crc32(word, WHOLE) % BUCKETS, *(crc32(p, START) % BUCKETS for p in starts), crc32(end, END) % BUCKETS]


@dataclass
class Model:
    """Weights; filters of width w are w matrices side by side, one for each word they cover."""

    table: np.ndarray
    filters: list[list[np.ndarray]]
    bias: list[np.ndarray]
    out: np.ndarray
    constant: float
    languages: list[str] = field(default_factory=list)
    language_rows: np.ndarray | None = None
    thresholds: np.ndarray | None = None

    def responses(self, m: np.ndarray) -> list[np.ndarray]:
        """Responses of the filters of each width at every position of the embedded words ``m``."""
        out = []
        for width, parts, bias in zip(WIDTHS, self.filters, self.bias):
            n = len(m) - width + 1
            if n <= 0:
                out.append(np.zeros((0, FILTERS), np.float32))
                continue
            total = m[:n] @ parts[0]
            for k in range(1, width):
                total += m[k : k + n] @ parts[k]
            out.append(total + bias)
        return out


def start_model(rng: np.random.Generator) -> Model:
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    return Model(
        normal(BUCKETS, DIMS) * np.float32(0.3), [[normal(DIMS, FILTERS) for _ in range(w)] for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS)) + np.float32(0.3), 0.0,
    )


class Coder:
    """Labelled texts as numbers of words, and for each word its rows of the embedding table."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.rows_of: list[list[int]] = []
        self.buckets: list[int] = []
        self.texts: list[np.ndarray] = []
        self.toxic: list[int] = []
        self.langs: list[str | None] = []
        self.chars = 0

    def add(self, ws: list[bytes], toxic: int, lang: str | None = None, chars: int = 0) -> None:
        for w in dict.fromkeys(ws):
            if w not in self.known:
                self.known[w] = len(self.rows_of)
                self.rows_of.append(word_rows(w))
                self.buckets.append(crc32(w) % LANGUAGE_BUCKETS)
        self.texts.append(np.fromiter(map(self.known.__getitem__, ws), np.int32, len(ws)))
        self.toxic.append(toxic)
        self.langs.append(lang)
        self.chars += chars

    def parts(self) -> np.ndarray:
        return np.array(self.rows_of or [[0] * 5], np.uint16)

    def row(self, shard: int, part: int) -> dict:
        ids = np.concatenate(self.texts)
        ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        return {
            "shard": shard, "part": part, "words": self.parts().tobytes(), "buckets": np.array(self.buckets, np.uint16).tobytes(),
            "ids": ids.tobytes(), "ends": ends.tobytes(), "toxic": np.array(self.toxic, np.int8).tobytes(), "langs": self.langs,
        }


CODED = "shard int, part int, words binary, buckets binary, ids binary, ends binary, toxic binary, langs array<string>"
CODED_ARROW = pa.schema([
    ("shard", pa.int32()), ("part", pa.int32()), *((x, pa.binary()) for x in ("words", "buckets", "ids", "ends", "toxic")),
    ("langs", pa.list_(pa.string())),
])


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def texts_of(row: dict) -> list[np.ndarray]:
    return np.split(np.frombuffer(row["ids"], np.int32), np.frombuffer(row["ends"], np.int64)[:-1])


class Learner:
    """A model's weights by name, with the squared gradients each has met (Adagrad): steps shrink with them."""

    def __init__(self, model: Model, rate: float = 0.1):
        self.model, self.rate = model, rate
        self.constant = np.array([model.constant], np.float32)
        self.values = {"table": model.table, "out": model.out, "constant": self.constant}
        for j, parts in enumerate(model.filters):
            self.values |= {f"f{j}.{k}": part for k, part in enumerate(parts)} | {f"b{j}": model.bias[j]}
        self.seen = {name: np.full(v.shape, 1e-2, np.float32) for name, v in self.values.items()}

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All weights, and what they have met."""
        return tuple(np.concatenate([v.ravel() for v in x.values()]) for x in (self.values, self.seen))

    def put(self, at: int, values: np.ndarray, seen: np.ndarray) -> None:
        """Set the weights from place ``at`` of the flat order on."""
        start = 0
        for name, array in self.values.items():
            lo, hi = max(at, start), min(at + len(values), start + array.size)
            if lo < hi:
                array.reshape(-1)[lo - start : hi - start] = values[lo - at : hi - at]
                self.seen[name].reshape(-1)[lo - start : hi - start] = seen[lo - at : hi - at]
            start += array.size

    def step(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        seen = self.seen[name]
        seen[rows] += gradient * gradient
        self.values[name][rows] -= self.rate * gradient / np.sqrt(seen[rows])

    def peaks(self, parts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest response of each filter to a text and its place, by width; minus infinity if the text is too short."""
        best, place = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32), np.zeros((len(WIDTHS), FILTERS), np.int64)
        for lo in range(0, len(ids), PIECE):  # pieces overlap, so that no position is missed
            own, back = np.unique(ids[lo : lo + PIECE + max(WIDTHS) - 1], return_inverse=True)
            for j, r in enumerate(self.model.responses(self.model.table[parts[own]].sum(1)[back])):
                if len(r):
                    at = r.argmax(0)
                    top = r[at, np.arange(FILTERS)]
                    better = top > best[j]
                    best[j][better], place[j][better] = top[better], at[better] + lo
        return best, place

    def learn(self, parts: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, order: np.ndarray) -> None:
        """Logistic loss by single texts; through a maximum only the words at its place learn."""
        model = self.model
        for i in order:
            ids = texts[i]
            best, place = self.peaks(parts, ids)
            tops = np.maximum(best.ravel(), 0)
            logit = float(tops @ model.out + self.constant[0])
            error = np.float32((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[i]) * weights[i])
            if abs(error) < 1e-3:
                continue
            passed = error * model.out * (tops > 0)
            self.step("out", error * tops + np.float32(1e-4) * model.out)
            self.step("constant", np.array([error], np.float32))
            live = [j for j in range(len(WIDTHS)) if passed[j * FILTERS : (j + 1) * FILTERS].any()]
            if not live:
                continue
            rows = parts[np.concatenate([ids[place[j] + k] for j in live for k in range(WIDTHS[j])])]
            m = model.table[rows].sum(1)
            change, at = [], 0
            for j in live:
                down = passed[j * FILTERS : (j + 1) * FILTERS]
                for k in range(WIDTHS[j]):
                    change.append((model.filters[j][k] * down).T)
                    self.step(f"f{j}.{k}", (m[at : at + FILTERS] * down[:, None]).T)
                    at += FILTERS
                self.step(f"b{j}", down)
            own, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(own), DIMS), np.float32)
            np.add.at(total, where.reshape(rows.shape), np.broadcast_to(np.concatenate(change)[:, None, :], (*rows.shape, DIMS)))
            self.step("table", total, own)
        model.constant = float(self.constant[0])


def fit(texts: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, rounds: int, rng: np.random.Generator) -> Model:
    """A fit in one process: what ``fit_shards`` gives for a single shard."""
    learner, coder = Learner(start_model(rng)), Coder()
    for ws, label in zip(texts, labels):
        coder.add(ws, int(label))
    for _ in range(rounds):
        learner.learn(coder.parts(), coder.texts, labels, weights, rng.permutation(len(texts)))
    return learner.model


def coded(labelled: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of labelled texts, more for one that is twice as large as it should be."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, coder = None, 0, Coder()
        out = lambda: pa.RecordBatch.from_pylist([coder.row(shard, part)], CODED_ARROW)
        for batch in batches:
            for row in one_by_one(iter([batch])):
                full = len(coder.texts) >= 2 * SHARD_TEXTS or coder.chars >= 2 * SHARD_CHARS
                if coder.texts and (full or row["shard"] != shard):
                    yield out()
                    part, coder = part + 1 if row["shard"] == shard else 0, Coder()
                shard = row["shard"]
                coder.add(words(row["text"]), row["toxic"], row["lang"], len(row["text"]))
        if coder.texts:
            yield out()

    dealt = labelled.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    order = ["shard", F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "text", F.coalesce("lang", F.lit(""))]
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions(*order)
    return stored(dealt.select("shard", "text", "lang", "toxic").mapInArrow(rows, CODED), "toxicity-coded")


def fit_shards(texts: DataFrame, rounds: int, seed: int) -> Model:
    """All shards learn from the same weights in each round; then each weight becomes the mean over the shards that moved it."""
    sc = texts.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    learner = Learner(start_model(rng))
    for turn in range(rounds):
        sent = sc.broadcast((learner, rng))
        moved = texts.mapInArrow(learning(sent, turn), "block int, shard int, part int, value binary, seen binary")
        for row in moved.groupBy("block").applyInArrow(merging(sent), "block int, value binary, seen binary").collect():
            learner.put(row["block"] * BLOCK, np.frombuffer(row["value"], np.float32), np.frombuffer(row["seen"], np.float32))
        sent.unpersist()
    learner.model.constant = float(learner.constant[0])
    return learner.model


def learning(sent, turn: int) -> Callable:
    """The weights each shard changes in a round, in blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            learner, rng = copy.deepcopy(sent.value)
            before = learner.flat()
            labels = np.frombuffer(row["toxic"], np.int8).astype(np.float32)
            for _ in range(turn + 1):
                order = rng.permutation(len(labels))
            parts = np.frombuffer(row["words"], np.uint16).reshape(-1, 5)
            learner.learn(parts, texts_of(row), labels, np.ones(len(labels), np.float32), order)
            value, seen = learner.flat()
            blocks = np.unique(np.flatnonzero((value != before[0]) | (seen != before[1])) // BLOCK)
            pieces = lambda x: pa.array([x[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())
            same = lambda x: pa.array([x] * len(blocks), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), same(row["shard"]), same(row["part"]), pieces(value), pieces(seen)],
                names=["block", "shard", "part", "value", "seen"],
            )

    return rows


def merging(sent) -> Callable:
    """Means of a block over shards, weighted by the squared gradients met in the round; summed in one order."""
    flat: list[np.ndarray] = []

    def rows(block: pa.Table) -> pa.Table:
        if not flat:
            flat.extend(sent.value[0].flat())
        block = block.sort_by([("shard", "ascending"), ("part", "ascending")])
        at = block["block"][0].as_py()
        value, seen = (x[at * BLOCK : (at + 1) * BLOCK] for x in flat)
        sums = np.zeros((3, len(value)))
        for v, s in zip(block["value"], block["seen"]):
            v, s = (np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in (v, s))
            met = np.maximum(s - seen, LEAST * (v != value))
            sums += met, met * v, met * s
        moved = sums[0] > 0
        weight = np.where(moved, sums[0], 1)
        means = [np.where(moved, x / weight, old).astype(np.float32).tobytes() for x, old in zip(sums[1:], (value, seen))]
        return pa.table({"block": pa.array([at], pa.int32()), "value": pa.array(means[:1], pa.binary()), "seen": pa.array(means[1:], pa.binary())})

    return rows


def set_languages(model: Model, languages: list[str], counts: np.ndarray) -> None:
    """Log frequencies of hashed words in each language, from how often they occur."""
    model.languages = languages or [""]
    counts = counts + 0.1 if languages else np.full((LANGUAGE_BUCKETS, 1), 0.1)
    model.language_rows = np.log(counts / counts.sum(0)).astype(np.float32)
    model.thresholds = np.zeros(len(model.languages))


def fit_languages(model: Model, texts: list[list[bytes]], languages: list[str | None]) -> None:
    known = sorted({x for x in languages if x is not None})
    counts = np.zeros((LANGUAGE_BUCKETS, len(known)))
    for ws, language in zip(texts, languages):
        if language is not None:
            np.add.at(counts[:, known.index(language)], [crc32(w) % LANGUAGE_BUCKETS for w in ws], 1)
    set_languages(model, known, counts)


def count_languages(model: Model, texts: DataFrame) -> None:
    """``fit_languages`` for shards."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            buckets, found = np.frombuffer(row["buckets"], np.uint16), {}
            for ids, lang in zip(texts_of(row), row["langs"]):
                if lang is not None:
                    found.setdefault(lang, []).append(ids)
            for lang, ids in found.items():
                own, n = np.unique(buckets[np.concatenate(ids)], return_counts=True)
                columns = [pa.array([lang] * (len(own) + 1)), pa.array([*own, 0], pa.int32()), pa.array([*n, 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])  # a language without words is known, too

    got = texts.select("buckets", "ids", "ends", "langs").mapInArrow(rows, "lang string, bucket int, n long")
    got = got.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    known = sorted(got["lang"].unique().to_pylist())
    counts = np.zeros((LANGUAGE_BUCKETS, len(known)))
    place = {lang: k for k, lang in enumerate(known)}
    counts[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    set_languages(model, known, counts)


class Scorer:
    """A model with the words a worker has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.rows, self.speech = [], []
        self.embedded = np.zeros((0, DIMS), np.float32)
        self.spoken = np.zeros((0, len(model.languages)), np.float32)

    def codes(self, ws: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.__init__(self.model)
        new = [w for w in dict.fromkeys(ws) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            count = len(self.known)
            if count > len(self.embedded):  # room for twice as many
                for name, width in (("embedded", DIMS), ("spoken", len(self.model.languages))):
                    grown = np.zeros((2 * count, width), np.float32)
                    grown[: len(getattr(self, name))] = getattr(self, name)
                    setattr(self, name, grown)
            at = slice(count - len(new), count)
            self.embedded[at] = self.model.table[np.array([word_rows(w) for w in new])].sum(1)
            self.spoken[at] = self.model.language_rows[[crc32(w) % LANGUAGE_BUCKETS for w in new]]
        return np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))

    def logit(self, text: str | None) -> tuple[float, int]:
        """The output for a text, and the number of its likeliest language."""
        ws, model = words(text), self.model
        tops = np.zeros(FILTERS * len(WIDTHS), np.float32)
        speech = np.zeros(len(model.languages))
        reach = max(WIDTHS) - 1
        for lo in range(0, len(ws), PIECE):  # pieces overlap, so that no position is missed
            ids = self.codes(ws[lo : lo + PIECE + reach])
            speech += self.spoken[ids[:PIECE]].sum(0)
            found = model.responses(self.embedded[ids])
            tops = np.maximum(tops, np.concatenate([r.max(0) if len(r) else np.zeros(FILTERS, np.float32) for r in found]))
        return float(tops @ model.out + model.constant), int(speech.argmax())

    def score(self, text: str | None) -> tuple[float, str]:
        out, language = self.logit(text)
        z = np.clip(out - self.model.thresholds[language], -700, 700)
        return float(1 / (1 + np.exp(-z))), self.model.languages[language]


def judged(labelled: DataFrame, model: Model) -> DataFrame:
    """Guessed language (its number) and output of labelled rows."""
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                outputs, languages = zip(*(scorer.logit(t.as_py()) for t in batch.column("text")))
                columns = [pa.array(languages, pa.int32()), pa.array(outputs, pa.float64()), batch.column("toxic")]
                yield pa.RecordBatch.from_arrays(columns, names=["language", "output", "toxic"])

    return labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(rows, "language int, output double, toxic int")


def best_thresholds(outputs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """For each language, and for all (-1): n of either label, the output with the best F1 and the next lower one.

    Running sums over a language start from sums of bins of outputs, so no language passes through one task.
    """
    points = outputs.withColumn("language", F.explode(F.array(F.lit(-1), "language"))).groupBy("language", "output").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    points = stored(points.withColumn("bin", F.floor(F.col("output") * BINS)), "toxicity-outputs")
    down = Window.partitionBy("language").orderBy(F.desc("bin"))
    before, every = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("language")
    bins = points.groupBy("language", "bin").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
    bins = bins.select(
        "language", "bin", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in "bg"),
        *(F.sum(x).over(every).alias(f"{x}_all") for x in "bg"),
    )
    within = Window.partitionBy("language", "bin").orderBy(F.desc("output")).rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.sum("bad").over(within) + F.col("b_before")) * weights[1]
    missed = (F.sum("good").over(within) + F.col("g_before")) * weights[0]
    f1 = points.join(bins, ["language", "bin"]).select(
        "language", "output", "b_all", "g_all", (2 * hit / (hit + missed + F.col("b_all") * weights[1])).alias("f1")
    )
    best = f1.groupBy("language").agg(F.max(F.struct("f1", "output"))["output"].alias("best"), F.first("b_all").alias("bad"), F.first("g_all").alias("good"))
    lower = points.select("language", "output").join(F.broadcast(best), "language").groupBy("language", "best", "bad", "good")  # a row for each language
    return lower.agg(F.max(F.when(F.col("output") < F.col("best"), F.col("output"))).alias("below"))


def calibrate(model: Model, labelled: DataFrame, weights: dict[int, float], least: int) -> None:
    """A threshold for each guessed language with ``least`` rows of either label; that of all rows for the others."""
    found = {r["language"]: r for r in best_thresholds(judged(labelled, model), weights).collect()}
    middle = {k: (r["best"] + (r["best"] - 1 if r["below"] is None else r["below"])) / 2 for k, r in found.items()}
    model.thresholds[:] = middle[-1]
    for k in range(len(model.languages)):
        if k in found and min(found[k]["bad"], found[k]["good"]) >= least:
            model.thresholds[k] = middle[k]


def held_out(doc_id: Column) -> Column:
    """Rows that neither fit nor calibrate."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def likely_in(docs: DataFrame, told: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id is not in ``told``, so that few texts are shuffled where that is large.

    Ids set bits of a map of ``MAP_WORDS`` words of 64 bits; rows whose id's bit is not set go.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(64 * MAP_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(64)).cast("int"))
    word = F.shiftright(spot, 6)
    name = fresh(docs, ["word", "bits"])
    bits = told.groupBy(word.alias(name["word"])).agg(F.bit_or(bit).alias(name["bits"]))  # at most MAP_WORDS rows
    met = docs.withColumn(name["word"], word).join(F.broadcast(bits), name["word"])
    return met.filter(F.col(name["bits"]).bitwiseAND(bit) != 0).select(*docs.columns)


def train(
    docs: DataFrame, labels: DataFrame, per_class: int | None = None, rounds: int = 4, seed: int = 7, least: int = 15
) -> Model | None:
    """A model of all labelled rows that are not held out; None if one label is missing.

    A quarter of the documents, by a hash of their id, serves for calibration only. With ``per_class``, only the documents of each
    label with that many smallest hashes are taken.
    """
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = stored(told.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)), "toxicity-told")
    totals = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return None
    if per_class is not None:
        order = F.xxhash64("doc_id", F.lit(seed))
        picks = [told.filter(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
        told = stored(picks[0].unionByName(picks[1]), "toxicity-told")
    language = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    whole = docs.select("doc_id", "text", language.alias("lang")).filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    aside = F.crc32(F.concat(F.lit("aside"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0
    labelled = stored(likely_in(whole, told).join(told, "doc_id").select("doc_id", "text", "lang", "toxic", aside.alias("aside")), "toxicity-labelled")
    counts = labelled.groupBy("toxic", "aside").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    n = {k: sum(r["n"] for r in counts if r["toxic"] == k) for k in (0, 1)}
    if not n[0] or not n[1]:
        return None
    apart = len(counts) == 4  # both parts have both labels
    fitted, left = (labelled.filter(~F.col("aside")), labelled.filter("aside")) if apart else (labelled, labelled)
    size, chars = (sum(r[x] for r in counts if not (apart and r["aside"])) for x in ("n", "chars"))
    texts = coded(fitted, max(math.ceil(size / SHARD_TEXTS), math.ceil(chars / SHARD_CHARS)))
    model = fit_shards(texts, rounds, seed)
    count_languages(model, texts)
    calibrate(model, left, {k: totals[k] / n[k] for k in (0, 1)}, least)
    return model


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5 on) and guessed_language; those names must be free."""
    if model is None:
        nothing = {"score": F.lit(0.0), "predicted": F.lit(0), "guessed_language": F.lit(None).cast("string")}
        return docs.withColumns(nothing)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumns({"score": F.lit(0.0).cast("double"), "predicted": F.lit(0), "guessed_language": F.lit("")}).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                found = [scorer.score(t.as_py()) for t in batch.column("text")]
                scores = [s for s, _ in found]
                new = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([x for _, x in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(rows, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **training: int) -> DataFrame:
    """``docs`` without those the classifier finds toxic. Texts are scored beside the rows' other columns."""
    model = train(docs, labels, **training)
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    kept = score_toxicity(packed, model).filter("predicted = 0")
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "guessed_language")
