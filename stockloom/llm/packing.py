"""Packing of tokenised documents into sequences by patterns of lengths.

Documents are tokenised once and cut into pieces of at most ``size`` tokens. From then on only the
histogram of piece lengths matters, which has ``size`` numbers whatever the input: patterns of one
to three lengths that fill a sequence are enumerated, non-negative least squares says how often to
repeat each so that together they use up the histogram, the repeats are rounded so that their sum
is kept, and what is left is packed by best fit, the longest first. The outcome is a list of slots:
the pieces of one length from one rank to another lie at one offset in consecutive sequences.
Every piece finds its place by its length and its rank among pieces of that length, which is its
rank in its task plus the pieces of that length in the tasks before.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each for
itself; a null doc_id is kept; an empty table packs into no sequences; other columns are ignored.
Special tokens spelled out in a text count as those tokens, as ``tokenizers`` reads them. Texts of
any length, and runs of any one kind of character, are taken whole.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stockloom.llm.common import query, stored, table

#: What the patterns of public vocabularies call white space, as Unicode does.
WHITE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of white space in a row that the pattern engine can't take back one by one.
LONG_GAP = 100_000

#: Slots of lengths below this many bits of rank.
RANK_BITS = 44


@cache
def encoder(ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    """The vocabulary of a file of ranks. Its ids are those ``tokenizers`` gives for the same vocabulary."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


@cache
def long_gap(least: int) -> re.Pattern:
    return re.compile(f"(?<![{WHITE}])[{WHITE}]{{{least},}}+")


def token_ids(encoding: tiktoken.Encoding, text: str, least: int = LONG_GAP) -> np.ndarray:
    """Ids of a text. Runs of white space of ``least`` characters or more, for which the pattern engine has no
    room, are cut out where a match must end: before the run and before its last character, which belongs to
    what follows; a run at the end goes as a whole."""
    if len(text) < least or not long_gap(least).search(text):
        return encoding.encode_to_numpy(text, allowed_special="all")
    marks = sorted(encoding.special_tokens_set, key=len, reverse=True)
    out: list[np.ndarray | list[int]] = []
    for part in re.split(f"({'|'.join(map(re.escape, marks))})", text) if marks else [text]:
        at = 0
        for gap in () if part in marks else long_gap(least).finditer(part):
            end = gap.end() if gap.end() == len(part) else gap.end() - 1
            out += [encoding.encode_to_numpy(part[at : gap.start()], allowed_special="all"), encoding._encode_single_piece(part[gap.start() : end])]
            at = end
        out.append(encoding.encode_to_numpy(part[at:], allowed_special="all"))
    return np.concatenate([np.asarray(x, np.uint32) for x in out])


def token_pieces(
    docs: DataFrame, size: int, end_id: int, ranks_path: str, pattern: str, specials: dict[str, int]
) -> DataFrame:
    """Pieces of every row: doc_id, piece, start, length, ids (32-bit little-endian), and the task
    that made it with the piece's rank among those of its length there."""
    known = tuple(sorted(specials.items()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern, known)
        task, ranks = TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                at, piece, start, length, ids, rank = [], [], [], [], [], []
                for row, text in enumerate(batch.column("text")):
                    tokens = np.append(token_ids(encoding, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    cuts = range(len(tokens) % size or size, len(tokens) + 1, size) if len(tokens) > size else [len(tokens)]
                    lo_token = 0
                    for k, hi_token in enumerate(cuts):
                        n = hi_token - lo_token
                        at.append(row)
                        piece.append(k)
                        start.append(lo_token)
                        length.append(n)
                        ids.append(tokens[lo_token:hi_token].tobytes())
                        rank.append(ranks[n])
                        ranks[n] += 1
                        lo_token = hi_token
                columns = [
                    batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(at), pa.int32()), pa.array(rank, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "task", "rank"])

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(rows, f"doc_id {kind}, piece int, start long, length long, ids binary, task int, rank long")


def patterns(lengths: np.ndarray, size: int, waste: int = 4, most: int = 200_000) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a sequence: pairs up to ``waste`` tokens short,
    triples without waste. Above ``most`` triples an even share of them is enumerated."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    out = []
    for short in range(waste + 1):
        a = lengths[lengths <= (size - short) // 2]
        b = size - short - a
        ok = (b >= 1) & there[b]
        out.append(np.stack([a[ok], b[ok], np.zeros(ok.sum(), int)], 1))
    thin = max(1, -(-size * size // (12 * most)))
    for a in lengths[lengths <= size // 3][::thin]:
        b = lengths[(lengths >= a) & (lengths <= (size - a) // 2)]
        c = size - a - b
        ok = there[c]
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(out).astype(np.int64)


def fit_repeats(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats of each pattern that fit the histogram in least squares, by projected
    gradient steps with momentum. The columns hold at most three entries, so steps are sums by index."""
    used = rows > 0
    index, column = rows[used], np.nonzero(used)[0]
    forward = lambda x: np.bincount(index, weights=x[column], minlength=len(histogram))
    backward = lambda r: np.bincount(column, weights=r[index], minlength=len(rows))
    v = np.ones(len(rows))
    for _ in range(20):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - backward(forward(y) - histogram) / (1.05 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, pieces, first sequence, offset) that hold ``counts`` pieces of each length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    total, slots, sequence = left.copy(), [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # space left: runs of sequences (first, how many)

    def place(length: int, n: int, first: int, offset: int) -> None:
        slots.append((length, int(total[length] - left[length]), n, first, offset))
        left[length] -= n

    if left[size]:
        place(size, int(left[size]), 0, 0)
        sequence = slots[0][2]
    lengths = np.flatnonzero(left)
    rows = patterns(lengths, size) if len(lengths) else np.zeros((0, 3), int)
    if len(rows):
        repeats = np.diff(np.floor(np.cumsum(fit_repeats(rows, left.astype(float))) + 0.5).astype(np.int64), prepend=0)
        for k in np.flatnonzero(repeats):
            need = Counter(int(x) for x in rows[k] if x)
            n = min(int(repeats[k]), *(int(left[x]) // m for x, m in need.items()))
            if n <= 0:
                continue
            offset = 0
            for x in rows[k][rows[k] > 0].tolist():
                place(x, n, sequence, offset)
                offset += x
            if offset < size:
                room.setdefault(size - offset, []).append((sequence, n))
            sequence += n
    for length in range(size - 1, 0, -1):  # best fit, the longest first
        while left[length]:
            fit = min((space for space, runs in room.items() if space >= length and runs), default=None)
            if fit is None:
                n = -(-int(left[length]) // (size // length))
                room.setdefault(size, []).append((sequence, n))
                sequence += n
                continue
            first, have = room[fit].pop()
            n = min(have, int(left[length]))
            place(length, n, first, size - fit)
            if n < have:
                room[fit].append((first + n, have - n))
            if fit > length:
                room.setdefault(fit - length, []).append((first, n))
    return slots


def placed(pieces: DataFrame, slots: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """``pieces`` (with length and their rank overall) with sequence_id and offset."""
    slots = sorted(slots)
    keys = np.array([(s[0] << RANK_BITS) | s[1] for s in slots], np.int64)
    ranks, firsts, offsets = (np.array([s[k] for s in slots], np.int64) for k in (1, 3, 4))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1
            out = [*batch.columns[:-1], pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "rank")
    return pieces.select(*[c for c in pieces.columns if c != "rank"], "rank").mapInArrow(rows, f"{kept}, sequence_id long, `offset` long")


def pack(
    docs: DataFrame, size: int = 1024, end_id: int = 2, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN,
    specials: dict[str, int] | None = None, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids, sequence_id, offset.

    ``ids`` are the piece's tokens, 32 bits each, little-endian; without ``with_ids`` it is their
    CRC-32, so that tokens needn't pass the shuffle that ranks the pieces.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    marks = {"<|endoftext|>": 50256} if specials is None else specials
    pieces = stored(token_pieces(docs, size, end_id, path, pattern, marks), "pieces")
    by_task = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    shown = pieces.withColumn("ids", F.col("ids") if with_ids else F.crc32("ids"))
    ranked = shown.join(tasks, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    return placed(ranked.select("doc_id", "piece", "start", "length", "ids", "rank"), plan_slots(counts, size))


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its tokens, 32 bits each, and its pieces in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda out, x: F.concat(out, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"),
    )


@query("op3_packing")
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), size=1024, end_id=2, with_ids=False).select(
        "doc_id", "piece", "start", "length", F.col("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
