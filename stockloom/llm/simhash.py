"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has 64 bits, each the majority of that bit in the hashes of its word
shingles. Fingerprints link if they differ in at most two bits. The fingerprint is cut into two
segments, so that of a linked pair one segment differs by one bit at most. Segments are indexed
as they are and once for each bit left out; a pair that links shares one of these variants,
so the pairs are found by equality and then verified over all 64 bits. With two bits, gaps of one
segment are enough: what differs by one bit in either segment is found there.

Rows of one fingerprint are folded before anything is joined, and come back at the end. A variant
that more than ``dense`` fingerprints share isn't paired: its members get variants of the other
segment too, with as many bits left out as may still differ. Members of such a double variant
differ in the two left-out bits at most, so all of them link, and a link from each to the smallest
stands for all pairs. Linked fingerprints are then joined to components, by stars that shrink.

Defined cases: a null or blank text has no words, fingerprint zero, and links like any other; a
text of fewer words than a shingle is one shingle; rows that repeat share their fingerprint and
component; a component without any doc_id has none as its id; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from xxhash import xxh64_intdigest

from stockloom.llm.common import fresh, query, salted_join, stored, table

SEED = 42
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str | None, size: int) -> Iterator[bytes]:
    """Runs of ``size`` words joined by a space; all words if there are fewer; nothing of no words."""
    ws = (text or "").encode("utf-8").lower().split()
    if not ws:
        return iter(())
    if len(ws) < size:
        return iter((b" ".join(ws),))
    return map(b" ".join, zip(*(ws[k:] for k in range(size))))


def fingerprint(text: str | None, size: int) -> int:
    """Signed 64 bits, each set if it is in more than half of the shingles' hashes."""
    hashes = np.fromiter(map(xxh64_intdigest, shingles(text, size), repeat(SEED)), np.uint64)
    counts = np.empty(64, np.int64)
    columns = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):  # bytes are counted, then bits of the byte values
        counts[8 * k : 8 * k + 8] = np.bincount(columns[:, k], minlength=256) @ BITS
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, copy (a hash that tells texts of one doc_id apart) and fp (64 bits as a signed number) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = [fingerprint(texts[i].as_py(), shingle) for i in range(batch.num_rows)]
            columns = [batch.column("doc_id"), batch.column("copy"), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "fp"])

    kept = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    return kept.mapInArrow(rows, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, copy long, fp long")


def half(fp: Column, segment: int) -> Column:
    """32 bits of a fingerprint."""
    return F.shiftright(fp, 32 * segment).bitwiseAND(F.lit((1 << 32) - 1))


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def variants(prints: DataFrame, max_distance: int) -> DataFrame:
    """(variant, fp): each segment whole, and the first with each of its bits left out.

    A pair that differs in one bit of either segment meets in a gap of the first already, so gaps
    of the second would only find it again; at a distance of 1 one segment is equal, and whole
    segments do. A variant packs the segment, its gap plus one (0: whole) and the bits that are left.
    """
    first, second = half(F.col("fp"), 0), half(F.col("fp"), 1)
    name = lambda segment, gap: F.lit((segment << 38) | ((gap + 1) << 32))
    found = [first.bitwiseOR(name(0, -1)), second.bitwiseOR(name(1, -1))]
    if max_distance == 2:
        found += [first.bitwiseAND(F.lit(((1 << 32) - 1) & ~(1 << gap))).bitwiseOR(name(0, gap)) for gap in range(32)]
    return prints.select(F.explode(F.array(*found)).alias("variant"), "fp")


def segment_of(variant: Column) -> Column:
    return F.shiftright(variant, 38)


def gap_of(variant: Column) -> Column:
    """The bit left out, -1 if none is."""
    return F.shiftright(variant, 32).bitwiseAND(F.lit(63)) - 1


def pair_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links within the variants of few members. A gap counts only for pairs that differ there, as
    pairs equal in the segment meet in the whole one."""
    groups = members.groupBy("variant").agg(F.collect_list("fp").alias("fps"))
    near = F.filter("fps", lambda x: (x > F.col("a")) & (distance(x, F.col("a")) <= max_distance))
    pairs = groups.select("variant", F.explode("fps").alias("a"), "fps").select("variant", "a", F.explode(near).alias("b"))
    gap = gap_of(F.col("variant"))
    differ = F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(bit(F.greatest(gap, F.lit(0)))) != 0
    return pairs.filter((gap < 0) | differ).select("a", "b")


def star_links(members: DataFrame, max_distance: int) -> DataFrame:
    """Links within variants of many members: each member to the smallest of its double variant.

    The other segment leaves out as many bits as may still differ, in all ways there are. A double
    variant leaves two bits open at most, so it has four members at most.
    """
    one = [1 << i for i in range(32)]
    two = [(1 << i) | (1 << j) for i in range(32) for j in range(i)]
    masks = {0: [0], 1: one, 2: two}
    array = lambda values: F.array(*map(F.lit, values)).cast("array<long>")
    variant = F.col("variant")
    mask = F.when(gap_of(variant) < 0, array(masks[max_distance])).otherwise(array(masks[max_distance - 1]))
    rest = F.when(segment_of(variant) == 1, half(F.col("fp"), 0)).otherwise(half(F.col("fp"), 1))
    double = members.select("variant", "fp", rest.alias("rest"), F.explode(mask).alias("mask")).select(
        "variant", "mask", F.col("rest").bitwiseAND(F.bitwise_not("mask")).alias("rest"), "fp"
    )
    stars = double.groupBy("variant", "mask", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
    return stars.select("a", F.explode("fps").alias("b")).filter("a < b")


def links(prints: DataFrame, max_distance: int = 2, dense: int = 64) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp, each once) at ``max_distance`` bits or
    less, so many that all such pairs are joined by a path. ``dense`` changes the work, not the result."""
    if max_distance not in (1, 2):
        raise ValueError("two segments with one gap each serve distances of 1 and 2")
    indexed = variants(prints, max_distance)
    sizes = indexed.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("size", F.col("n"))
    members = stored(salted_join(indexed, stored(sizes, "variants"), ["variant"], "n", ["fp"], "inner", merge=True), "members")
    few = pair_links(members.filter(F.col("size") <= dense), max_distance)
    return few.unionByName(star_links(members.filter(F.col("size") > dense), max_distance)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a < b): the smallest node it can reach.

    In each round every node hooks to its smallest smaller neighbour, chains of hooks are halved
    until all lead to a root, and edges are redrawn between roots. Rounds end when no edge is left.
    """
    edges, labels = stored(edges.select("a", "b").distinct(), "edges"), None
    while not edges.isEmpty():
        hooks = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            step = hooks.join(up, F.col("root") == F.col("mid"), "left")
            step = stored(step.select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "hooks")
            hooks = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        to = hooks.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        moved = lambda df, c: df.join(to, F.col(c) == F.col("mid"), "left").withColumn(c, F.coalesce("top", c)).drop("mid", "top")
        labels = stored(hooks if labels is None else moved(labels, "root").unionByName(hooks), "labels")
        drawn = moved(moved(edges, "a"), "b").filter("a <> b")
        edges = stored(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(docs: DataFrame, shingle: int, max_distance: int, dense: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows; fingerprints with their root; roots with their first document.

    The first has the smallest doc_id, and the smallest copy among rows that share it; no doc_id comes last.
    """
    own = stored(fingerprints(docs, shingle), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy")
    prints = stored(own.groupBy("fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    roots = components(links(prints.select("fp"), max_distance, dense))
    rooted = stored(
        prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("members")), "least")
    return own, rooted.drop("first"), least


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, dense: int = 64) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id it links to, over any number of links) of every row."""
    own, rooted, least = groups(docs, shingle, max_distance, dense)
    found = least.select("root", "members", F.col("first.doc_id").alias("component_id"))
    judged = stored(salted_join(rooted, found, ["root"], "members", ["fp"], "inner").select("fp", "n", "component_id"), "judged")
    return salted_join(own, judged, ["fp"], "n", ["doc_id"], "inner").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2, dense: int = 64) -> DataFrame:
    """The first document of each component, as a whole row; of rows equal in doc_id and text one stays."""
    least = groups(docs, shingle, max_distance, dense)[2]
    names = fresh(docs, ["unnamed", "doc", "copy", "place"])
    key = [names[k] for k in ("unnamed", "doc", "copy")]
    of = lambda doc_id, copy: dict(zip(key, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), copy)))
    first = least.select(*(c.alias(n) for n, c in of(F.col("first.doc_id"), F.col("first.copy")).items()))
    kept = docs.withColumns(of(F.col("doc_id"), F.xxhash64("text"))).join(first, key, "left_semi")
    # numbered within the keys of the join, so that the rows are dealt out once
    ranked = kept.withColumn(names["place"], F.row_number().over(W.partitionBy(*key).orderBy(names["copy"])))
    return ranked.filter(F.col(names["place"]) == 1).select(*docs.columns)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=3, max_distance=2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
