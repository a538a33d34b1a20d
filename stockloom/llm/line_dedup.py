"""Repeated lines across documents, by winnowing.

A run is a stretch of lines, blank ones left out, and counts from ``min_words`` words on. Windows are the
shortest runs that begin with a line, the shortest that end with a line, and pairs of lines that are long
enough each: together they cover every run with the blank lines inside. Of every window the least line hash is
selected, so two texts that share a window share a selected line: a fingerprint that can't be
missed. Positions of equal fingerprints are joined, and only windows around fingerprints that occur
more than once go on. There the match is extended both ways to the whole window, which is compared
by 128 bits of hash over its lines. A window that occurred before, at an earlier line or in a
document with a smaller doc_id, is a repeat; repeats that overlap or touch make up one run, from its first
line to its last, and runs are deleted. The first occurrence of every line stays somewhere.

Only DataFrame functions are used. Defined cases: a null text stays null and has no lines; an empty
text stays empty; a document all of whose lines repeat becomes empty; rows equal in doc_id and text
count as one place and lose the same lines; documents that share a doc_id are ordered by a hash of
their text; a null doc_id comes first; lines are compared without spaces at their ends; other
columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from stockloom.llm.common import fresh, query, salted_join, stored, table, words_of

KEY = ["doc_id", "copy"]


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, copy, start and end (lines, both in), print (least line hash), at (its line) and the two content hashes."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    facts = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), words_of(x).alias("w")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(facts).alias("line", "f"))
    rows = rows.filter("f.w > 0").select("doc_id", "copy", "line", "f.h", "f.w").distinct()
    order = W.partitionBy(*KEY).orderBy("line")
    so_far = rows.withColumn("p", F.sum("w").over(order) - F.col("w"))
    line = F.struct("h", "line", "p", "w")
    before = lambda x: F.col("p") + F.col("w") - x["p"]  # noqa: E731  words from line x to this one, both in
    run = F.collect_list(line).over(order.rowsBetween(0, min_words - 1))  # no line is without words, so none is longer
    cut = F.filter(F.col("run"), lambda x: x["p"] < F.col("p") + min_words)
    least = F.array_min(F.transform("cut", lambda x: F.struct(x["h"], (-x["line"]).alias("back"))))
    first, last = F.element_at("cut", 1), F.element_at("cut", -1)
    back = F.filter(F.col("back"), lambda x: before(x) - x["w"] < min_words)
    # what also is the shortest run from its first line on is left to that
    back = F.when(before(F.element_at(back, 1)) - F.col("w") >= min_words, back)
    pair = F.when((F.col("w") >= min_words) & (F.get(F.col("run")["w"], F.lit(1)) >= min_words), F.slice("run", 1, 2))
    runs = so_far.withColumns({"run": run, "back": F.collect_list(line).over(order.rowsBetween(1 - min_words, 0))})
    runs = runs.select(*KEY, F.explode(F.array(cut, back, pair)).alias("cut")).filter("cut is not null")
    hashes = F.transform("cut", lambda x: x["h"])
    return (
        runs.withColumn("first", first).withColumn("last", last)
        .filter(F.col("last.p") + F.col("last.w") >= F.col("first.p") + min_words)
        .select(
            *KEY, F.col("first.line").alias("start"), F.col("last.line").alias("end"), least["h"].alias("print"), (-least["back"]).alias("at"),
            F.xxhash64(hashes).alias("c1"), F.xxhash64(F.lit("second"), hashes).alias("c2"),
        )
    )


def repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """Windows that occurred before: doc_id, copy, start, end."""
    selected = stored(
        windows(docs, min_words).groupBy(*KEY, "at", "print").agg(F.collect_list(F.struct("start", "end", "c1", "c2")).alias("around")), "prints"
    )
    often = stored(selected.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-prints")
    spots = salted_join(selected, often, ["print"], "n", [*KEY, "at"], "inner")
    matched = stored(spots.select(*KEY, F.inline("around")), "matched")
    place = F.struct(*KEY, "start")
    firsts = stored(
        matched.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"), "first-windows"
    )
    later = salted_join(matched, firsts, ["c1", "c2"], "n", [*KEY, "start"], "inner")
    return later.filter(place > F.col("first")).select(*KEY, "start", "end")


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Runs of lines to delete, one row per document: doc_id, copy, runs (start and end line, both in, in order)."""
    order = W.partitionBy(*KEY).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") > F.coalesce(reach, F.lit(-1)) + 1, 1).otherwise(0)
    islands = repeats(docs, min_words).withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = islands.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """``lines`` without the runs, slice by slice."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(runs)),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.element_at(runs["end"], F.greatest(i, F.lit(1))) + 1).alias("lo"),
            F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs["start"], i)).alias("hi"),
        ),
    )
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["lo"] + 1, F.greatest(g["hi"] - g["lo"], F.lit(0)))))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without repeated runs in ``text``, and columns for n_lines, n_removed and the removed
    runs; and the names those columns got, as ``docs`` may use any."""
    names = fresh(docs, ["n_lines", "n_removed", "runs", "copy", "of_doc", "of_copy", "found"])
    copy, of_doc, of_copy, found = (names.pop(x) for x in ("copy", "of_doc", "of_copy", "found"))
    runs = repeated_runs(docs.select("doc_id", "text"), min_words).select(
        F.col("doc_id").alias(of_doc), F.col("copy").alias(of_copy), F.col("runs").alias(found)
    )
    lines = F.split("text", "\n")
    removed = F.aggregate(found, F.lit(0), lambda a, r: a + (r["end"] - r["start"] + 1).cast("int"))
    own = docs.withColumn(copy, F.xxhash64("text"))
    joined = own.join(runs, F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.col(copy) == F.col(of_copy)), "left")
    cut = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col(found)), "\n"))
    out = joined.select(
        *[F.col(c) for c in docs.columns if c != "text"],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias(names["n_lines"]),
        F.coalesce(removed, F.lit(0)).cast("long").alias(names["n_removed"]),
        F.coalesce(found, F.array().cast(dict(runs.dtypes)[found])).alias(names["runs"]),
        cut.alias("text"),
    )
    return out, names


SQL = r"""
WITH raw AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (
  SELECT doc_id, i - 1 AS line, trim(lines[i], ' ') AS x
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM raw WHERE text IS NOT NULL))),
f AS (SELECT *, length(x) - length(replace(x, ' ', '')) + 1 AS w FROM l WHERE x <> ''),
p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line) - w AS p FROM f),
r AS (
  SELECT doc_id, line, p, w, list({'x': x, 'line': line, 'p': p, 'w': w}) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS ahead,
    list({'x': x, 'line': line, 'p': p, 'w': w}) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS behind FROM p),
c AS (
  SELECT doc_id, list_filter(ahead, lambda e: e.p < p + 50) AS cut FROM r
  UNION ALL SELECT doc_id, list_filter(behind, lambda e: p + w - e.p - e.w < 50) FROM r
  UNION ALL SELECT doc_id, ahead[1:2] FROM r WHERE w >= 50 AND ahead[2].w >= 50),
win AS (
  SELECT DISTINCT doc_id, cut[1].line AS s, cut[len(cut)].line AS e, list_transform(cut, lambda e: e.x) AS content
  FROM c WHERE cut[len(cut)].p + cut[len(cut)].w >= cut[1].p + 50),
later AS (
  SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS line FROM later),
kept AS (
  SELECT doc_id, string_agg(y, chr(10) ORDER BY i) AS text
  FROM (SELECT doc_id, i - 1 AS i, lines[i] AS y
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM raw WHERE text IS NOT NULL))) a
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = a.doc_id AND g.line = a.i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
  CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
"""


@query("op2_line_dedup", SQL)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out, names = dedup_lines(docs, min_words=50)
    return out.select("doc_id", "text", F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_removed"]).alias("n_removed"))
