"""Secret scan: patterns that stand alone, and weak parts that count only next to what completes them.

Strong kinds are reported wherever they occur: ``assign`` (a named value), ``access`` (an access
identifier) and ``hex`` (a long hexadecimal run). Weak kinds are ``token`` (a bare 40-character
value), ``client`` (a named client or user) and ``endpoint`` (a url). Each part has a role:
identifier, secret or place. A token is reported if an identifier lies within ``scope`` characters,
a client if a secret does, an endpoint if both do. Parts are put into blocks of ``scope``
characters, each block is summed up by its first and last part of a role, and the weak parts meet
the sums of their own and the two neighbouring blocks in an equality join: an interval join
without pairs.

Only DataFrame functions are used. Defined cases: a null text is empty and has no spans; rows equal
in doc_id and text share their spans and come out as often as they went in; null doc_ids are kept;
of matches that overlap within a kind the leftmost counts; a weak part that begins inside a strong
span is not reported; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from stockloom.llm.common import query, stored, table

ASSIGN = (
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])"
CLIENT = r"""\b(?:client_id|account_id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""https?://[^\s"'<>]{4,}"""

#: kind: (order among kinds, role, weak)
KINDS = {
    "assign": (0, "secret", False), "access": (1, "identifier", False), "hex": (2, "secret", False),
    "token": (3, "secret", True), "client": (4, "identifier", True), "endpoint": (5, "place", True),
}
NEEDS = {"token": ["identifier"], "client": ["secret"], "endpoint": ["identifier", "secret"]}


def holds(text: Column) -> dict[str, Column]:
    """Cheap tests that every text with a match of a kind passes."""
    low = F.lower(text)
    some = lambda *names: F.array_max(F.array(*(low.contains(n) for n in names)))
    return {
        "assign": low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token")
        | low.contains("apikey") | low.contains("api_key"),
        "access": text.contains("AKIA"),
        "hex": text.rlike(r"[0-9a-f]{32}"),
        "token": text.rlike(TOKEN),
        "client": low.contains("client_id") | low.contains("account_id") | low.contains("user") | low.contains("login"),
        "endpoint": text.contains("http"),
    }


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, before, value): each match and the text between it and the one before."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["before"]).alias("before"), x["value"].alias("value")))


def parts_of(docs: DataFrame) -> DataFrame:
    """All matches of all kinds: doc_id, copy, kind, start, end, value; and one row of null kind for each row of ``docs``.

    A match starts after the lengths of all texts between and of all matches before it, summed over the document's matches.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN, "client": CLIENT, "endpoint": ENDPOINT}
    tests = holds(F.col("text"))
    none = F.array().cast("array<struct<kind:string,before:int,value:string>>")
    found = F.concat(*(F.when(tests[k], matches(F.col("text"), p, k)).otherwise(none) for k, p in patterns.items()))
    parts = rows.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode_outer(F.filter(found, lambda x: x["value"].isNotNull())).alias("at", "part"))
    so_far = W.partitionBy("doc_id", "copy", "part.kind").orderBy("at")
    # rows that repeat bring each match again: one of each is kept, and the rows are counted
    folded = parts.groupBy("doc_id", "copy", "at", "part").agg(F.count(F.lit(1)).alias("copies"))
    end = F.sum(F.col("part.before").cast("long") + F.length("part.value")).over(so_far)
    return folded.select(
        "doc_id", "copy", "copies", F.col("part.kind").alias("kind"), F.col("part.value").alias("value"),
        (end - F.length("part.value")).alias("start"), end.alias("end"),
    )


def strong(kind: Column, value: Column) -> Column:
    """Whether a match of a strong kind is long enough to count."""
    return F.when(kind == "assign", F.length(F.regexp_extract(value, ASSIGN, 2)) >= 8).otherwise(True)


def secret_spans(docs: DataFrame, scope: int = 200) -> DataFrame:
    """All spans of every document (doc_id, copy, copies, kind, start, end, value), a row of null kind where it has none."""
    parts = stored(parts_of(docs), "parts")
    of = lambda i: F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[i])))[F.col("kind")]
    kept = parts.filter(F.col("kind").isNull() | strong(F.col("kind"), F.col("value")))
    before = W.partitionBy("doc_id", "copy").orderBy("start", of(0)).rowsBetween(W.unboundedPreceding, W.currentRow)
    covered = F.max(F.when(~of(2), F.col("end"))).over(before)
    real = kept.filter("kind is not null").withColumn("covered", covered).filter(
        ~of(2) | F.col("covered").isNull() | (F.col("covered") <= F.col("start"))
    ).drop("covered").withColumns({"role": of(1), "weak": of(2), "block": F.floor(F.col("start") / scope)})
    real = stored(real, "spans")
    sums = real.groupBy("doc_id", "copy", "role", "block").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = sums.select(
        F.col("doc_id").alias("n_doc"), F.col("copy").alias("n_copy"), F.col("role").alias("n_role"), "first", "last",
        F.explode(F.array(*(F.col("block") + i for i in (-1, 0, 1)))).alias("n_block"),
    )
    needs = F.create_map(*(x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*(F.lit(r) for r in v)))))[F.col("kind")]
    weak = real.filter("weak").withColumn("need", F.explode(needs))
    close = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope) | (
        (F.col("first") <= F.col("start")) & (F.col("last") >= F.col("start"))
    )
    met = weak.join(
        near, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("copy") == F.col("n_copy")) & (F.col("need") == F.col("n_role"))
        & (F.col("block") == F.col("n_block")) & close, "left_semi",
    )
    span = ["doc_id", "copy", "copies", "kind", "start", "end", "value"]
    complete = met.groupBy(*span).agg(F.count_distinct("need").alias("met"), F.any_value(F.size(needs)).alias("all")).filter("met = all")
    rows = parts.select("doc_id", "copy", "copies").distinct()
    empty = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(dict(parts.dtypes)[c]).alias(c) for c in span))
    return real.filter("not weak").select(span).unionByName(complete.select(span)).unionByName(empty)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@query("op10_secrets")
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    order = F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[0])))[F.col("kind")]
    item = F.struct("start", order.alias("order"), "end", "kind")
    base = F.col("kind").isin("assign", "access", "hex")
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    return (
        secret_spans(table(spark, folder, "documents"))
        .groupBy("doc_id", "copy")
        .agg(
            F.max("copies").alias("copies"), n("assign"), n("access"), n("hex"),
            joined(F.sort_array(F.collect_list(F.when(base, item)))).alias("base"),
            joined(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), item)))).alias("spans"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
    )
