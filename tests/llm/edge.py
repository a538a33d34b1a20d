"""Small tables with every awkward case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
#: Columns named like those operators add.
CLASHES = "copy runs spans items clean n n_words score predicted row key rank line start end value kind part n_lines of_doc found Place".split()


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], clashes: bool = True) -> DataFrame:
    more = {name: f"kept {name}" for name in CLASHES} if clashes else {}
    data = [(i, t, "en", "src", None if t is None else len(t), *more.values()) for i, t in rows]
    columns = ", ".join(f"`{c}` string" for c in more)
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long" + (f", {columns}" if columns else ""))


def by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
