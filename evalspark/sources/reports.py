"""Tables for people: Markdown and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line) of a Markdown table in that order, head first; a report's rows are few, so its last step is one task.
    Marks that part cells and line breaks are escaped, a missing value is an empty cell."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\R", "<br>")
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = rows.sparkSession.range(2).select(F.when(F.col("id") == 0, line([F.lit(c) for c in columns])).otherwise(line([F.lit("---")] * len(columns))).alias("line"), F.lit(0).alias("_body"), F.struct(F.col("id")).cast("string").alias("_at"))
    body = rows.orderBy(*order).select(line([cell(F.col(c)) for c in columns]).alias("line"), F.lit(1).alias("_body"), F.format_string("%020d", F.monotonically_increasing_id()).alias("_at"))
    return head.unionByName(body).orderBy("_body", "_at").select("line")


def compacted(rows: DataFrame) -> DataFrame:
    """rows with lists joined by |, maps as sorted k=v joined by |, and other nested values as JSON, for CSV."""

    def flat(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("array<struct") or kind.startswith("struct"):
            return F.to_json(c)
        if kind.startswith("array"):
            return F.array_join(c.cast("array<string>"), "|")
        if kind.startswith("map"):
            return F.array_join(F.transform(F.array_sort(F.map_entries(c.cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
        return c

    return rows.select(*[flat(n, k).alias(n) for n, k in rows.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a head in each file; quotes are doubled, as spreadsheets read them."""
    compacted(rows).write.option("header", "true").option("escape", '"').option("quoteAll", "true").option("nullValue", "").csv(path)
