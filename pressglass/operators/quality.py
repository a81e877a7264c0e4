"""Quality of read text: degenerate repetition, line statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressglass.functions.text import WS

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def clean_lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping ones."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def repetition_gate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = 8, least_unique: float = 0.55, least_length: int = 800) -> DataFrame:
    """id, reason: empty, repeated lines, repeated phrase, or blank for text that passes."""
    rows = docs.select(F.col(id_col), F.explode(F.array(clean_lines(F.col(text_col)))).alias("lines"), F.regexp_replace(F.coalesce(text_col, F.lit("")), f"{WS}+", " ").alias("flat"))
    few = (F.size("lines") >= least_lines) & (F.size(F.array_distinct("lines")) / F.greatest(F.size("lines"), F.lit(1)) < least_unique)
    again = F.lit(False)
    for n in (40, 80, 160):
        again |= (F.length("flat") > least_length) & (occurrences(F.col("flat"), F.right("flat", F.lit(n))) >= 5)
    return rows.select(id_col, F.when(F.size("lines") == 0, "empty").when(few, "repeated lines").when(again, "repeated phrase").otherwise("").alias("reason"))


def line_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines, n_unique, top_line, top_n over lines that aren't blank; the first in order of equally frequent ones.

    Counted within the row, nothing is shuffled: places of lines, sorted by line, are cut where the line changes.  Texts without
    lines give no row.
    """
    rows = docs.select(id_col, F.explode(F.array(clean_lines(F.col(text_col)))).alias("l")).where(F.size("l") > 0)
    rows = rows.select(id_col, F.explode(F.array(F.array_sort(F.transform("l", lambda x, i: F.struct(x.alias("line"), i.alias("pos")))))).alias("s"))
    starts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", F.greatest(i - 1, F.lit(0)))["line"] != F.get("s", i)["line"]))
    rows = rows.select(id_col, "s", F.explode(F.array(starts)).alias("at"))
    runs = F.transform("at", lambda a, k: F.struct((F.coalesce(F.get("at", k + 1), F.size("s")) - a).cast("long").alias("n"), (-F.get("s", a)["pos"]).alias("order"), F.get("s", a)["line"].alias("line")))
    rows = rows.select(id_col, F.size("s").cast("long").alias("n_lines"), F.size("at").cast("long").alias("n_unique"), F.array_max(runs).alias("top"))
    return rows.select(id_col, "n_lines", "n_unique", F.col("top.line").alias("top_line"), F.col("top.n").alias("top_n"))
