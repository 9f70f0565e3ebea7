"""Report documents: JSON with nulls kept, and plain HTML of the scoreboard, as text columns and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(*columns: str) -> Column:
    """The columns as indented JSON; nulls are written, not left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": "true"})


def escaped(text: Column) -> Column:
    """Text for HTML: null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def html_tables(scoreboard: DataFrame, by: str = "platform") -> DataFrame:
    """by, html: one table per group, rows in order of their first column."""
    shown = [c for c in scoreboard.columns if c != by]
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in shown], F.lit("</tr>"))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in shown) + "</tr>"
    rows = scoreboard.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(shown[0]).alias("k"), cells.alias("row")))).alias("rows"))
    return rows.select(by, F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table>")).alias("html"))


def write_reports(reports: DataFrame, text: str, path: str, by: str = "platform") -> None:
    """Text files under path/by=value; writing again replaces them."""
    reports.select(by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(by).text(path, lineSep="\n")
