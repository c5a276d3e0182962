"""Reports as text: a table in Markdown, or an object a line in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cell(name: str) -> Column:
    text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"[\r\n]+", " ")


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(rows: DataFrame, order: list[Column], most: int = 10_000) -> DataFrame:
    """no, line: the first ``most`` rows as a Markdown table, its two heading lines first. Nulls are empty cells, bars are escaped, breaks are spaces."""
    names = rows.columns
    first = rows.orderBy(*order).limit(most)  # so few that one window numbers them
    body = first.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("no"), _row([_cell(n) for n in names]).alias("line"))
    heading = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(n.replace('|', chr(92) + '|') for n in names)} |"), (1, f"| {' | '.join(['---'] * len(names))} |")], "no int, line string")
    return heading.unionByName(body)


def json_lines(rows: DataFrame) -> DataFrame:
    """line: each row as an object; nulls are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("line"))


def write_report(lines: DataFrame, path: str) -> None:
    """Lines as one text file in ``path``, in order of ``no`` where they have one; a report of many rows is better written as a table."""
    ordered = lines.orderBy("no").select("line") if "no" in lines.columns else lines.select("line")
    ordered.coalesce(1).write.mode("overwrite").text(path)
