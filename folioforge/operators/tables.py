"""Tables of text: CSV and Markdown tables from rows, cells from CSV, column widths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import markers, values
from folioforge.operators.outline import joined

BODY_POINTS, LEAST_POINTS = 468.0, 40.0


def as_text(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def csv_rows(df: DataFrame, columns: Sequence[str], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[values.csv_field(c, delimiter) for c in as_text(df, columns)])


def csv_documents(df: DataFrame, by: str, order: str, columns: Sequence[str], delimiter: str = ",") -> DataFrame:
    """(by, csv): each group's rows in order as one CSV document with CRLF line ends."""
    rows = df.select(F.col(by).alias("doc_id"), F.col(order).alias("__order"), F.concat(csv_rows(df, columns, delimiter), F.lit("\r\n")).alias("__row"))
    return joined(rows, "__order", "__row", "", "csv")


def markdown_tables(df: DataFrame, by: str, order: str, columns: Sequence[str], alignments: Sequence[str] | None = None) -> DataFrame:
    """(by, markdown): each group's rows in order as a Markdown table with the columns' names as header."""
    marks = {"left": ":---|", "center": ":---:|", "right": "---:|"}
    head = "|" + "|".join(f" {c} " for c in columns) + "|\n|" + "".join(marks.get(a, "---|") for a in alignments or [""] * len(columns)) + "\n"
    cells = [F.concat(F.lit(" "), markers.table_cell(c), F.lit(" |")) for c in as_text(df, columns)]
    rows = df.select(F.col(by).alias("doc_id"), F.col(order).alias("__order"), F.concat(F.lit("|"), *cells, F.lit("\n")).alias("__row"))
    out = joined(rows, "__order", "__row", "", "markdown")
    return out.select("doc_id", F.concat(F.lit(head), "markdown").alias("markdown"))


def column_widths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, longest, width): the page's width shared out by the longest content of each column,
    headers included, with a least width for each."""
    texts = as_text(df, columns)
    longest = df.agg(*[F.greatest(F.coalesce(F.max(F.length(t)), F.lit(0)), F.lit(len(c))).cast("long").alias(c) for t, c in zip(texts, columns, strict=True)])
    n = len(columns)
    pool = max(BODY_POINTS - n * LEAST_POINTS, 0.0)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("longest")) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0))
    rows = longest.select(total.alias("total"), F.inline(pairs))
    share = F.when(F.col("total") == 0, 1.0 / n).otherwise(F.col("longest") / F.col("total"))
    return rows.select("column", "longest", F.concat(F.format_string("%.1f", LEAST_POINTS + share * pool), F.lit("pt")).alias("width"))


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of a CSV text, leniently: quoted fields may span lines; what follows a closing quote before
    the delimiter ends the row; an open quote runs to the end; a last blank line is no row."""
    rows: list[list[str]] = []
    at, n = 0, len(text)
    while at < n:
        row: list[str] = []
        while True:
            if at < n and text[at] == '"':
                field, at = [], at + 1
                while at < n:
                    end = text.find('"', at)
                    if end < 0:
                        field.append(text[at:])
                        at = n
                        break
                    field.append(text[at:end])
                    at = end + 1
                    if at < n and text[at] == '"':
                        field.append('"')
                        at += 1
                    else:
                        break
                row.append("".join(field))
            else:
                end = at
                while end < n and text[end] not in (delimiter, "\n", "\r"):
                    end += 1
                row.append(text[at:end])
                at = end
            if at < n and text[at] == delimiter:
                at += 1
                continue
            if text.startswith("\r\n", at):
                at += 2
            elif at < n and text[at] in "\r\n":
                at += 1
            break
        rows.append(row)
    if rows and rows[-1] == [""]:
        rows.pop()
    return rows


def csv_cells(docs: DataFrame, text: str = "text", delimiter: str = ",") -> DataFrame:
    """(doc_id, row_ix, col_ix, value): cells of CSV documents. Quotes may span lines, so rows are found
    by a scan in Arrow batches; a document is one row of the input and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse_csv((t.as_py() or "").removeprefix("﻿"), delimiter) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(parsed, pa.list_(pa.list_(pa.string())))], names=["doc_id", "rows"])

    plain = docs.select("doc_id", F.col(text).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    rows = plain.mapInArrow(run, f"doc_id {kind}, rows array<array<string>>").select("doc_id", F.posexplode("rows").alias("row_ix", "row"))
    cells = rows.select("doc_id", F.col("row_ix").cast("long").alias("row_ix"), F.posexplode("row").alias("col_ix", "value"))
    return cells.withColumn("col_ix", F.col("col_ix").cast("long"))
