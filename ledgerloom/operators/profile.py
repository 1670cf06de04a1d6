"""Profiles of tables, and of the columns described in HTML pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
NULL_TOKENS = ["", "na", "n/a", "nan", "null", "none", "-", "?"]
#: Headings that say a table describes columns.
COLUMN_HEADINGS = ("column", "field", "variable", "attribute", "feature", "name")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, n_missing, n_distinct, n_numeric, mean, sd, low, high) of each column read as text; the distinct count is approximate (HyperLogLog, 5 %). One pass for all columns, no shuffle of rows."""
    columns = columns or df.columns
    text = {c: F.trim(F.col(f"`{c}`").cast("string")) for c in columns}
    missing = {c: F.coalesce(F.lower(text[c]).isin(NULL_TOKENS), F.lit(True)) for c in columns}
    number = {c: F.when(~missing[c], F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")) for c in columns}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x = F.when(~F.isnan(number[c]), number[c])
        aggs.append(F.struct(F.lit(c).alias("column"), F.count_if(missing[c]).alias("n_missing"), F.approx_count_distinct(F.when(~missing[c], text[c])).alias("n_distinct"), F.count(x).alias("n_numeric"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high")).alias(f"c{i}"))
    one = df.agg(*aggs)
    return one.select("n", F.inline(F.array(*[f"c{i}" for i in range(len(columns))]))).select("column", "n", "n_missing", "n_distinct", "n_numeric", "mean", "sd", "low", "high")


def html_columns(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, table_no, column, description): the rows of those HTML tables whose first heading names columns. Broken markup gives what can be read; null pages nothing."""
    table, row, cell, tag = (re.compile(p, re.I | re.S) for p in (r"<table\b.*?</table>", r"<tr\b.*?(?:</tr>|(?=<tr)|$)", r"<t[hd]\b[^>]*>(.*?)(?=</t[hd]>|<t[hd]\b|</tr>|$)", r"<[^>]+>"))

    @F.pandas_udf("array<struct<table_no:int,column:string,description:string>>")
    def found(pages_: pd.Series) -> pd.Series:
        def of(html: str) -> list[dict]:
            out = []
            for k, t in enumerate(table.finditer(html)):
                lines = [[re.sub(r"\s+", " ", tag.sub(" ", c)).strip() for c in cell.findall(r.group())] for r in row.finditer(t.group())]
                lines = [x for x in lines if x]
                if lines and any(h in lines[0][0].lower() for h in COLUMN_HEADINGS):
                    out += [{"table_no": k, "column": x[0], "description": " ".join(x[1:])} for x in lines[1:] if x[0]]
            return out

        return pages_.map(lambda h: of(h) if h else [])

    return pages.select(F.col(id_col), F.inline(found(html_col)))


def class_balance(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(value, n, share) of the k commonest values, ties by value; the shares are of all rows, nulls included."""
    total = df.agg(F.count(F.lit(1)).alias("t"))
    n = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
    return n.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("t")).alias("share"))
