"""Table profiles and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import unit
from ..operators import profile as P
from ..session import table


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = P.column_profile(table(spark, sf, "papers"), ["uid", "source", "year", "venue", "arxiv_id"])
    return out.select("column", "n", "n_missing", "n_numeric", F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("mean"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return P.class_balance(table(spark, sf, "documents").fillna("(null)", ["lang"]), "lang", 5).select("value", "n", F.round("share", 6).alias("share"))


def claim_units(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "claims").select(F.explode("units").alias("axis", "u")).filter("u IS NOT NULL").groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return u.withColumn("p", unit(F.col("u"))).select("u", "n", "p.dimension", "p.factor")


def _sql(c: str, numeric: bool) -> str:
    v = f"trim(CAST({c} AS VARCHAR))"
    miss = f"coalesce(lower({v}) IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-', '?'), true)"
    x = f"CASE WHEN NOT {miss} THEN TRY_CAST({v} AS DOUBLE) END"
    return f"SELECT '{c}' AS column, count(*) AS n, count(*) FILTER ({miss}) AS n_missing, count({x}) AS n_numeric, round(coalesce(avg({x}), 0.0), 4) AS mean, coalesce(min({x}), 0.0) AS low, coalesce(max({x}), 0.0) AS high FROM papers"


QUERIES = {f.__name__: f for f in (column_profile, class_balance, claim_units)}
ORACLE = {
    "column_profile": " UNION ALL ".join(_sql(c, True) for c in ("uid", "source", "year", "venue", "arxiv_id")),
    "class_balance": "SELECT coalesce(lang, '(null)') AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
}
