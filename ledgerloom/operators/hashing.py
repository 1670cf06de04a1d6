"""Feature hashing with running document frequencies: vectors without a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize


def adaptive_bits(n: int, target_load: int = 8) -> int:
    """Bits of a hash key at which a bucket holds about target_load of n rows; at least 6."""
    from math import log2

    return max(6, round(log2(max(1.0, n / target_load))))


class HashingTfidf:
    """Signed hashed term weights: a token falls in one of `dim` buckets with a sign, both from its md5; term counts are damped to 1 + ln, weighted by idf, and rows have length 1.

    observe() adds the document frequencies of new texts to those held (one row per bucket: at most dim rows), freeze() pins the idf, state() and from_state() keep it as a table. Null texts have no
    tokens; a text without tokens, or whose signs cancel, has no row.
    """

    def __init__(self, spark: SparkSession, dim: int = 4096):
        self.spark, self.dim = spark, dim
        self.n = 0
        self.df = spark.createDataFrame([], "bucket int, df bigint")
        self.frozen: DataFrame | None = None

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(self.dim)).cast("int")

    @staticmethod
    def sign(token: Column) -> Column:
        return F.when(F.conv(F.substring(F.md5(token), 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)

    def _tokens(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return texts.select(F.col(id_col).alias("id"), F.explode(tokenize(F.col(text_col))).alias("t")).select("id", self.bucket(F.col("t")).alias("bucket"), self.sign(F.col("t")).alias("sign"))

    def observe(self, texts: DataFrame, id_col: str, text_col: str) -> None:
        new = self._tokens(texts, id_col, text_col).distinct().select("id", "bucket").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
        held = self.df.unionByName(new).groupBy("bucket").agg(F.sum("df").alias("df"))
        # at most dim rows, so they are kept here and lineage ends
        self.df = self.spark.createDataFrame(held.collect(), "bucket int, df bigint")
        self.n += texts.filter(F.col(id_col).isNotNull()).count()

    def idf(self) -> DataFrame:
        """(bucket, idf): ln((1 + n)/(1 + df)) + 1."""
        return self.frozen if self.frozen is not None else self.df.select("bucket", (F.log((1.0 + self.n) / (1.0 + F.col("df"))) + 1).alias("idf"))

    def freeze(self) -> None:
        self.frozen = self.idf()

    def transform(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, bucket, weight); buckets that were never observed count as of frequency 0."""
        from math import log

        tf = self._tokens(texts, id_col, text_col).groupBy("id", "bucket").agg(F.sum("sign").alias("s")).filter("s <> 0")
        damped = F.signum(F.col("s").cast("double")) * (1 + F.log(F.abs("s").cast("double")))
        w = tf.join(F.broadcast(self.idf()), "bucket", "left").select("id", "bucket", (damped * F.coalesce("idf", F.lit(log(1.0 + self.n) + 1))).alias("w"))
        norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, "id").select("id", "bucket", (F.col("w") / F.col("norm")).alias("weight"))

    def state(self) -> DataFrame:
        """(bucket, df, n, dim): all there is to keep; n and dim are in every row, and a row without bucket holds them where nothing was observed."""
        return self.df.unionByName(self.spark.createDataFrame([(None, 0)], "bucket int, df bigint")).select("bucket", "df", F.lit(self.n).cast("bigint").alias("n"), F.lit(self.dim).alias("dim"))

    @classmethod
    def from_state(cls, state: DataFrame) -> HashingTfidf:
        rows = state.collect()  # at most dim + 1 rows
        out = cls(state.sparkSession, rows[0].dim)
        out.n = rows[0].n
        out.df = out.spark.createDataFrame([(r.bucket, r.df) for r in rows if r.bucket is not None], "bucket int, df bigint")
        return out
