"""Nearest vectors: exact search in blocks of queries, and a signed-projection index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .hashing import adaptive_bits

#: Query vectors that one task holds at a time.
QUERY_BLOCK = 4096


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def exact_nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, place): the k nearest by cosine of every query among all vectors, itself excluded, ties by id.

    Queries are taken in blocks of at most `block` by a hash of their id; each block goes to the tasks, every partition of the vectors keeps its own k best per query, and these meet.
    Vectors that are null, of another length, not finite or zero have no neighbours.
    """
    spark = vectors.sparkSession
    n = queries.count()
    parts = max(1, -(-2 * n // block))
    schema = "query_id bigint, id bigint, score double"
    scratch = Scratch(spark, "nearest")
    out = None
    for part in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part).select(id_col, vec_col).toPandas()
        rows = rows[rows[vec_col].notna()]
        if not len(rows):
            continue
        width = len(rows[vec_col].iloc[0])
        rows = rows[rows[vec_col].map(len) == width]
        q = np.array(rows[vec_col].tolist(), np.float64)
        norm = np.linalg.norm(q, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        held = spark.sparkContext.broadcast((rows[id_col].to_numpy()[ok], q[ok] / norm[ok, None]))

        def search(batches: Iterator[pd.DataFrame], held=held, width=width) -> Iterator[pd.DataFrame]:
            qid, qv = held.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(qid)
            for batch in batches:
                batch = batch[batch[vec_col].notna()]
                batch = batch[batch[vec_col].map(len) == width]
                if not len(batch):
                    continue
                v = np.array(batch[vec_col].tolist(), np.float64)
                size = np.linalg.norm(v, axis=1)
                good = np.isfinite(size) & (size > 0)
                ids, v = batch[id_col].to_numpy()[good], v[good] / size[good, None]
                score = qv @ v.T
                score[qid[:, None] == ids[None]] = -np.inf
                top = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, : 2 * k] if score.shape[1] > 2 * k else np.tile(np.arange(score.shape[1]), (len(qid), 1))
                for i in range(len(qid)):
                    edge = np.sort(score[i, top[i]])[::-1][min(k, len(top[i])) - 1]
                    pick = np.flatnonzero((score[i] >= edge) & (score[i] > -np.inf))
                    best[i] = _best(np.append(best[i][0], ids[pick]), np.append(best[i][1], score[i, pick]), k)
            for i in range(len(qid)):
                if len(best[i][0]):
                    yield pd.DataFrame({"query_id": qid[i], "id": best[i][0], "score": best[i][1]})

        found = vectors.select(id_col, vec_col).mapInPandas(search, schema)
        if parts > 1:  # one block at a time is on the driver and in the tasks
            found = scratch.cut(found)
            held.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema + ", place int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def hyperplane_keys(vectors: DataFrame, id_col: str, vec_col: str, width: int, bits: int, tables: int, seed: int = 0) -> DataFrame:
    """(id, t, key, vec): the side of `bits` random hyperplanes on which a vector lies, for each of `tables` draws."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, width))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch[vec_col].notna()]
            batch = batch[batch[vec_col].map(len) == width]
            if len(batch):
                side = np.einsum("tbw,nw->ntb", planes, np.array(batch[vec_col].tolist(), np.float64)) > 0
                keys = (side * (1 << np.arange(bits))).sum(2)
                yield pd.DataFrame({"id": batch[id_col].to_numpy(), "keys": list(keys), "vec": batch[vec_col].to_numpy()})

    wide = vectors.select(id_col, vec_col).mapInPandas(run, "id bigint, keys array<bigint>, vec array<float>")
    return wide.select("id", "vec", F.posexplode("keys").alias("t", "key"))


def index_nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, width: int, k: int, bits: int | None = None, tables: int = 24, seed: int = 0) -> DataFrame:
    """(query_id, id, score, place): as exact_nearest, among the vectors that share a bucket with the query in some table or differ from it in one bit there. Every vector is indexed; buckets have no cap.

    bits None: so many that a bucket holds about 64 vectors at any size of the table, so the work grows with the queries, not with the square of the table. Only ids meet in the buckets; the vectors are fetched once per pair.
    """
    bits = adaptive_bits(vectors.count(), 64) if bits is None else bits
    keyed = hyperplane_keys(vectors, id_col, vec_col, width, bits, tables, seed).drop("vec")
    asked = keyed.join(queries.select(F.col(id_col).alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "t", F.explode(F.concat(F.array("key"), F.array(*[F.col("key").bitwiseXOR(F.lit(1 << b).cast("bigint")) for b in range(bits)]))).alias("key"))
    pairs = asked.join(keyed, ["t", "key"]).filter("query_id <> id").select("query_id", "id").distinct()
    own = vectors.filter(F.size(vec_col) == width).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    met = pairs.join(own, "id").join(own.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.try_divide(dot(F.col("q"), F.col("vec")), F.sqrt(dot(F.col("q"), F.col("q")) * dot(F.col("vec"), F.col("vec"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.select("query_id", "id", score.alias("score")).filter("score IS NOT NULL AND NOT isnan(score)").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, n_found, recall): of the exact neighbours (query_id, id) how many an index found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_found")).withColumn("recall", F.try_divide(F.col("n_found").cast("double"), F.col("n").cast("double")))
