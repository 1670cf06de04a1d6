"""Transitive de-duplication of records by exact identifiers and by equal or nearly equal titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_arxiv, norm_doi, norm_title, title_tokens
from ..scratch import Scratch
from ..session import broadcast_if_small
from .components import connected_components


def similar_titles(records: DataFrame, id_col: str, title_col: str, t: float = 0.7, block: int = 2000) -> DataFrame:
    """(src, dst): links between normal titles whose token sets have a Jaccard similarity of at least t, each title named by its smallest id: titles of one token set are tied to the smallest of them, and
    token sets pairwise to similar ones. Exact: nothing is sampled or capped. Null ids, and titles without a token, have no links.

    With the tokens of a set of n in one order, rare first, similar sets share two of the first n - ceil(t n) + 2 of them, so those pairs of tokens are the join key; sets of one token are only
    similar to themselves. A key held by more than a block of sets is split into pairs of blocks. Length, place and a parity signature (it differs in no more
    bits than the sets do in tokens) bound the overlap where a key meets, so what is shuffled to be compared by its tokens is little more than the similar pairs.
    """
    scratch = Scratch(records.sparkSession, "titles")
    named = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), title_tokens(F.col(title_col)).alias("w")).filter(F.size("w") > 0)
    titles = scratch.cut(named.groupBy(F.array_join("w", " ").alias("title")).agg(F.min("id").alias("id")).withColumn("w", F.array_sort(F.array_distinct(F.split("title", " ")))))
    sets = scratch.cut(titles.groupBy("w").agg(F.min("id").alias("rep")))
    star = titles.join(sets, "w").filter("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    large = sets.filter(F.size("w") > 1)
    each = large.select("rep", F.explode("w").alias("tok"))
    df = each.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(broadcast_if_small(df), "tok").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("tok").alias("h"), "tok"))), lambda x: x["tok"]).alias("w"))
    n = F.size("w")
    prefix = F.slice("w", 1, F.greatest(F.lit(2), (n - F.ceil(n * t - 1e-9) + 2).cast("int")))
    head = ordered.select("rep", n.alias("n"), F.expr("aggregate(w, 0L, (a, x) -> a ^ shiftleft(1L, cast(pmod(xxhash64(x), 64) as int)))").alias("s"), prefix.alias("p"))
    first = head.select("rep", "n", "s", "p", F.posexplode("p").alias("i", "x"))
    keys = scratch.cut(first.select("rep", "n", "s", "i", "x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y")).select("rep", "n", "s", "i", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("key")))
    hot = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block)
    parts = keys.join(broadcast_if_small(hot), "key", "left").withColumn("g", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int")).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    a = parts.select("key", "rep", "n", "s", "i", "b", F.explode(F.sequence(F.col("b"), F.col("g") - 1)).alias("other"))
    b = parts.select("key", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("i").alias("i2"), F.col("b").alias("other"), F.explode(F.sequence(F.lit(0), "b")).alias("b"))
    least = t / (1 + t) * (F.col("n") + F.col("n2")) - 1e-9
    around = F.least("i", "i2") + F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))
    near = (F.least("n", "n2") >= t * F.greatest("n", "n2") - 1e-9) & (around >= least) & (F.bit_count(F.col("s").bitwiseXOR(F.col("s2"))) <= (1 - t) / (1 + t) * (F.col("n") + F.col("n2")) + 1e-9)
    met = a.join(b, ["key", "b", "other"]).filter((F.col("rep") != F.col("rep2")) & ((F.col("b") != F.col("other")) | (F.col("rep") < F.col("rep2"))) & near)
    pairs = met.select(F.least("rep", "rep2").alias("src"), F.greatest("rep", "rep2").alias("dst")).distinct()
    pairs = scratch.cut(pairs)
    scratch.drop(keys)
    both = pairs.join(sets.select(F.col("rep").alias("src"), F.col("w").alias("x")), "src").join(sets.select(F.col("rep").alias("dst"), F.col("w").alias("y")), "dst")
    common = F.size(F.array_intersect("x", "y"))
    return star.unionByName(both.filter(common >= t * (F.size("x") + F.size("y") - common) - 1e-9).select("src", "dst"))


def match_links(records: DataFrame, id_col: str, arxiv_col: str, doi_col: str, title_col: str, similar: float | None = 0.7) -> DataFrame:
    """(src, dst, reason): records with the same normal arXiv id, DOI or title, each tied to the smallest id of its key, so a key of k records gives k - 1 links; and with the reason `fuzzy` the
    links of similar_titles (similar None: without)."""
    r = records.select(F.col(id_col).alias("id"), norm_arxiv(F.col(arxiv_col)).alias("arxiv"), norm_doi(F.col(doi_col)).alias("doi"), F.nullif(norm_title(F.col(title_col)), F.lit("")).alias("title"))
    keyed = r.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("key")) for k in ("arxiv", "doi", "title")])).alias("x")).select("id", "x.reason", "x.key").filter("key IS NOT NULL AND id IS NOT NULL")
    first = keyed.groupBy("reason", "key").agg(F.min("id").alias("src"), F.countDistinct("id").alias("n")).filter("n > 1")
    exact = keyed.join(first, ["reason", "key"]).filter("id <> src").select("src", F.col("id").alias("dst"), "reason").distinct()
    return exact if similar is None else exact.unionByName(similar_titles(records, id_col, title_col, similar).withColumn("reason", F.lit("fuzzy")))


def deduplicate(records: DataFrame, id_col: str, arxiv_col: str, doi_col: str, title_col: str) -> DataFrame:
    """(uid, canonical): every record with the smallest id tied to it; records without a match are their own."""
    groups = connected_components(match_links(records, id_col, arxiv_col, doi_col, title_col))
    ids = records.select(F.col(id_col).alias("uid")).filter("uid IS NOT NULL").distinct()
    return ids.join(groups.withColumnRenamed("id", "uid"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("canonical"))
