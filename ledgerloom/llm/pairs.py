"""Items that appear together: an incremental pair table (p1)."""

from __future__ import annotations

import json
import uuid
from copy import deepcopy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, delete, keep_until_exit, shared_root


def clean_items(*arrays: Column) -> Column:
    """The distinct items of the arrays: lower case, trimmed, inner blanks collapsed; null and blank ones dropped. Null arrays count as empty."""
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(a, none) for a in arrays])
    tidy = F.transform(F.array_compact(every), lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(tidy, lambda x: x != "")))


class PairTable:
    """Persistent counts of baskets, items and item pairs in a folder, kept up to date by changed baskets.

    baskets: current items of every basket; items: baskets per item; pairs: baskets per pair (item_a < item_b). Each is split into `buckets` parts by the hash that a shuffle on its key uses, so
    with as many shuffle partitions (the default) the task that sums a bucket also writes it. apply() takes the new state of changed baskets, emits signed deltas of pairs and marginals,
    sums them (map-side first), and rewrites only the buckets with a delta, as a new version. Manifests are numbered; the highest complete one says which version of a bucket holds, so a failed
    apply leaves the state before it and nothing is counted twice; a basket delivered again unchanged has no delta. Versions that neither of the last two
    manifests names are deleted.
    """

    KINDS = {"baskets": ("basket string, items array<string>, bucket int", ["basket"]), "items": ("item string, n bigint, bucket int", ["item"]), "pairs": ("item_a string, item_b string, n_ab bigint, bucket int", ["item_a", "item_b"])}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.manifest: dict = {"version": 0, "baskets_total": 0, "changed": None, **{k: {} for k in self.KINDS}}
        self._former: dict = self.manifest
        self._load()

    # a manifest is one small file of at most 3 x buckets entries

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self) -> None:
        path, fs = self._fs()
        where = path(f"{self.path}/manifests")
        if not fs.exists(where):
            return
        # a file gets its final name only once it is complete
        names = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(where)) if n.endswith(".json"))
        for name in names[-2:]:
            self._former, self.manifest = self.manifest, json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{name}").collect()))
        self.buckets = self.manifest.get("buckets", self.buckets)

    def _save(self, manifest: dict) -> None:
        path, fs = self._fs()
        name = f"{self.path}/manifests/{manifest['version']:012d}"
        out = fs.create(path(f"{name}.tmp"), True)
        out.write(bytearray(json.dumps({**manifest, "buckets": self.buckets}).encode()))
        out.close()
        if not fs.rename(path(f"{name}.tmp"), path(f"{name}.json")):
            raise RuntimeError(f"another writer has made version {manifest['version']} of {self.path}")
        named = {v for m in (manifest, self.manifest) for k in self.KINDS for v in m[k].values()} | {m["changed"] for m in (manifest, self.manifest)}
        for kind in (*self.KINDS, "changed"):
            where = path(f"{self.path}/{kind}")
            for f in fs.listStatus(where) if fs.exists(where) else []:
                if f.getPath().getName() not in named:
                    fs.delete(f.getPath(), True)
        self._former, self.manifest = self.manifest, manifest

    def _read(self, kind: str, only: list[int] | None = None) -> DataFrame:
        """The current rows, or those of some buckets: each version is read for the buckets in which it holds."""
        schema = self.KINDS[kind][0]
        by_version: dict[str, list[int]] = {}
        for bucket, version in self.manifest[kind].items():
            if only is None or int(bucket) in only:
                by_version.setdefault(version, []).append(int(bucket))
        out = self.spark.createDataFrame([], schema)
        for version, buckets in sorted(by_version.items()):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{version}")
            out = out.unionByName(part if len(buckets) == self.buckets else part.filter(F.col("bucket").isin(buckets)))
        return out

    def _write(self, kind: str, rows: DataFrame, touched: list[int], version: str, into: dict) -> None:
        rows.withColumn("bucket", self._bucket(kind)).write.partitionBy("bucket").parquet(f"{self.path}/{kind}/{version}")
        into[kind].update({str(b): version for b in touched})

    def _bucket(self, kind: str) -> Column:
        return F.pmod(F.hash(*self.KINDS[kind][1]), F.lit(self.buckets))

    @staticmethod
    def _pairs(baskets: DataFrame, block: int = 64) -> DataFrame:
        """(item_a, item_b, w): all pairs of each basket's sorted items. Baskets of more than a block of items are cut into blocks, and each two blocks go as one row to a task of their own
        before any pair is made, so an oversized basket is work for all."""
        small = baskets.filter(F.size("items") <= block).select(F.col("items").alias("left"), F.col("items").alias("right"), F.lit(True).alias("same"), "w")
        large = baskets.filter(F.size("items") > block).select("items", "w", F.ceil(F.size("items") / block).cast("int").alias("blocks"))
        one = large.select("items", "w", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
        two = one.select("w", F.slice("items", F.col("i") * block + 1, F.lit(block)).alias("left"), "i", "items", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
        met = two.select("left", F.slice("items", F.col("j") * block + 1, F.lit(block)).alias("right"), (F.col("i") == F.col("j")).alias("same"), "w").repartition(F.xxhash64(F.col("left")[0], F.col("right")[0]))
        rows = small.unionByName(met)
        each = rows.select(F.posexplode("left").alias("at", "item_a"), "right", "same", "w")
        later = F.when(F.col("same"), F.slice("right", F.col("at") + 2, F.lit(block))).otherwise(F.col("right"))
        return each.select("item_a", F.explode(later).alias("item_b"), "w")

    def apply(self, changes: DataFrame) -> None:
        """changes: (basket, items) with the new items of changed baskets, each basket once; items null: the basket is gone, empty: it stays without items.

        Null baskets are ignored. items must be sorted and distinct, as clean_items gives them.
        """
        # a folder name of its own for each try: what a failed one left behind is never read
        version = f"v{self.manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
        work = Scratch(self.spark, "pair-changes")
        following = deepcopy(self.manifest)
        new = work.cut(changes.filter(F.col("basket").isNotNull()).select("basket", "items").repartition(self.buckets, "basket"))
        first = not self.manifest["baskets"]
        every = list(range(self.buckets))
        if first:
            if new.isEmpty():
                return
            moved = new.select("basket", F.lit(None).cast("array<string>").alias("was"), F.col("items").alias("now"))
            self._write("baskets", new.filter(F.col("items").isNotNull()), every, version, following)
        else:
            touched = [r[0] for r in new.select(self._bucket("baskets").alias("b")).distinct().collect()]
            if not touched:
                return
            was = self._read("baskets", touched).select("basket", F.col("items").alias("was"))
            both = work.cut(was.join(new.select("basket", F.col("items").alias("now"), F.lit(True).alias("changed")), "basket", "full_outer"))
            self._write("baskets", both.select("basket", F.when(F.col("changed"), F.col("now")).otherwise(F.col("was")).alias("items")).filter(F.col("items").isNotNull()), touched, version, following)
            moved = both.filter(F.col("changed") & ~F.col("was").eqNullSafe(F.col("now")))
        signed = moved.select(F.col("now").alias("items"), F.lit(1).alias("w")) if first else moved.select(F.explode(F.array(F.struct(F.col("now").alias("items"), F.lit(1).alias("w")), F.struct(F.col("was").alias("items"), F.lit(-1).alias("w")))).alias("s")).select("s.*")
        signed = signed.filter(F.size("items") > 0)
        grown = moved.agg(F.coalesce(F.sum(F.col("now").isNotNull().cast("int") - F.col("was").isNotNull().cast("int")), F.lit(0))).first()[0]
        marginals = signed.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("d")).filter("d <> 0")
        changed = f"{self.path}/changed/{version}"
        marginals.write.parquet(changed)
        following["changed"] = version
        self._merge("items", self.spark.read.schema("item string, d bigint").parquet(changed), version, first, following)
        pairs = self._pairs(signed).groupBy("item_a", "item_b").agg(F.sum("w").alias("d")).filter("d <> 0")
        self._merge("pairs", pairs if first else work.cut(pairs), version, first, following)
        following["baskets_total"] += int(grown)
        following["version"] += 1
        self._save(following)
        delete(self.spark, work.base)

    def _merge(self, kind: str, delta: DataFrame, version: str, first: bool, into: dict) -> None:
        """Adds the deltas to the buckets that have one; a first load has nothing to add to and is written as it is summed."""
        key, count = self.KINDS[kind][1], "n_ab" if kind == "pairs" else "n"
        rows = delta.select(*key, F.col("d").alias(count))
        if first:
            self._write(kind, rows, list(range(self.buckets)), version, into)
            return
        touched = [r[0] for r in rows.select(self._bucket(kind).alias("b")).distinct().collect()]
        if not touched:
            return
        rows = self._read(kind, touched).select(*key, count).unionByName(rows).groupBy(*key).agg(F.sum(count).alias(count)).filter(F.col(count) > 0)
        self._write(kind, rows, touched, version, into)

    @property
    def changed_items(self) -> DataFrame | None:
        """The items whose count the last apply moved; kept with the table, so it holds after a reopening too."""
        version = self.manifest["changed"]
        return self.spark.read.schema("item string, d bigint").parquet(f"{self.path}/changed/{version}").select("item") if version else None

    @property
    def n_baskets(self) -> int:
        return self.manifest["baskets_total"]

    def items(self) -> DataFrame:
        return self._read("items").drop("bucket")

    def pairs(self) -> DataFrame:
        return self._read("pairs").drop("bucket")

    def scores(self, min_count: int = 1, affected_only: bool = False, small_items: int = 200_000) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, pmi) of the pairs with n_ab >= min_count.

        affected_only: those with an item whose count the last apply moved, which are all whose own counts moved. The items go to every task only up to `small_items` of them; beyond, the join
        shuffles, and no item has more pairs than there are items.
        """
        items = self.items()
        pairs = self.pairs().filter(F.col("n_ab") >= min_count)
        if affected_only:
            mine = self.changed_items
            if mine is None:
                mine = self.spark.createDataFrame([], "item string")
            either = pairs.join(mine.withColumnRenamed("item", "item_a"), "item_a", "left_semi").union(pairs.join(mine.withColumnRenamed("item", "item_b"), "item_b", "left_semi").select("item_a", "item_b", "n_ab"))
            pairs = either.distinct()
        if items.limit(small_items + 1).count() <= small_items:
            items = F.broadcast(items)
        n = F.lit(self.n_baskets).cast("double")
        out = pairs.join(items.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(items.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        lift = F.col("n_ab") * n / (F.col("n_a").cast("double") * F.col("n_b"))
        return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(self.n_baskets).cast("bigint").alias("n_baskets"), lift.alias("lift"), F.log(lift).alias("pmi"))


def new_folder(spark: SparkSession) -> str:
    """A folder for a pair table that is only kept until the driver exits."""
    return keep_until_exit(spark, f"{shared_root(spark)}/pair-table-{uuid.uuid4().hex}")
