"""Readers of line-numbered ledgers, record files, feeds and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with `file`, `line` (from 1, in file order) and `bad` (the raw text of a line that is no JSON object, else null). Blank lines count but give no row.

    Line numbers come from the file offsets of whole files: each file is one row of lines, so ledgers should be files of at most some hundred MB, as they are appended in parts.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "raw"))
    lines = whole.filter(F.trim("raw") != "").select("file", (F.col("i") + 1).cast("bigint").alias("line"), "raw")
    parsed = lines.withColumn("r", F.from_json("raw", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.trim("raw").startswith("{") & F.col("r").isNotNull() & F.try_parse_json("raw").isNotNull())
    return parsed.select("file", "line", F.when(~F.col("ok"), F.col("raw")).alias("bad"), *[F.when(F.col("ok"), F.col(f"r.{c}")).alias(c) for c in spark.createDataFrame([], schema).columns])


#: The names under which raw records carry a field.
ALIASES = {
    "id": ["id", "paper_id", "uid", "arxiv_id"], "title": ["title", "name"], "abstract": ["abstract", "summary", "description"], "year": ["year", "published", "date"],
    "authors": ["authors", "author"], "references": ["references", "reference_ids", "refs", "citations_out"], "categories": ["categories", "fields_of_study", "tags"], "citation_count": ["citation_count", "citations", "n_citations"],
}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records under any of the ALIASES in one schema: id, title, abstract, year int, authors, references, categories arrays, citation_count; the first line of an id wins, rows without one get none. Torn lines are dropped."""
    raw = spark.read.option("mode", "PERMISSIVE").text(path).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")).filter("v IS NOT NULL")
    text = lambda f: F.coalesce(*[F.try_variant_get("v", f"$.{a}", "string") for a in ALIASES[f]])
    many = lambda f: F.coalesce(*[F.try_variant_get("v", f"$.{a}", "array<string>") for a in ALIASES[f]], F.transform(F.split(text(f), r"\s*[;,]\s*"), lambda x: x))
    year = F.try_to_number(F.regexp_extract(text("year"), r"((?:1[5-9]|20)[0-9]{2}|2100)", 1), F.lit("9999")).cast("int")
    rows = raw.select("f", "n", F.nullif(F.trim(text("id")), F.lit("")).alias("id"), text("title").alias("title"), text("abstract").alias("abstract"), year.alias("year"), many("authors").alias("authors"), many("references").alias("references"), many("categories").alias("categories"), F.try_variant_get(F.col("v"), "$.citation_count", "bigint").alias("citation_count"))
    keep = F.struct("f", "n")
    first = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("title", "abstract", "year", "authors", "references", "categories", "citation_count"), keep).alias("r"))
    return first.select("id", "r.*")


def read_atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds: id, title, summary, published, authors; entries without an id are skipped."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    ws = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return rows.filter("id IS NOT NULL").select(F.trim("id").alias("id"), ws(F.col("title")).alias("title"), ws(F.col("summary")).alias("summary"), F.try_to_timestamp("published").alias("published"), F.transform("author", lambda a: a["name"]).alias("authors"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON document {nodes: [{id, type, status, date, ...}], edges: [{src, dst, type}]}; other attributes are left out."""
    doc = spark.read.option("multiLine", True).schema("nodes array<struct<id:string,type:string,title:string,status:string,date:string,depends_on:array<string>,cost:double>>, edges array<struct<src:string,dst:string,type:string>>").json(path)
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def file_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, ext, size, modified, text): every file below a folder; files whose bytes are not UTF-8 have null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))


def file_census(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def unseen(batch: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The batch's first row of each key that is not held yet."""
    return batch.dropDuplicates([key]).join(held.select(key).distinct(), key, "left_anti")


def append_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Appends parquet under partition folders; one shuffle, so that a partition gets few files."""
    df.repartition(*by).write.mode("append").partitionBy(*by).parquet(path)
