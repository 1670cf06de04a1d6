"""Readers and profiles of other file formats, SQLite and paged services as data sources, and graphs as folders or GraphML."""

from __future__ import annotations

import csv
import io
import random
import re
import sqlite3
import struct
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# ---- whole files, one row each ----


def image_header(b: bytes) -> dict | None:
    """{format, width, height} of a PNG or JPEG by its header; None for anything else or a broken header."""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24 and b[12:16] == b"IHDR":
        w, h = struct.unpack(">II", b[16:24])
        return {"format": "png", "width": w, "height": h}
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b) and b[at] == 0xFF:
            marker, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return {"format": "jpeg", "width": w, "height": h}
            at += 2 + size
    return None


def mesh_summary(b: bytes) -> dict | None:
    """{format, vertices, faces, low, high, watertight} of an ASCII PLY or a binary or ASCII STL; watertight: every edge is in two faces."""
    points: list[tuple[float, ...]] = []
    faces: list[list[int]] = []
    if b[:3] == b"ply":
        head, _, body = b.partition(b"end_header\n")
        text = head.decode("ascii", "replace")
        n, m = (int(x[1]) if (x := re.search(rf"element {k} (\d+)", text)) else 0 for k in ("vertex", "face"))
        if "format ascii" not in text:
            return {"format": "ply", "vertices": n, "faces": m, "low": None, "high": None, "watertight": None}
        lines = body.decode("ascii", "replace").split("\n")
        points = [tuple(map(float, x.split()[:3])) for x in lines[:n]]
        faces = [[int(i) for i in x.split()[1:]] for x in lines[n : n + m]]
        kind = "ply"
    elif len(b) >= 84 and len(b) == 84 + 50 * struct.unpack("<I", b[80:84])[0]:
        kind, at = "stl", {}
        for k in range(struct.unpack("<I", b[80:84])[0]):
            v = struct.unpack("<9f", b[84 + 50 * k + 12 : 84 + 50 * k + 48])
            faces.append([at.setdefault(v[i : i + 3], len(at)) for i in (0, 3, 6)])
        points = list(at)
    elif b[:5] == b"solid":
        kind, at, own = "stl", {}, []
        for x in re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", b):
            own.append(at.setdefault(tuple(map(float, x)), len(at)))
        faces, points = [own[i : i + 3] for i in range(0, len(own) - 2, 3)], list(at)
    else:
        return None
    edges: dict[tuple[int, int], int] = {}
    for f in faces:
        for i, j in zip(f, f[1:] + f[:1], strict=True):
            e = (min(i, j), max(i, j))
            edges[e] = edges.get(e, 0) + 1
    low, high = ([f(p[k] for p in points) for k in range(3)] if points else None for f in (min, max))
    return {"format": kind, "vertices": len(points), "faces": len(faces), "low": low, "high": high, "watertight": bool(faces) and all(n == 2 for n in edges.values())}


def las_summary(b: bytes) -> list[dict] | None:
    """[{curve, unit, n, n_null, low, high, mean}] of a well log (LAS 2.0, unwrapped); None for anything else."""
    text = b.decode("latin-1")
    if "~V" not in text.upper()[:2000]:
        return None
    section, curves, rows, null = "", [], [], None
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if s.startswith("~"):
            section = s[1:2].upper()
        elif section == "A":
            rows.append(s.split())
        else:
            m = re.match(r"([^.]+)\.(\S*)\s+([^:]*):", s)
            if m and section == "C":
                curves.append((m[1].strip(), m[2]))
            elif m and section == "W" and m[1].strip().upper() == "NULL":
                null = float(m[3])
    out = []
    for i, (name, unit) in enumerate(curves):
        values = [float(r[i]) for r in rows if i < len(r)]
        good = [v for v in values if v != null]
        out.append({"curve": name, "unit": unit, "n": len(values), "n_null": len(values) - len(good), "low": min(good, default=None), "high": max(good, default=None), "mean": sum(good) / len(good) if good else None})
    return out


def tfrecord_summary(b: bytes) -> dict | None:
    """{records, bytes, whole} of length-framed records; whole: the last frame is complete. None if the first frame does not fit."""
    at = n = size = 0
    while at + 12 <= len(b):
        (length,) = struct.unpack("<Q", b[at : at + 8])
        if at + 16 + length > len(b):
            return {"records": n, "bytes": size, "whole": False} if n else None
        n, size, at = n + 1, size + length, at + 16 + length
    return {"records": n, "bytes": size, "whole": at == len(b)} if n else None


def csv_summary(b: bytes, nulls: tuple[str, ...] = ("", "na", "nan", "null", "none")) -> list[dict] | None:
    """[{column, n, n_null, n_numeric, low, high, mean, n_distinct}] of a delimited text with a header line; the delimiter is told from the first lines. None without one."""
    text = b.decode("utf-8", "replace")
    try:
        dialect = csv.Sniffer().sniff("\n".join(text.splitlines()[:20]), ",;\t|")
    except csv.Error:
        return None
    rows = csv.reader(io.StringIO(text), dialect)
    names = next(rows, [])
    held: list[list[str]] = [[] for _ in names]
    for r in rows:
        for k, v in enumerate(r[: len(names)]):
            held[k].append(v.strip())
    out = []
    for name, values in zip(names, held, strict=True):
        there = [v for v in values if v.lower() not in nulls]
        numbers = [float(v) for v in there if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v)]
        out.append({"column": name, "n": len(values), "n_null": len(values) - len(there), "n_numeric": len(numbers), "low": min(numbers, default=None), "high": max(numbers, default=None), "mean": sum(numbers) / len(numbers) if numbers else None, "n_distinct": len(set(there))})
    return out


#: Summary by kind of file: the function and its schema.
SUMMARIES: dict[str, tuple[Callable, str]] = {
    "image": (image_header, "struct<format:string,width:bigint,height:bigint>"),
    "mesh": (mesh_summary, "struct<format:string,vertices:bigint,faces:bigint,low:array<double>,high:array<double>,watertight:boolean>"),
    "las": (las_summary, "array<struct<curve:string,unit:string,n:bigint,n_null:bigint,low:double,high:double,mean:double>>"),
    "tfrecord": (tfrecord_summary, "struct<records:bigint,bytes:bigint,whole:boolean>"),
    "csv": (csv_summary, "array<struct<column:string,n:bigint,n_null:bigint,n_numeric:bigint,low:double,high:double,mean:double,n_distinct:bigint>>"),
}


def summarize(spark: SparkSession, path: str, kind: str, glob: str = "*") -> DataFrame:
    """(path, size, summary) of every file below a folder, read in the tasks; summary is null for files of another kind or broken ones; empty files give no row. A file is one row, so files should be of at most some hundred MB."""
    of, schema = SUMMARIES[kind]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("size"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def safe(b: bytes):
            try:
                return of(bytes(b))
            except (ValueError, IndexError, struct.error, OverflowError):
                return None

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "size": batch["size"], "summary": [safe(b) for b in batch["content"]]})

    return files.mapInPandas(run, f"path string, size bigint, summary {schema}")


def profile_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(column, n, n_null, n_numeric, low, high, mean) of delimited files of any size: Spark splits them, and each column is summed in one grouped pass."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`")).alias("v")) for c in rows.columns])).alias("x")).select("x.*")
    null = F.col("v").isNull() | F.lower("v").isin("", "na", "nan", "null", "none")
    x = F.when(~null, F.expr("try_cast(v AS double)"))
    return each.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(null).alias("n_null"), F.count(x).alias("n_numeric"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"))


# ---- SQLite ----


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table, self.parts, self.columns = options["path"], options["table"], int(options.get("partitions", "8")), columns

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as c:
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """A table of a SQLite file that all executors see, read-only, by ranges of its row numbers. Options: path, table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        kinds = {"INT": "bigint", "REA": "double", "FLO": "double", "DOU": "double", "BLO": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            columns = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{r[1]}` {kinds.get(r[2][:3].upper(), 'string')}" for r in columns)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema.fieldNames())


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions).load()


# ---- paged services ----


class RateLimiter:
    """Waits so that calls are at least `seconds` apart."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            self.sleep(self.seconds - (now - self.last))
            now = self.last + self.seconds
        self.last = now


#: Answers worth another try.
RETRY = (408, 425, 429, 500, 502, 503, 504)


def fetch(get: Callable[[str], tuple[int, dict, str]], url: str, tries: int = 5, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> str | None:
    """The body of a URL by get(url) -> (status, headers, body); statuses of RETRY and dropped connections are tried again after doubling waits with jitter, or as Retry-After says. None when it does not come."""
    rng = rng or random.Random(0)
    for k in range(tries):
        try:
            status, headers, body = get(url)
        except OSError:
            status, headers, body = 503, {}, ""
        if status == 200:
            return body
        if status not in RETRY or k == tries - 1:
            return None
        sleep(float(headers["Retry-After"]) if str(headers.get("Retry-After", "")).isdigit() else first_wait * 2**k * (1 + 0.25 * rng.random()))
    return None


def topic_query(topic: str, hits: int | None, least: int = 15) -> str:
    """The topic as a phrase, or as all of its words where the phrase has too few hits."""
    words = topic.split()
    return f'"{topic}"' if hits is None or hits >= least or len(words) < 2 else " AND ".join(words)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.pages, self.seconds = options["url"], int(options["pages"]), float(options.get("seconds", "0"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        def get(url: str) -> tuple[int, dict, str]:
            try:
                with urlopen(url, timeout=30) as r:
                    return 200, dict(r.headers), r.read().decode("utf-8", "replace")
            except HTTPError as e:
                return e.code, dict(e.headers), ""

        RateLimiter(self.seconds).wait()
        url = self.url.replace("{page}", str(partition.value))
        yield partition.value, url, fetch(get, url, tries=3, first_wait=0.1)


class PagedSource(DataSource):
    """Pages of a service as rows (page, url, body), one partition per page; body is null where a page does not come. Options: url with {page}, pages, seconds between calls of a task."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


def read_pages(spark: SparkSession, url: str, pages: int, seconds: float = 0.0) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").option("url", url).option("pages", pages).option("seconds", seconds).load()


# ---- graphs ----


def save_bundle(path: str, **tables: DataFrame) -> None:
    """Nodes, edges, terms and whatever else belongs together, each as a table in one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML in parts: element lines of nodes (id, attributes) and edges (src, dst, attributes); lists as text with semicolons. The parts are the body of one document, whose frame is the first and the last part."""
    def escaped(c: F.Column) -> F.Column:
        return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def data(df: DataFrame, names: list[str]) -> F.Column:
        kinds = dict(df.dtypes)
        text = [F.concat_ws(";", F.col(n).cast("array<string>")) if kinds[n].startswith("array") else F.col(n).cast("string") for n in names]
        return F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f'<data key="{n}">'), escaped(t), F.lit("</data>")), F.lit("")) for n, t in zip(names, text, strict=True)])

    n_rows = nodes.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), escaped(F.col("id").cast("string")), F.lit('">'), data(nodes, [c for c in nodes.columns if c != "id"]), F.lit("</node>")).alias("value"))
    e_rows = edges.select(F.lit(2).alias("o"), F.concat(F.lit('<edge source="'), escaped(F.col("src").cast("string")), F.lit('" target="'), escaped(F.col("dst").cast("string")), F.lit('">'), data(edges, [c for c in edges.columns if c not in ("src", "dst")]), F.lit("</edge>")).alias("value"))
    frame = nodes.sparkSession.createDataFrame([(0, '<graphml><graph edgedefault="directed">'), (3, "</graph></graphml>")], "o int, value string")
    frame.unionByName(n_rows).unionByName(e_rows).repartitionByRange(4, "o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, attributes map), edges (src, dst, attributes map)) of GraphML."""
    pairs = "array<struct<_key:string,_VALUE:string>>"
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    held = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast(pairs)), lambda d: F.struct(d["_key"].alias("key"), d["_VALUE"].alias("value")))).alias("attributes")
    return xml("node", f"_id string, data {pairs}").filter("_id IS NOT NULL").select(F.col("_id").alias("id"), held), xml("edge", f"_source string, _target string, data {pairs}").filter("_source IS NOT NULL").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), held)
