"""Scans of files: which places may be read, listing, readers, union by name with type drift, pruning of year-named files."""

from __future__ import annotations

import re
import time
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds for which a listing, or a file that was fetched, is taken as it was.
TTL = 600.0
AGENT = "veridex/1"


@dataclass(frozen=True)
class Places:
    """Folders (with all below them) and https hosts (with their subdomains) that statements may read."""

    roots: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()

    def check(self, path: str) -> str:
        """The path as Spark reads it; ValueError if it is in no allowed place."""
        if re.search(r"[\s\\\x00-\x1f]", path) or ".." in path or "/./" in path:
            raise ValueError("a path holds no spaces, backslashes or steps upwards")
        if path.lower().startswith("https://"):
            m = re.fullmatch(r"https://([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(/[^@#?%]*)?", path, re.IGNORECASE)  # no user, port, query, escapes or numbers in brackets
            if not m or not any(m[1].lower() == h or m[1].lower().endswith(f".{h}") for h in map(str.lower, self.hosts)):
                raise ValueError("the host is not one of those that may be read")
            return path
        plain = _plain(path)
        for root in self.roots:
            base = _plain(root).rstrip("/") + "/"
            n = len(base) if base.startswith("/") else len(re.match(r"\w+://[^/]*/", base)[0])  # a bucket's name has no case
            if plain[:n].lower() == base[:n].lower() and plain[n:].startswith(base[n:]) and (not base.startswith("/") or plain.startswith(base)):
                return plain
        raise ValueError("the path is not below a folder that may be read")


def _plain(path: str) -> str:
    path = re.sub(r"^s3://", "s3a://", path, flags=re.IGNORECASE)
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def anonymous_s3(spark: SparkSession, endpoint: str | None = None, region: str | None = None) -> None:
    """Public buckets without credentials, by paths rather than host names."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")
    conf.set("fs.s3a.path.style.access", "true")
    for key, value in (("fs.s3a.endpoint", endpoint), ("fs.s3a.endpoint.region", region)):
        if value:
            conf.set(key, value)


_LISTED: dict[tuple[str, str], tuple[float, list[str]]] = {}


def listed(spark: SparkSession, glob: str, ttl: float = TTL, clock=time.monotonic) -> list[str]:
    """Paths that a glob stands for, in order; remembered for `ttl` seconds."""
    key, now = (spark.sparkContext.applicationId, glob), clock()
    if key in _LISTED and now - _LISTED[key][0] < ttl:
        return _LISTED[key][1]
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    out = sorted(s.getPath().toString() for s in found or () if not s.getPath().getName().startswith(("_", ".")))
    _LISTED[key] = now, out
    return out


_FETCHED: dict[tuple[str, str], tuple[float, str]] = {}


def fetched(spark: SparkSession, url: str, ttl: float = TTL, open_url=urllib.request.urlopen, clock=time.monotonic) -> str:
    """A file of an https host, brought to the shared folder; Spark has no file system for https."""
    from veridex.sources.shared import work_dir

    key, now = (spark.sparkContext.applicationId, url), clock()
    if key in _FETCHED and now - _FETCHED[key][0] < ttl:
        return _FETCHED[key][1]
    where = f"{work_dir(spark, 'fetched')}/{url.rstrip('/').rsplit('/', 1)[-1]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        with open_url(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=30) as f:
            while chunk := f.read(1 << 20):
                out.write(bytearray(chunk))
    finally:
        out.close()
    _FETCHED[key] = now, where
    return where


def read(spark: SparkSession, kind: str, paths: list[str], options: dict[str, str]) -> DataFrame:
    """Files of one kind; options: union_by_name, filename, header, delim (sep)."""
    if unknown := set(options) - {"union_by_name", "filename", "header", "delim", "sep", "hive_partitioning", "auto_detect"}:
        raise ValueError(f"the reader has no option {sorted(unknown)[0]}")
    on = lambda name, default="false": options.get(name, default).lower() in ("true", "1")
    if kind == "parquet":
        return union_by_name(spark, paths, on("filename")) if on("union_by_name") and len(paths) > 1 else _named(spark.read.parquet(*paths), on("filename"))
    if kind == "csv":
        df = spark.read.csv(paths, header=on("header", "true"), inferSchema=True, sep=options.get("delim", options.get("sep", ",")))
        return _named(df, on("filename"))
    return _named(spark.read.json(paths), on("filename"))


def _named(df: DataFrame, wanted: bool) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("filename")) if wanted else df


_WIDTH = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both fit: the wider number, else text."""
    if a == b:
        return a
    if a in _WIDTH and b in _WIDTH:
        return max(a, b, key=_WIDTH.index)
    if {a, b} == {T.DateType(), T.TimestampNTZType()}:
        return T.TimestampNTZType()
    return T.StringType()


def union_by_name(spark: SparkSession, paths: list[str], filename: bool = False) -> DataFrame:
    """All files' rows; a column that a file lacks is null, one whose type drifts takes the wider type. filename: the file of each row, too.

    Files of one schema are one scan.
    """
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        groups.setdefault(tuple((f.name, f.dataType) for f in spark.read.parquet(p).schema), []).append(p)
    types: dict[str, T.DataType] = {}
    for schema in groups:
        for name, kind in schema:
            types[name] = wider(types[name], kind) if name in types else kind
    out = None
    for schema, files in groups.items():
        have = {n for n, _ in schema}
        name = [F.col("_metadata.file_path").alias("filename")] if filename else []
        df = spark.read.parquet(*files).select(*((F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in types.items()), *name)
        out = df if out is None else out.unionAll(df)
    return out


def only_years(df: DataFrame, years: set[int] | None) -> DataFrame:
    """Rows of files whose name holds one of the years (files without a year stay); the listing itself is pruned."""
    if years is None:
        return df
    name = F.col("_metadata.file_name")
    found = F.regexp_extract(name, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return df.where((found == "") | found.isin(*map(str, sorted(years))))


def year_of(path: str) -> int | None:
    m = re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", path.rsplit("/", 1)[-1])
    return int(m[-1]) if m else None


def prune_paths(paths: list[str], years: set[int] | None) -> list[str]:
    """The files of those years; all of them where a year has no file, a file no year, or nothing is proven."""
    if years is None or any(year_of(p) is None for p in paths):
        return paths
    kept = [p for p in paths if year_of(p) in years]
    return kept if {year_of(p) for p in kept} == years else paths
