"""Operator 5: WARC files and a Merkle fixity audit of their replicas.

Pages are written as WARC files, one gzip member a record, in the order of page_id; the manifest has each record's file and
offset range. For the audit every replica's records are hashed together with their ranges; FANOUT neighbours make a node,
up to a top for each file, which makes the file's root together with the file's length. Files are dealt to BUCKETS by a hash of
their names; the roots in a bucket make its node, and these the replica's root. Replicas are compared from the root down,
and only children of nodes that differ are looked at, so a clean replica costs one comparison of roots and a damaged record one path.

A record's own digest (of the payload, in its header) tells which replica is damaged. A file that is missing or cut short makes all
the records that lack differ; bytes behind the last record are told at that record. Null urls and bodies are written as empty;
spaces and control characters of a url are percent-encoded; repeated rows make records each, ties of page_id go by a hash of
the row; null page_ids come first. An empty table has no files and an empty audit. A very long record is in one task's memory whole.
Columns besides page_id, url and html play no part, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from uuid import UUID

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import filesystem, rows_of, saved, table, work_dir

FANOUT, BUCKETS = 16, 4096
#: Bytes of a file before the next begins.
TARGET = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_MANIFEST = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("pos", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_MANIFEST_DDL = "page_id long, file string, pos long, offset long, length long"


def record(page_id: int | None, url: str | None, body: str | None, date: str = DATE) -> bytes:
    """One WARC record: headers, body, two line ends. The same row always makes the same bytes."""
    payload = (body or "").encode("utf-8", "surrogatepass")
    target = "".join("".join(f"%{b:02X}" for b in c.encode()) if c <= " " or "\x7f" <= c <= "\x9f" else c for c in url or "")
    digest = hashlib.sha256(payload).hexdigest()
    name = UUID(bytes=hashlib.sha256(f"{page_id}\x1f{target}\x1f{digest}".encode()).digest()[:16], version=5)
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; ValueError if it isn't whole or its digest is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    payload = rest[: int(headers["Content-Length"])]
    if rest != payload + b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    if headers.get("WARC-Payload-Digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise ValueError("the payload's digest is wrong")
    return headers, payload


def _member(data: bytes) -> bytes:
    """A gzip member; its header has no time, so equal records make equal bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], where: str, target: int) -> Iterator[pa.RecordBatch]:
    from uuid import uuid4

    fs, folder = filesystem(where)
    fs.create_dir(folder, recursive=True)
    f, name, rows, at = None, "", [], 0

    def done() -> pa.RecordBatch:
        f.close()
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _MANIFEST)], schema=_MANIFEST)

    for batch in batches:
        for page, url, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if f is None:
                name = f"{uuid4().hex}.warc.gz"
                f, rows, at = fs.open_output_stream(f"{folder}/{name}", compression=None), [], 0
            data = _member(record(page, url, body))
            f.write(data)
            rows.append((page, name, len(rows), at, len(data)))
            at += len(data)
            if at >= target:
                yield done()
                f = None
    if f is not None:
        yield done()


def write_warc(pages: DataFrame, where: str, target: int = TARGET) -> DataFrame:
    """Writes pages (page_id, url, html) to files below `where`; the manifest (page_id, file, pos, offset, length).

    Executors write under names of their own; the manifest names the files of the attempts that succeeded.
    """
    df = pages.selectExpr("CAST(page_id AS long) AS page_id", "url", "html", "xxhash64(url, html) AS tie")
    df = df.repartitionByRange("page_id", "tie").sortWithinPartitions("page_id", "tie").drop("tie")
    return saved(df.mapInArrow(lambda b: _write(b, where, target), _MANIFEST_DDL), "warc-manifest")


_READ = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("type", pa.string()), ("html", pa.string())])


def members(f, size: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member of a file, read in pieces."""
    at, z, parts, rest = 0, zlib.decompressobj(31), [], b""
    used = 0
    while data := rest or f.read(size):
        parts.append(z.decompress(data))
        used += len(data) - len(z.unused_data)
        rest = z.unused_data
        if z.eof:
            yield at, b"".join(parts)
            at, z, parts, used = at + used, zlib.decompressobj(31), [], 0
    if used:
        raise ValueError("the file ends inside a record")


def _records(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    fs, folder = filesystem(where)
    for batch in batches:
        for name in batch.column("file").to_pylist():
            with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                for offset, data in members(f):
                    headers, payload = parse(data)
                    row = {"file": name, "offset": offset, "url": headers.get("WARC-Target-URI"), "date": headers.get("WARC-Date"), "type": headers.get("WARC-Type"), "html": payload.decode("utf-8", "replace")}
                    yield pa.RecordBatch.from_pylist([row], schema=_READ)


def read_warc(spark: SparkSession, where: str) -> DataFrame:
    """(file, offset, url, date, type, html) of each record of the .warc.gz files in a folder; a damaged one raises an error."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(where).select(F.substring_index("path", "/", -1).alias("file"))
    tasks = max(1, names.count())
    return names.repartition(tasks, "file").mapInArrow(lambda b: _records(b, where), "file string, offset long, url string, date string, type string, html string")


def _copy(batches: Iterator[pa.RecordBatch], source: str, where: str) -> Iterator[pa.RecordBatch]:
    from uuid import uuid4

    (fs, a), (to, b) = filesystem(source), filesystem(where)
    to.create_dir(b, recursive=True)
    for row in rows_of(batches):
        part, at = f"{b}/{uuid4().hex}.part", 0
        with fs.open_input_stream(f"{a}/{row['file']}", compression=None) as f, to.open_output_stream(part, compression=None) as g:
            while chunk := f.read(4 << 20):
                flips = [i - at for i in row["flips"] if at <= i < at + len(chunk)]
                if flips:
                    chunk = bytearray(chunk)
                    for i in flips:
                        chunk[i] ^= 1
                g.write(chunk)
                at += len(chunk)
        to.move(part, f"{b}/{row['file']}")
        yield pa.RecordBatch.from_arrays([pa.array([row["file"]])], names=["file"])


def replicate(manifest: DataFrame, source: str, where: str, damage: Column | None = None) -> None:
    """Copies the manifest's files to another folder; damage: which records have the last bit of their middle byte flipped there."""
    at = F.when(damage, F.col("offset") + F.floor(F.col("length") / 2)) if damage is not None else F.lit(None).cast("long")
    files = manifest.groupBy("file").agg(F.collect_list(at).alias("flips"))  # as many as a file of TARGET bytes has records, at most
    saved(files.repartition(max(1, files.count()), "file").mapInArrow(lambda b: _copy(b, source, where), "file string"), "copied")


def leaf(offset: int, data: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + offset.to_bytes(8, "big") + len(data).to_bytes(8, "big") + data).digest()


def levels(leaves: list[bytes]) -> list[bytes]:
    """The nodes of each level of the tree over a file's records, side by side, from the leaves to the top."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256(b"\x01" + b"".join(out[-1][i : i + FANOUT])).digest() for i in range(0, len(out[-1]), FANOUT)])
    return [b"".join(x) for x in out]


def file_root(tops: list[bytes], size: int) -> bytes:
    """Hash of a file's tree and length; a file that is missing has the length -1."""
    return hashlib.sha256(b"\x02" + size.to_bytes(8, "big", signed=True) + tops[-1]).digest()


def descend(a: list[bytes], b: list[bytes]) -> tuple[list[int], int]:
    """(leaves that differ between two trees of one shape, number of nodes compared), from the top down."""
    wrong, compared = [0], 0
    for depth in range(len(a) - 1, -1, -1):
        x, y = a[depth], b[depth]
        compared += len(wrong)
        wrong = [i for i in wrong if x[32 * i : 32 * i + 32] != y[32 * i : 32 * i + 32]]
        if depth:
            wrong = [j for i in wrong for j in range(i * FANOUT, min((i + 1) * FANOUT, len(a[depth - 1]) // 32))]
    return wrong, compared


_RECORDS = "array<struct<pos:long,offset:long,length:long,page_id:long>>"
_TREES = pa.schema([("file", pa.string()), ("root", pa.binary()), ("size", pa.int64()), ("levels", pa.list_(pa.binary())), ("whole", pa.binary())])


def _hash(batches: Iterator[pa.RecordBatch], where: str) -> Iterator[pa.RecordBatch]:
    fs, folder = filesystem(where)
    for row in rows_of(batches):
        hashed, whole, size, f = [], bytearray(), -1, None
        try:
            f = fs.open_input_file(f"{folder}/{row['file']}")
            size = f.size()
        except FileNotFoundError:
            pass
        for r in row["records"]:
            data = b""
            if r["offset"] <= size:
                f.seek(r["offset"])
                data = f.read(r["length"])
            try:
                parse(zlib.decompress(data, 31))
                whole.append(1)
            except (ValueError, KeyError, zlib.error):
                whole.append(0)
            hashed.append(leaf(r["offset"], data))
        if f is not None:
            f.close()
        tree = levels(hashed)
        yield pa.RecordBatch.from_pylist([{"file": row["file"], "root": file_root(tree, size), "size": size, "levels": tree, "whole": bytes(whole)}], schema=_TREES)


def files(manifest: DataFrame) -> DataFrame:
    """(file, records) of each file of a manifest: a row for TARGET bytes."""
    return manifest.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "offset", "length", "page_id"))).cast(_RECORDS).alias("records"))


def trees(listed: DataFrame, where: str) -> DataFrame:
    """(file, root, size, levels, whole) of each file as a replica has it: its tree, and which records can be read and have the digest they tell."""
    tasks = max(1, listed.count())  # a given number: ranges are few bytes, what they stand for is not
    return saved(listed.repartition(tasks, "file").mapInArrow(lambda b: _hash(b, where), "file string, root binary, size long, levels array<binary>, whole binary"), "trees")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).alias("bucket")


def buckets(hashed: DataFrame) -> DataFrame:
    """(bucket, node) over the roots of the files."""
    rows = F.array_sort(F.collect_list(F.concat_ws(":", "file", F.hex("root"))))
    return hashed.select(_bucket(), "file", "root").groupBy("bucket").agg(F.sha2(F.concat_ws("\n", rows), 256).alias("node"))


def replica_root(nodes: DataFrame) -> str:
    """The root of a replica, from its at most BUCKETS nodes."""
    return nodes.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "node")))), 256)).first()[0]


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, size, levels, whole) of replica b where its tree differs from a's, from the replicas' roots down."""
    na, nb = (saved(buckets(x), "nodes") for x in (a, b))
    if replica_root(na) == replica_root(nb):
        return b.limit(0)
    wrong = na.join(nb.withColumnRenamed("node", "other"), "bucket", "left").where("other IS NULL OR node <> other").select("bucket")
    inside = a.select("file", "root", _bucket()).join(F.broadcast(wrong), "bucket", "left_semi")  # at most BUCKETS rows
    return b.join(inside.select("file", F.col("root").alias("other")), "file").where("root <> other").drop("root", "other")


_AUDIT = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("pos", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("hash_a", pa.string()), ("hash_b", pa.string()), ("status", pa.string())])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        tree, other = row["levels_a"], row["levels_b"]
        wrong = set(descend(tree, other)[0]) if other else set()
        hash_of = lambda t, i: t[0][32 * i : 32 * i + 32].hex()
        out, end = [], max(r["offset"] + r["length"] for r in row["records"])
        for i, r in enumerate(row["records"]):
            a, b = row["whole_a"][i], row["whole_b"][i] if i in wrong else row["whole_a"][i]
            status = ("differ" if i in wrong else "ok") if a and b else "corrupt_b" if a else "corrupt_a" if b else "corrupt_both"
            if status == "ok" and i == len(row["records"]) - 1 and other:
                status = "extra_b" if row["size_a"] == end != row["size_b"] else "extra_a" if row["size_b"] == end != row["size_a"] else "extra_both" if row["size_a"] != end else "ok"
            out.append({**{k: r[k] for k in ("page_id", "pos", "offset", "length")}, "file": row["file"], "hash_a": hash_of(tree, i), "hash_b": hash_of(other if i in wrong else tree, i), "status": status})
        yield pa.RecordBatch.from_pylist(out, schema=_AUDIT)


def audit(manifest: DataFrame, replica_a: str, replica_b: str) -> DataFrame:
    """The manifest with hash_a, hash_b and status of each record.

    ok; corrupt_a, corrupt_b, corrupt_both: by the record's own digest; differ: both are whole, but not the same; extra_a, extra_b, extra_both:
    the last record of a file that has bytes behind it in that replica, where the replicas differ.
    """
    listed = saved(files(manifest), "files")
    a, b = trees(listed, replica_a), trees(listed, replica_b)
    both = listed.join(a.selectExpr("file", "size AS size_a", "levels AS levels_a", "whole AS whole_a"), "file")
    both = both.join(differing(a, b).selectExpr("file", "size AS size_b", "levels AS levels_b", "whole AS whole_b"), "file", "left")
    return both.mapInArrow(_report, "page_id long, file string, pos long, offset long, length long, hash_a string, hash_b string, status string")


#: Of replica B of the registered query, records with a page_id divisible by this are damaged: so its rows show the descent.
DAMAGED = 1000


def op5_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages against a replica with damage at known places; status is corrupt_b there and ok elsewhere."""
    a, b = work_dir(spark, "warc-a"), work_dir(spark, "warc-b")
    manifest = write_warc(table(spark, sf_dir, "pages"), a)
    replicate(manifest, a, b, F.col("page_id") % DAMAGED == 0)
    return audit(manifest, a, b)
