"""Operator 3: token ids in binary files, with Elias-Fano encoded document boundaries.

A shard file holds the concatenated ids of consecutive documents in 2 or 4 bytes each, their doc_ids, and
the boundaries between them as an Elias-Fano sequence: the low bits of each offset packed side by side, the
high bits in unary. select(i) gives the i-th offset from a sampled directory over the unary part, so the
boundaries take about 2 + log2(ids / documents) bits each and no table of 64-bit offsets exists.

File: magic, length of the header, header (JSON: sizes of the parts), doc_ids, null flags, low bits, high bits,
directory, ids. Files are written by executors to the shared folder under a name of their own per task
attempt; the manifest names those of the attempts that succeeded, so a lost executor leaves no half a result.

Order: by doc_id, nulls first; equal doc_ids by a hash of the text, so repeated rows stay side by side, also where they fill
several files. Null and empty texts have only the end id. A very long document is encoded alone, and whole in one file. An empty table
has no files and an empty result. Columns besides doc_id and text play no part, whatever they are called.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridex.llm.common import filesystem, saved, slices, table, work_dir

VOCABULARY, END_ID = "word_bpe_49k.json", 1
MAGIC = b"VXIDS001"
#: One entry of the directory for so many offsets.
SAMPLE = 64
#: Documents whose offsets are selected at once.
READ = 4 * SAMPLE


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1 if low_bits else np.zeros((n, 0), np.int64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.run(i, 1)[0])

    def run(self, i: int, k: int) -> np.ndarray:
        """The k values from the i-th on: the directory tells where the unary part is looked at, and nothing else is decoded."""
        if not 0 <= i <= i + k - 1 < self.n:
            raise IndexError(i)
        block, last = i // SAMPLE, (i + k - 1) // SAMPLE
        byte = int(self.directory[block]) // 8
        end = int(self.directory[last + 1]) // 8 + 1 if last + 1 < len(self.directory) else len(self.high)
        bits = np.unpackbits(self.high[byte:end], bitorder="little")
        bits[: int(self.directory[block]) % 8] = 0
        ones = byte * 8 + np.flatnonzero(bits)[i - block * SAMPLE :][:k]
        high = (ones - np.arange(i, i + k)) << self.low_bits
        if not self.low_bits:
            return high
        at = i * self.low_bits
        low = np.unpackbits(self.low[at // 8 : ((i + k) * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: k * self.low_bits].reshape(k, self.low_bits)
        return high | low.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))

    def values(self) -> np.ndarray:
        """All of them."""
        return self.run(0, self.n) if self.n else np.zeros(0, np.int64)

    def bits(self) -> int:
        return 8 * (self.low.nbytes + self.high.nbytes + self.directory.nbytes)


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """The parts of a shard file."""
    ef = EliasFano.of(np.append(0, np.cumsum(sizes)))
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8))
    parts = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.directory.astype("<u4").tobytes()]
    head = json.dumps({"docs": len(doc_ids), "ids": len(ids), "width": ids.dtype.itemsize, "low_bits": ef.low_bits, "parts": [len(p) for p in parts]}).encode()
    return [MAGIC, len(head).to_bytes(4, "little"), head, *parts, ids.astype(ids.dtype.newbyteorder("<")).tobytes()]


class Shard:
    """A shard file as read from bytes: any document's ids without the others'."""

    def __init__(self, data: bytes | pa.Buffer):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token id file")
        size = int.from_bytes(view[8:12], "little")
        head = json.loads(bytes(view[12 : 12 + size]))
        at, parts = 12 + size, []
        for n in head["parts"]:
            parts.append(view[at : at + n])
            at += n
        n = head["docs"]
        null = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n) if n else []
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(parts[0], "<i8"), null)]
        self.ids = np.frombuffer(view[at:], f"<u{head['width']}")
        if len(self.ids) != head["ids"]:
            raise ValueError("the file is cut short")
        self.bounds = EliasFano(n + 1, head["low_bits"], np.frombuffer(parts[2], np.uint8), np.frombuffer(parts[3], np.uint8), np.frombuffer(parts[4], "<u4"))

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds.run(i, 2)
        return self.ids[begin:end]


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, where: str, target: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    from uuid import uuid4

    from veridex.llm.segments import vocabulary

    vocab = vocabulary(path)
    dtype = np.uint16 if vocab.dtype == np.uint16 and end_id < 1 << 16 else np.uint32
    fs, folder = filesystem(where)
    from pyspark import TaskContext

    doc_ids, sizes, ids, held, part, number = [], [], [], 0, TaskContext.get().partitionId(), 0

    def flush() -> pa.RecordBatch:
        name = f"{uuid4().hex}.ids"
        all_ids = np.concatenate(ids)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as f:
            for data in pack(doc_ids, np.array(sizes), all_ids):
                f.write(data)
        row = [name, part, number, len(doc_ids), len(all_ids)]
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, out)], schema=out)

    for batch in batches:
        docs, texts = (batch.column(i).to_pylist() for i in range(2))
        for a, b in slices([len(t or "") for t in texts], 1 << 20):
            for d, got in zip(docs[a:b], vocab.encode([t or "" for t in texts[a:b]])):
                doc_ids.append(d)
                sizes.append(len(got) + 1)
                ids.append(np.append(got, end_id).astype(dtype))
                held += len(got) + 1
            if held * dtype().itemsize >= target:
                yield flush()
                doc_ids, sizes, ids, held, number = [], [], [], 0, number + 1
    if doc_ids:
        yield flush()


def write_shards(docs: DataFrame, path: str, end_id: int, where: str, target: int = 32 << 20) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to files below `where`; the manifest, in the order of the documents.

    (name, part, number, docs, ids, start): the file `number` of task `part`, which has a range of the documents; start is the number of
    ids in all files before.
    """
    fields = pa.schema([("name", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
    df = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text", "xxhash64(text) AS tie")
    df = df.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    written = saved(df.mapInArrow(lambda b: _write(b, path, end_id, where, target, fields), "name string, part long, number long, docs long, ids long"), "manifest")
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a task of the range partitioning meets in one task, never one a file.
    parts = written.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", before(Window.orderBy("part")).alias("first"))
    return written.withColumn("inside", before(Window.partitionBy("part").orderBy("number"))).join(parts, "part").withColumn("start", F.col("first") + F.col("inside")).drop("first", "inside")


def _read(batches: Iterator[pa.RecordBatch], where: str, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    fs, folder = filesystem(where)
    for batch in batches:
        for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
            with fs.open_input_file(f"{folder}/{name}") as f:
                shard = Shard(f.read_buffer())
            n = len(shard.doc_ids)
            for i in range(0, n, READ):
                k = min(READ, n - i)
                bounds = shard.bounds.run(i, k + 1)
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[i : i + k], pa.int64()), pa.array(bounds[:-1] + start, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], schema=out)


def read_shards(manifest: DataFrame, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files by select."""
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    # A given number of tasks: by bytes of the manifest all files would be read by one.
    one_each = manifest.select("name", "start").repartition(max(1, manifest.count()), "name")
    return one_each.mapInArrow(lambda b: _read(b, where, fields), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = work_dir(spark, "token-ids")
    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID, where)
    return read_shards(manifest, where)
