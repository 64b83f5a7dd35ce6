"""Operator 2: repeated byte strings, by the common-prefix interval tree of an enhanced suffix array.

maximal_repeats() is the method on texts at hand: suffix array, common prefixes of neighbours, one scan with a stack that
visits the intervals of the tree, and for each a test whether what stands left of its occurrences differs; those
intervals are the maximal repeats, and each is put out with all its occurrences.

dedup() applies it to a corpus. Every LEAST bytes hold an anchor: of the GRAM-byte strings in them the one of least hash, so
equal strings hold equal anchors at equal places, wherever they lie. Documents are read into chunks of bounded size, which are
written once and keep their number. In a first exchange chunks send their anchors' hashes, sorted and packed, each hash once, and
get back one bit each: whether other documents have it. In a second they send the text around the shared anchors (each
distinct context once, with the least doc_id that has it), the suffixes of the contexts of a bucket are sorted, the
interval scan finds the maximal repeats, and each context gets back which of its strings a smaller document has. So a passage that
a third of all documents share weighs as one row a chunk, and no pair of documents is ever formed. The scan sees at most
CONTEXT bytes of a repeat at once: over a corpus the operator tells spans, and maximal_repeats() the groups of texts at hand.

Texts are UTF-8 bytes; null is empty. Shorter ones than LEAST are never touched. A null doc_id counts as larger than all others; equal
doc_ids (repeated rows) don't remove each other's bytes. An empty table gives an empty result. A document is in memory whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import partitions, release, rows_of, saved, slices, spread, table
from veridex.llm.segments import _powers, mix

LEAST, GRAM = 50, 24
SPAN = LEAST - GRAM  # places before an anchor at which a string that holds it can begin
CONTEXT = SPAN + GRAM + SPAN
CHUNK = 4 << 20
#: Bytes of text whose anchors are in a bucket, on average.
BUCKET = 64 << 20
#: Bits of an anchor's hash in the first exchange; equal ones by chance only cost a useless context.
BITS = 48
#: Suffixes that are sorted at once.
PART = 120_000
_LAST = np.iinfo(np.int64).max
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


# The method


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an integer array in order, by doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else []
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        step *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order (Kasai)."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, h, values, o, p = [0] * n, 0, text.tolist(), order.tolist(), place.tolist()
    for i in range(n):
        if not p[i]:
            h = 0
            continue
        j = o[p[i] - 1]
        while i + h < n and j + h < n and values[i + h] == values[j + h]:
            h += 1
        out[p[i]] = h
        h = max(0, h - 1)
    return np.array(out, np.int64)


def intervals(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(length, first, last, diverse) of each interval of the tree with a common prefix of at least `least`.

    first, last: places in the suffix array. left: what stands before each suffix; a negative number differs from all others.
    diverse: not all of these are equal, so the repeat cannot be made longer to the left.
    """
    stack: list[list[int]] = []  # length, first, what stands left (or -1: several)
    n = len(lcp)
    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        first, before = i - 1, left[i - 1] if left[i - 1] >= 0 else -1
        while stack and now < stack[-1][0]:
            top = stack.pop()
            if top[2] != before:
                top[2] = -1
            yield top[0], top[1], i - 1, top[2] == -1
            first, before = top[1], top[2]
        if stack and now == stack[-1][0]:
            if stack[-1][2] != before:
                stack[-1][2] = -1
        elif now >= least:
            stack.append([now, first, before])


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences) of each maximal repeat of at least `least` bytes; occurrences: all (text, place), sorted."""
    parts, of, at = [], [], []
    for k, t in enumerate(texts):
        parts += [np.frombuffer(t, np.uint8).astype(np.int64), np.array([256 + k])]  # no match goes beyond an end
        of.append(np.full(len(t) + 1, k))
        at.append(np.arange(len(t) + 1))
    if not parts:
        return []
    text, of, at = np.concatenate(parts), np.concatenate(of), np.concatenate(at)
    order = suffix_array(text)
    lcp = common_prefixes(text, order)
    left = np.where(at[order] > 0, text[order - 1], -1).tolist()
    return [(n, sorted((int(of[i]), int(at[i])) for i in order[a : b + 1])) for n, a, b, diverse in intervals(lcp.tolist(), left, least) if diverse]


# Anchors


class Anchors:
    """Anchors of a chunk's documents: place, the strings [lo, hi] that they stand for, document, hash."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = data
        starts = np.append(0, ends[:-1])
        found: list[list[np.ndarray]] = []
        for a, b in slices((ends - starts).tolist(), 1 << 19):
            found.append(self._of(int(starts[a]), int(ends[b - 1]), starts[a:b], ends[a:b], a))
        self.at, self.lo, self.hi, self.doc, self.key = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found) if found else [()] * 5, (np.int64, np.int64, np.int64, np.int64, np.uint64)))

    def _of(self, begin: int, end: int, starts: np.ndarray, ends: np.ndarray, first: int) -> list[np.ndarray]:
        none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
        n = end - begin
        if n < LEAST:
            return none
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data[begin:end]] * up[:n], out=sums[1:])
        m = n - GRAM + 1
        h = mix((sums[GRAM:] - sums[:m]) * down[:m])
        del sums
        key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)  # the leftmost of equal ones
        width, low = 1, key
        while 2 * width <= SPAN + 1:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = SPAN + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the string that begins here
        valid = np.ones(len(place), bool)
        for e in (ends - begin).tolist():  # strings that cross an end
            valid[max(0, e - LEAST + 1) : e] = False
        s = np.flatnonzero(valid)
        if not len(s):
            return none
        p = place[s]
        new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)))
        lo, hi = s[new], s[np.append(new[1:] - 1, len(s) - 1)]
        at = p[new]
        doc = np.searchsorted(ends, lo + begin, "right")
        return [at + begin, lo + begin, hi + begin, doc + first, h[at] >> np.uint64(64 - BITS)]


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) * np.uint64((1 << BITS) // n + 1))


def _squeeze(a: np.ndarray) -> bytes:
    """Byte planes, compressed; for sorted integers after differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _expand(blob: bytes, width: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T)


# Chunks

_CHUNK = pa.schema([("chunk", pa.string()), ("doc_ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
_CHUNK_DDL = "chunk string, doc_ids binary, nulls binary, sizes binary, data binary"


def _gather_chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from uuid import uuid4

    import zstandard

    ids, texts, held = [], [], 0

    def made() -> pa.RecordBatch:
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        row = [uuid4().hex, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is None for i in ids]).tobytes(), sizes.tobytes(), data]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNK)], schema=_CHUNK)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            if ids and held + len(raw) > most:
                yield made()
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(raw)
            held += len(raw)
    if ids:
        yield made()


class Chunk:
    def __init__(self, row: dict):
        import zstandard

        self.name = row["chunk"]
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.rank = np.where(self.nulls, _LAST, self.ids)
        sizes = np.frombuffer(row["sizes"], np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(sizes.sum())))
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(sizes)
        self.sizes = sizes
        self.anchors = Anchors(self.data, self.ends)
        a = self.anchors
        self.keys, self.of = np.unique(a.key, return_inverse=True)
        # Whether a key is in several documents of this chunk, by doc_id.
        low = np.full(len(self.keys), _LAST, np.int64)
        high = np.full(len(self.keys), -_LAST - 1, np.int64)
        np.minimum.at(low, self.of, self.rank[a.doc])
        np.maximum.at(high, self.of, self.rank[a.doc])
        self.several = low != high

    def contexts(self, shared: np.ndarray) -> None:
        """Distinct contexts of the shared anchors: rows, the least document of each, and each occurrence's row."""
        a = self.anchors
        self.occ = np.flatnonzero(shared[self.of])
        n = len(self.occ)
        rows = np.zeros((n, CONTEXT + 2), np.uint8)
        at, lo, hi = a.at[self.occ], a.lo[self.occ], a.hi[self.occ]
        columns = [*range(SPAN, SPAN + GRAM), *range(SPAN), *range(SPAN + GRAM, CONTEXT)]  # the anchor first
        top = max(len(self.data) - 1, 0)
        for k, c in enumerate(columns):
            p = at - SPAN + c
            rows[:, k] = np.where((p >= lo) & (p < hi + LEAST), self.data[np.clip(p, 0, top)], 0)
        rows[:, CONTEXT] = lo - (at - SPAN)
        rows[:, CONTEXT + 1] = hi - (at - SPAN)
        void = np.ascontiguousarray(rows).view(f"V{CONTEXT + 2}").ravel()
        # In the order of keys, so that buckets are runs.
        order = np.argsort(void, kind="stable")
        order = order[np.argsort(self.of[self.occ][order], kind="stable")]
        same = np.append(False, (void[order[1:]] == void[order[:-1]]) & (self.of[self.occ][order[1:]] == self.of[self.occ][order[:-1]])) if n else np.zeros(0, bool)
        number = np.cumsum(~same) - 1
        self.row = np.empty(n, np.int64)
        self.row[order] = number
        self.rows = rows[order[~same]]
        self.row_key = self.keys[self.of[self.occ]][order[~same]]
        self.least = np.full(len(self.rows), _LAST, np.int64)
        np.minimum.at(self.least, self.row, self.rank[a.doc[self.occ]])


def _shared(chunk: Chunk, answers: list[dict] | None, n: int) -> np.ndarray:
    out = np.zeros(len(chunk.keys), bool)
    edge = buckets(chunk.keys, n)
    for x in answers or ():
        a, b = edge[x["bucket"]], edge[x["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return out


# First exchange: which anchors are shared

_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("n", pa.int64()), ("several", pa.binary()), ("blob", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _send_keys(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        c = Chunk(row)
        edge = buckets(c.keys, n)
        rows = []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[k], edge[k + 1]
            rows.append((k, c.name, int(b - a), np.packbits(c.several[a:b]).tobytes(), _squeeze(np.diff(c.keys[a:b], prepend=np.uint64(0)))))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, _SENT)], schema=_SENT)
        release()


def _find_shared(t: pa.Table) -> pa.Table:
    release()  # of the group before
    keys, several, sizes = [], [], t["n"].to_pylist()
    for n, s, blob in zip(sizes, t["several"].to_pylist(), t["blob"].to_pylist()):
        keys.append(np.cumsum(_expand(blob, 8).view(np.uint64).ravel()))
        several.append(np.unpackbits(np.frombuffer(s, np.uint8), count=n).astype(bool))
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    s = every[order]
    first = np.append(True, s[1:] != s[:-1])
    group = np.cumsum(first) - 1
    many = np.bincount(group) > 1
    many |= np.bincount(group, weights=np.concatenate(several)[order]) > 0
    flag = np.empty(len(every), bool)
    flag[order] = many[group]
    parts = np.split(flag, np.cumsum(sizes)[:-1])
    keep = [i for i, p in enumerate(parts) if p.any()]
    return pa.table([t["chunk"].take(pa.array(keep, pa.int64())).combine_chunks(), t["bucket"].take(pa.array(keep, pa.int64())).combine_chunks(), pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary())], schema=_ANSWER)


# Second exchange: which strings of the contexts a smaller document has

_ROWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("n", pa.int64()), ("least", pa.binary()), ("blob", pa.binary())])
_MASKS = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("masks", pa.binary())])


def _send_contexts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        c = Chunk(row)
        c.contexts(_shared(c, row["answers"], n))
        edge = buckets(c.row_key, n)
        rows = []
        for k in np.flatnonzero(np.diff(edge)).tolist():
            a, b = edge[k], edge[k + 1]
            rows.append((k, c.name, int(b - a), _squeeze(c.least[a:b]), _squeeze(c.rows[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, _ROWS)], schema=_ROWS)
        release()


def _covered(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each distinct context, as bits, which of its strings stands in a context of a smaller document."""
    back = np.argsort([*range(SPAN, SPAN + GRAM), *range(SPAN), *range(SPAN + GRAM, CONTEXT)])
    text = np.concatenate([rows[:, back], np.zeros((len(rows), CONTEXT), np.uint8)], axis=1)
    lo, hi = rows[:, CONTEXT].astype(np.int64), rows[:, CONTEXT + 1].astype(np.int64)
    count = hi - lo + 1
    who = np.repeat(np.arange(len(rows)), count)
    at = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + lo[who]
    out = np.zeros(len(rows), np.uint32)
    parts = -(-len(who) // PART)
    if parts > 1:  # equal strings are in one part
        h = np.zeros(len(who), np.uint64)
        for k in range(LEAST):
            h = mix(h * np.uint64(0x100000001B3) + text[who, at + k].astype(np.uint64) + np.uint64(1))
        part = (h % np.uint64(parts)).astype(np.int64)
    for k in range(parts):
        if parts > 1:
            inside = np.flatnonzero(part == k)
            w, s = who[inside], at[inside]
        else:
            w, s = who, at
        left_over = hi[w] + LEAST - s  # bytes to the end of the context
        suffix = np.zeros((len(w), CONTEXT + 1), np.uint8)
        for j in range(CONTEXT):
            suffix[:, j] = text[w, s + j]
        suffix[:, CONTEXT] = left_over  # of suffixes that are equal so far the shorter comes first
        order = np.argsort(suffix.view(f"V{CONTEXT + 1}").ravel(), kind="stable")
        suffix, w, s, left_over = suffix[order], w[order], s[order], left_over[order]
        lcp = np.zeros(len(w), np.int64)
        if len(w) > 1:
            differ = suffix[1:, :CONTEXT] != suffix[:-1, :CONTEXT]
            lcp[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), CONTEXT), np.minimum(left_over[1:], left_over[:-1]))
        left = np.where(s > lo[w], text[w, s - 1].astype(np.int64), -1)
        near = lcp >= LEAST
        run = np.flatnonzero(near | np.append(near[1:], False))  # the rest is in no interval
        if not len(run):
            continue
        w, s, left = w[run], s[run], left[run]
        d = doc[w]
        for n, a, b, diverse in intervals(np.where(near[run], lcp[run], 0).tolist(), left.tolist(), LEAST):
            if diverse:  # a maximal repeat, with all its occurrences
                own = d[a : b + 1]
                later = np.flatnonzero(own > own.min()) + a
                if len(later):
                    bits = ((np.uint64(1) << np.uint64(n - LEAST + 1)) - np.uint64(1)) << s[later].astype(np.uint64)
                    np.bitwise_or.at(out, w[later], bits.astype(np.uint32))
    return out


_FULL = np.uint32((1 << (SPAN + 1)) - 1)


def _find_repeats(t: pa.Table) -> pa.Table:
    release()  # of the group before
    sizes = t["n"].to_pylist()
    rows = np.concatenate([_expand(b, CONTEXT + 2) for b in t["blob"].to_pylist()])
    doc = np.concatenate([_expand(b, 8).view(np.int64).ravel() for b in t["least"].to_pylist()])
    void = rows.view(f"V{CONTEXT + 2}").ravel()
    order = np.argsort(void, kind="stable")
    s = void[order]
    group = np.cumsum(np.append(False, s[1:] != s[:-1]))
    distinct = rows[order[np.append(True, group[1:] != group[:-1])]]
    least = np.full(len(distinct), _LAST, np.int64)
    np.minimum.at(least, group, doc[order])
    # Contexts whose anchor has no other context are one repeat as they are; the others' suffixes are sorted.
    anchor = np.ascontiguousarray(distinct[:, :GRAM]).view(f"V{GRAM}").ravel()
    equal = anchor[1:] == anchor[:-1]
    mixed = np.append(equal, False) | np.append(False, equal)
    mask = np.zeros(len(distinct), np.uint32)
    some = np.flatnonzero(mixed)
    heads = np.flatnonzero(np.append(True, anchor[some][1:] != anchor[some][:-1])) if len(some) else some
    for a, b in slices(np.diff(np.append(heads, len(some))).tolist(), PART // (SPAN + 1)):  # whole anchors at a time
        part = some[heads[a] : heads[b] if b < len(heads) else len(some)]
        mask[part] = _covered(distinct[part], least[part])
    out = np.empty(len(rows), np.uint32)
    out[order] = np.where(doc[order] > least[group], _FULL, mask[group])
    parts = np.split(out, np.cumsum(sizes)[:-1])
    keep = [i for i, p in enumerate(parts) if p.any()]
    return pa.table([t["chunk"].take(pa.array(keep, pa.int64())).combine_chunks(), t["bucket"].take(pa.array(keep, pa.int64())).combine_chunks(), pa.array([_squeeze(parts[i]) for i in keep], pa.binary())], schema=_MASKS)


# Result

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _remove(batches: Iterator[pa.RecordBatch], n: int, full: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        c = Chunk(row)
        c.contexts(_shared(c, row["answers"], n))
        a = c.anchors
        mask = np.zeros(len(c.rows), np.uint32)
        edge = buckets(c.row_key, n)
        for x in row["masks"] or ():
            mask[edge[x["bucket"]] : edge[x["bucket"] + 1]] = _expand(x["masks"], 4).view(np.uint32).ravel()
        own = mask[c.row]
        own[c.rank[a.doc[c.occ]] > c.least[c.row]] = _FULL  # a smaller document of this chunk has the context
        mark = np.zeros(len(c.data) + 1, np.int32)
        for k in range(SPAN + 1):
            s = a.at[c.occ] - SPAN + k
            hit = s[(own >> np.uint32(k) & np.uint32(1)).astype(bool) & (s >= a.lo[c.occ]) & (s <= a.hi[c.occ])]
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + LEAST, -1)
        gone = np.cumsum(mark[:-1]) > 0
        rows = []
        for i, (b, e) in enumerate(zip((c.ends - c.sizes).tolist(), c.ends.tolist())):
            g = gone[b:e]
            edges = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
            kept = c.data[b:e][~g].tobytes()
            out = [None if c.nulls[i] else int(c.ids[i]), e - b, int(g.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()]
            rows.append(out + ([kept, [{"begin": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()]] if full else []))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        release()


def dedup(docs: DataFrame, chunk: int = CHUNK, full: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, spans]) of each row of docs (doc_id, text)."""
    chunks = saved(docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(lambda b: _gather_chunks(b, chunk), _CHUNK_DDL), "chunks")
    # Buckets are small beside a task, and grow in number with the text; a chunk sends a row to each that one of its anchors is in.
    n = max(6 * partitions(docs.sparkSession), -(-chunks.count() * chunk // BUCKET))
    sent = chunks.mapInArrow(lambda b: _send_keys(b, n), "bucket int, chunk string, n long, several binary, blob binary")
    answers = saved(sent.groupBy("bucket").applyInArrow(_find_shared, "chunk string, bucket int, bits binary"), "shared")
    known = chunks.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), "chunk", "left")
    rows = known.mapInArrow(lambda b: _send_contexts(b, n), "bucket int, chunk string, n long, least binary, blob binary")
    masks = saved(rows.groupBy("bucket").applyInArrow(_find_repeats, "chunk string, bucket int, masks binary"), "masks")
    both = known.join(masks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks")), "chunk", "left")
    schema = pa.schema([*_OUT, ("kept", pa.binary()), ("spans", _SPANS)]) if full else _OUT
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<begin:long,end:long>>" * full
    return both.mapInArrow(lambda b: _remove(b, n, full, schema), ddl)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spread(table(spark, sf_dir, "documents")))
