"""Operator 7: near-duplicates by DartMinHash, with banded joining and an exact check.

A document is the multiset of its five-word shingles (fewer words: one shingle of all; no words: none, and the
document is in a class of its own). Each unit of weight of a shingle is a region that darts fall on at random but
fixed places; a dart has a rank and one of COORDINATES coordinates. For each coordinate the dart of least rank
is kept, so two documents agree on a coordinate with a probability of their weighted Jaccard similarity. Only darts of
rank up to (k ln k + 2 k) / weight are thrown, about k ln k of them however long the document is; a coordinate that none
hit is thrown for again with a larger rank.

Signatures are cut into bands. In each bucket every document is linked to one leader, links are checked exactly
(weighted Jaccard of at least SIMILARITY) and classes are the components. Buckets in which several classes
remain are then compared in blocks, class against class, by signature first and exactly after. A link is lost where its texts share no bucket, with a
probability of 3e-6 at similarity 0.8, or agree on too few coordinates to be likely, with one of 2e-6; no bucket's pairs
are all emitted. Equal texts are one node from the start.

Null and empty texts: each its own class, and kept. Repeated rows: the same class, one of them kept. A null doc_id is never a
class id unless all of its class are null; then one of them is kept. Very long texts are taken whole. An empty table
gives an empty result. Other columns are carried by one_of_each(), whatever they are called, and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import discard, release, rows_of, saved, slices, spread, table
from veridex.llm.segments import BETWEEN, hashes, mix, points

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares none of 24 bands of 4 with a probability of (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, ROWS = 24, 4
COORDINATES = BANDS * ROWS
#: A pair of similarity 0.8 agrees on fewer than 0.6 of 96 coordinates with a probability of about 2e-6.
LIKELY = 0.6
#: Bytes of signatures and shingles in a block of a bucket; a longer document is a block's only one.
BLOCK = 2 << 20
_WHITE = np.zeros(0x110000, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's shingles, repeated ones as often as they occur."""
    cp = points(BETWEEN.join(texts) + BETWEEN)
    sep = np.zeros(len(cp), bool)
    ends = np.cumsum([len(t) + 1 for t in texts])
    sep[ends - 1] = True
    gap = _WHITE[cp] | sep
    edge = np.diff(gap.astype(np.int8), prepend=1, append=1)
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = hashes(cp, begin, end - begin)
    count = np.diff(np.searchsorted(begin, np.append(0, ends)))
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolling = h.copy()
        for k in range(1, WORDS):
            rolling[: len(h) - k] = mix(rolling[: len(h) - k] * np.uint64(0x100000001B3) + h[k:]) if len(h) > k else rolling[: len(h) - k]
        for n in count.tolist():
            if n >= WORDS:
                out.append(np.sort(rolling[at : at + n - WORDS + 1]))
            elif n:
                out.append(mix(hashes(h[at : at + n], np.array([0]), np.array([n]))))
            else:
                out.append(h[:0])
            at += n
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted multisets."""
    if not len(a) and not len(b):
        return 0.0
    xa, na = np.unique(a, return_counts=True)
    xb, nb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[i], nb[j]).sum())
    return both / (len(a) + len(b) - both)


def as_set(bag: np.ndarray) -> np.ndarray:
    """A sorted multiset as a sorted set: the n-th of equal elements becomes an element of its own."""
    first = np.flatnonzero(np.append(True, bag[1:] != bag[:-1])) if len(bag) else np.zeros(0, np.int64)
    nth = np.arange(len(bag)) - np.repeat(first, np.diff(np.append(first, len(bag))))
    return np.sort(mix(bag + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets that are not empty."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the high bits of a hash."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions of one unit of weight, how much of the unit the element has (the last may be in part), and the element's place."""
    units = np.ceil(weights).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), units)
    level = np.arange(len(which)) - np.repeat(np.cumsum(units) - units, units)
    return mix(elements[which] + (level + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.minimum(1.0, weights[which] - level), which


def _waits(x: np.ndarray) -> np.ndarray:
    """How far the next dart of a region is, by the hash of the one before: darts are a Poisson process."""
    return -np.log(_uniform(mix(x ^ np.uint64(0xD1B54A32D192ED03))))


def signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """For each of n documents the dart of least rank at each of k coordinates, as a hash; a document without elements has zeros.

    elements: 64-bit hashes, distinct in each document; weights: positive; doc: the document of each, from 0. All documents'
    darts are thrown together; what a document gets does not depend on the others.
    """
    cell, part, which = cells(elements, weights)
    owner = doc[which]
    total = np.bincount(owner, part, n)
    best_rank, best = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    limit = (k * np.log(k) + 2 * k) / np.where(total > 0, total, 1.0)
    rank = _waits(cell)
    for _ in range(21):
        thrown = np.flatnonzero(rank <= limit[owner])
        state, at, fit, who = cell[thrown], rank[thrown], part[thrown], owner[thrown]
        while len(state):
            state = mix(state + np.uint64(0xA0761D6478BD642F))
            hit = _uniform(mix(state ^ np.uint64(0x8EBC6AF09C88C6E3))) <= fit  # within the element's part of the unit
            slot = who * k + (mix(state ^ np.uint64(0x589965CC75374CC3)) % np.uint64(k)).astype(np.int64)
            near = np.flatnonzero(hit & (at < best_rank[slot]))
            slot, there, dart = slot[near], at[near], state[near]
            np.minimum.at(best_rank, slot, there)
            won = np.flatnonzero(there == best_rank[slot])
            best[slot[won]] = np.iinfo(np.uint64).max
            np.minimum.at(best, slot[won], dart[won])  # of equal ranks the least dart
            at = at + _waits(state)
            more = np.flatnonzero(at <= limit[who])
            state, at, fit, who = state[more], at[more], fit[more], who[more]
        missed = ~np.isfinite(best_rank).reshape(n, k).all(axis=1)
        again = missed[owner]
        if not again.any():
            break
        cell, part, owner, rank = cell[again], part[again], owner[again], rank[again]
        limit *= 2  # all darts of these again, to a larger rank; the least ranks stay
    return best.reshape(n, k)


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The signature of one document."""
    return signatures(elements, weights, np.zeros(len(elements), np.int64), 1, k)[0]


def _sign(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, bands, sigs = [], [], []
        texts = batch.column("text").to_pylist()
        for a, b in slices([len(t or "") for t in texts], 1 << 19):
            bags = shingles([(t or "").replace(BETWEEN, " ") for t in texts[a:b]])
            sizes = np.array([len(s) for s in bags])
            filled = np.flatnonzero(sizes)
            if not len(filled):
                continue
            every, doc = np.concatenate(bags), np.repeat(np.arange(len(filled)), sizes[filled])
            first = np.flatnonzero(np.append(True, (every[1:] != every[:-1]) | (doc[1:] != doc[:-1])))
            weights = np.diff(np.append(first, len(every))).astype(np.float64)
            sig = signatures(every[first], weights, doc[first], len(filled))
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(filled), BANDS))
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
            rows += (a + filled).tolist()
            bands.append(key.view(np.int64).ravel())
            sigs += [s.tobytes() for s in sig.astype("<u4")]
            release()
        nodes = batch.column("node").take(pa.array(rows, pa.int64()))
        offsets = pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32())
        values = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([nodes, pa.ListArray.from_arrays(offsets, values), pa.array(sigs, pa.binary())], schema=out)
        release()


def _features(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").replace(BETWEEN, " ") for t in batch.column("text").to_pylist()]
        for a, b in slices([len(t) for t in texts], 1 << 19):
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([s.tobytes() for s in shingles(texts[a:b])], pa.binary())], schema=out)
            release()


def _check(batches: Iterator[pa.RecordBatch], least: float, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("fa"), batch.column("fb")
        ok = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], schema=out)
        release()


_EDGE = "a binary, b binary"
_EDGES = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def checked(pairs: DataFrame, features: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is at least `least`."""
    fa, fb = (features.select(F.col("node").alias(x), F.col("f").alias(f"f{x}")) for x in "ab")
    return pairs.join(fa, "a").join(fb, "b").select("a", "b", "fa", "fb").mapInArrow(lambda b: _check(b, least, _EDGES), _EDGE)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the least node of its component.

    Alternating stars: each node's larger neighbours are hung on its least one, then its smaller ones, until nothing
    changes; so components of any size take about as many rounds as the logarithm of their diameter.
    """
    edges = saved(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), name)  # u > v
    mark = None
    while True:
        both = edges.unionAll(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").selectExpr("u", "v", "least(m, u) AS m").where("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionAll(low.selectExpr("u", "m AS v")).where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
        old, edges = edges, saved(small, name)
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.selectExpr("u AS node", "v AS root").unionAll(edges.selectExpr("v AS node", "v AS root").distinct())


def _blocks(batches: Iterator[pa.RecordBatch], likely: float, least: float, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Links between two blocks that join different classes: likely pairs are checked exactly, the likeliest first.

    A link that joins two classes makes further ones between them needless, so no more links are put out than the blocks have members.
    """
    for row in rows_of(batches):
        if row["x"] and row["y"]:
            x, y = row["x"], row["y"]
            sx, sy = (np.frombuffer(b"".join(m["sig"] for m in side), "<u4").reshape(len(side), -1) for side in (x, y))
            agree = np.zeros((len(x), len(y)), np.int16)
            for j in range(sx.shape[1]):
                agree += sx[:, j, None] == sy[None, :, j]
            number = {r: k for k, r in enumerate(dict.fromkeys(m["root"] for m in [*x, *y]))}
            rx, ry = (np.array([number[m["root"]] for m in side]) for side in (x, y))
            fx, fy = ([as_set(np.frombuffer(m["f"], np.uint64)) for m in side] for side in (x, y))
            up = np.arange(len(number))
            links = []
            i, j = np.nonzero((agree >= likely * sx.shape[1]) & (rx[:, None] != ry[None, :]))
            order = np.argsort(-agree[i, j], kind="stable")
            for part in range(0, len(order), 1 << 16):
                some = order[part : part + (1 << 16)]
                for p, q in zip(i[some].tolist(), j[some].tolist()):
                    a, b = up[rx[p]], up[ry[q]]
                    if a != b and set_similarity(fx[p], fy[q]) >= least:
                        up[up == b] = a
                        links.append((x[p]["node"], y[q]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.binary()), pa.array([v for _, v in links], pa.binary())], schema=out)


def _residual(bands: DataFrame, roots: DataFrame, signed: DataFrame, features: DataFrame, likely: float, least: float, block: int = BLOCK) -> DataFrame:
    """Links of different classes that share a bucket.

    A bucket's members are dealt to blocks by a hash, and each pair of blocks is a key of its own: no task holds more than two
    blocks, and the pairs of a hot bucket spread over all tasks. Signatures and shingles join last, by node.
    """
    known = bands.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    size = features.select("node", (F.octet_length("f") + 4 * COORDINATES + 64).alias("size"))
    sized = known.join(size, "node")
    mixed = sized.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.sum("size") / block).alias("blocks")).where("lo <> hi").select("band", "blocks")
    own = known.join(mixed, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).selectExpr("band", "least(block, other) AS i", "greatest(block, other) AS j", "block", "node", "root")
    full = dealt.join(signed.select("node", "sig"), "node").join(features, "node")
    pairs = full.groupBy("band", "i", "j").agg(F.collect_list(F.struct("block", "node", "root", "sig", "f")).alias("m"))
    sides = pairs.select(F.filter("m", lambda x: x["block"] == F.col("i")).alias("x"), F.when(F.col("i") == F.col("j"), F.col("m")).otherwise(F.filter("m", lambda x: x["block"] == F.col("j"))).alias("y"))
    return sides.mapInArrow(lambda b: _blocks(b, likely, least, _EDGES), _EDGE).selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()


def _empty() -> Column:
    return ~F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, node, root, empty) of each row of docs (doc_id, text): class_id is the least doc_id of the class.

    node: a hash of the text; root: the class; empty: the text has no word, the row is a class of its own.
    """
    node = F.unhex(F.md5(F.col("text").cast("binary")))
    docs = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").withColumn("node", node)
    fields = pa.schema([("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
    one = docs.select("node", "text").mapInArrow(lambda b: _sign(b, fields), "node binary, bands array<long>, sig binary")
    signed = saved(one.dropDuplicates(["node"]), "signatures")  # of equal texts any; map tasks drop theirs first
    bands = signed.select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    # A bucket's leader is the member whose buckets are largest: of a text and its changed copies, the text itself.
    weight = bands.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("w"))
    leaders = saved(bands.join(sizes, "band").join(weight, "node").groupBy("band").agg(F.max(F.struct("w", "node")).alias("m")).select("band", F.col("m.node").alias("leader")), "leaders")
    stars = saved(bands.join(leaders, "band").where("node <> leader").selectExpr("node AS a", "leader AS b").distinct(), "stars")
    shared = bands.join(leaders, "band").select("node").distinct()
    some = docs.where(F.col("text").isNotNull()).join(shared, "node", "left_semi").select("node", "text").dropDuplicates(["node"])
    what = pa.schema([("node", pa.binary()), ("f", pa.binary())])
    features = saved(some.mapInArrow(lambda b: _features(b, what), "node binary, f binary"), "features")
    links = saved(checked(stars, features, least), "links")
    discard(leaders, stars)
    roots = components(links, "roots")
    more = saved(_residual(bands, roots, signed, features, LIKELY, least), "links")
    discard(signed, features)
    if not more.isEmpty():
        roots = components(links.unionAll(more), "roots")
    discard(links, more)
    # The least doc_id of each text, then of each class of texts; copies are summed up before they meet.
    least_id = docs.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    rooted = least_id.join(roots, "node").select("node", "root", "doc_id")
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")).join(rooted.select("node", "root"), "root").select("node", "root", "class_id")
    found = least_id.join(ids, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "doc_id").alias("class_id"))
    out = docs.select("doc_id", "node", _empty().alias("empty")).join(found, "node", "left")
    return out.select("doc_id", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"), "node", "root", "empty")


def _order() -> list[Column]:
    """Which row of a class is kept: the least doc_id, nulls last; of equal ids the least text by hash."""
    return [F.col("doc_id").isNull().alias("nul"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("node")]


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of each class the row with the least doc_id (nulls last; of equal rows one), with all columns of docs; rows without words all stay."""
    key = ["nul", "k", "node"]
    found = saved(classes(docs, least).select("root", "empty", *_order()), "classes")
    first = found.where("NOT empty").groupBy("root").agg(F.min(F.struct(*key)).alias("f")).select("f.*")
    twice = found.where("NOT empty").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.expr("CAST(doc_id AS long)").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), _empty().alias("empty")).select("row", "empty", *_order())
    stay = packed.where("NOT empty").join(first, key, "left_semi")
    out = stay.join(twice, key, "left_anti").select("row").unionAll(stay.join(twice, key, "left_semi").dropDuplicates(key).select("row"))
    return out.unionAll(packed.where("empty").select("row")).select(*(F.col("row").getField(c).alias(c) for c in names))


def judged(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) of each row of docs: one row of a class is kept, that of one_of_each()."""
    found = saved(classes(docs, least).withColumn("rid", F.monotonically_increasing_id()), "classes")
    first = found.where("NOT empty").groupBy("root").agg(F.min(F.struct(*_order(), "rid")).alias("f")).select("f.rid", F.lit(True).alias("first"))
    return found.join(first, "rid", "left").select("doc_id", "class_id", (F.col("empty") | F.coalesce("first", F.lit(False))).alias("kept"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spread(table(spark, sf_dir, "documents")))
