"""Operator 6: benchmark decontamination. A BM25 inverted index of the test items, queried with every training passage by block-max WAND.

Passages are windows of twice as many words as the longest item has, so every item lies whole in one of them. A passage's
distinct words are the query; all items whose score reaches THRESHOLD of their score for their own text are retrieved: scores
are divided by that bar, so the bar is 1 for every item. Posting lists have blocks with their largest score, and WAND skips what
cannot reach 1. Before that, array operations drop passages in which no item's essential words reach 1 - HALF: an item's most
common words that together stay under HALF the bar are its other words.
Retrieved items are verified: of both question (the first two thirds of the words) and answer (the rest), a share of OVERLAP has to stand
in the passage in the same order.

Words are runs of letters and digits, lower-cased. Null and empty texts, and items without words, match nothing. Repeated rows are
judged each; null doc_ids and item_ids are carried; items that tie are all told. Very long texts are taken whole, window after
window. An empty table on either side matches nothing. matches() looks at doc_id, text and item_id only; clean() carries all columns,
whatever they are called. The index is made from bounded shards of the items; more items make more shards, each a pass of its own
over the documents with the word statistics of all: benchmarks are small beside a corpus.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import release, saved, slices, spread, table
from veridex.llm.segments import BETWEEN, LETTER, NUMBER, classes, hashes, points

K1, B = 1.2, 0.75
THRESHOLD, HALF, OVERLAP = 0.5, 0.5, 0.8
BLOCK = 8
#: Postings that the array operations before the search add up at a time.
POSTINGS = 1 << 21
#: Bytes of item texts in one shard of the index; what is sent to the executors is a small multiple.
SHARD_BYTES = 8 << 20


def word_spans(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length) of the words of a lower-cased text, and its code points."""
    cp = points(joined)
    kind = classes()[cp]
    inside = (kind == LETTER) | (kind == NUMBER)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin = np.flatnonzero(edge == 1)
    return begin, np.flatnonzero(edge == -1) - begin, cp


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    begin, n, _ = word_spans(low)
    return [low[b : b + k] for b, k in zip(begin.tolist(), n.tolist())]


def common_part(item: list[str], passage: list[str]) -> int:
    """Length of the longest common subsequence, with the item's words as bits of one integer."""
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(item):
        at[w] |= 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in passage:
        if m := at.get(w):
            x = row & m
            row = (row + x | row - x) & full
    return len(item) - row.bit_count()


class Index:
    """Posting lists in blocks, with scores relative to each item's bar."""

    def __init__(self, items: list[tuple[int, str | None]], df: dict[str, int], n_items: int, mean_length: float, threshold: float = THRESHOLD):
        self.items = [(i, w) for i, w in ((i, words(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or ""))) if w]
        self.longest = max((len(w) for _, w in self.items), default=1)
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        essential: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, item) in enumerate(self.items):
            norm = K1 * (1 - B + B * len(item) / mean_length)
            score = {w: math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(item).items()}
            bar = threshold * sum(score.values())
            left = HALF
            for w, x in sorted(score.items(), key=lambda y: (-df[y[0]], y[0])):
                lists[w].append((k, x / bar))
                left -= x / bar
                if left < 0:
                    essential[w].append((k, x / bar))
        self.docs = {w: np.array([k for k, _ in p]).tolist() for w, p in lists.items()}
        self.scores = {w: [x for _, x in p] for w, p in lists.items()}
        self.most = {w: max(s) for w, s in self.scores.items()}
        self.block_most = {w: [max(s[i : i + BLOCK]) for i in range(0, len(s), BLOCK)] for w, s in self.scores.items()}
        vocab = sorted(self.docs)
        joined = " ".join(vocab)
        begin, n, cp = word_spans(joined)
        h = hashes(cp, begin, n) if vocab else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.vocab = h[order], [vocab[i] for i in order]
        flat = [essential.get(w, []) for w in self.vocab]
        self.part_at = np.append(0, np.cumsum([len(p) for p in flat], dtype=np.int64))  # of each word, in the two that follow
        self.part_item = np.array([k for p in flat for k, _ in p], np.int64)
        self.part_score = np.array([x for p in flat for _, x in p], np.float64)

    def search(self, query: set[str]) -> list[tuple[int, float]]:
        """(item's place, score) of all items that reach the bar, by block-max WAND."""
        terms = sorted(w for w in query if w in self.docs)
        docs, scores, most, blocks = ([x[w] for w in terms] for x in (self.docs, self.scores, self.most, self.block_most))
        n, at = len(terms), [0] * len(terms)
        # The lists in the order of the items they stand at: item * n + list.
        lists = sorted(d[0] * n + t for t, d in enumerate(docs))
        out: list[tuple[int, float]] = []
        while lists:
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += most[x % n]
                if bound >= 1 - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = lists[pivot] // n
            pivot = bisect_left(lists, (item + 1) * n)  # the lists before it stand at the item or before it
            bound, until = 0.0, lists[pivot] // n if pivot < len(lists) else len(self.items)
            for x in lists[:pivot]:
                d = docs[x % n]
                k = bisect_left(d, item, at[x % n])
                if k < len(d):
                    b = k // BLOCK
                    bound += blocks[x % n][b]
                    until = min(until, d[min(b * BLOCK + BLOCK, len(d)) - 1] + 1)
            if bound >= 1 - 1e-9 and lists[0] // n == item:
                score = sum(scores[x % n][at[x % n]] for x in lists[:pivot])
                if score >= 1 - 1e-9:
                    out.append((item, score))
                to = item + 1
            else:
                to = item if bound >= 1 - 1e-9 else max(until, item + 1)
            moved = []
            for x in lists[:pivot]:
                t = x % n
                d = docs[t]
                at[t] = k = bisect_left(d, to, at[t])
                if k < len(d):
                    moved.append(d[k] * n + t)
            lists = sorted(moved + lists[pivot:])
        return out

    def _hot(self, slot: np.ndarray, segment: np.ndarray, n_segments: int) -> np.ndarray:
        """Of each segment, whether it and the next hold enough essential words of any item, or it alone, or the next alone.

        slot: vocabulary places of words that have essential postings; segment: where these stand, ascending.
        """
        hot = np.zeros(n_segments + 1, bool)  # the last one is for what is before the first
        cost = self.part_at[slot + 1] - self.part_at[slot]
        per = np.bincount(segment, cost, n_segments).astype(np.int64)
        begin = np.searchsorted(segment, np.arange(n_segments + 1))
        n = len(self.items)
        for a, b in slices(per.tolist(), POSTINGS):
            # With the segment after these, which is the first one of the next run too.
            i, j = begin[a], begin[min(b + 1, n_segments)]
            if i == j:
                continue
            c = cost[i:j]
            place = np.repeat(self.part_at[slot[i:j]] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            key, back = np.unique(np.repeat(segment[i:j], c) * n + self.part_item[place], return_inverse=True)
            value = np.bincount(back, self.part_score[place], len(key))
            follow = np.minimum(np.searchsorted(key, key + n), len(key) - 1)
            both = value + np.where(key[follow] == key + n, value[follow], 0.0)
            hot[key[both >= 1 - HALF - 1e-6] // n] = True
            hot[key[value >= 1 - HALF - 1e-6] // n - 1] = True
        return hot[:n_segments]

    def passages(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(text's place, words) of the windows that hold enough essential words of any item."""
        size = 2 * self.longest
        joined = BETWEEN.join(t.replace(BETWEEN, " ") for t in texts).lower() + BETWEEN
        begin, n, cp = word_spans(joined)
        if not len(begin) or not len(self.hashes):
            return
        ends = np.flatnonzero(cp == ord(BETWEEN))
        count = np.searchsorted(begin, ends)
        h = hashes(cp, begin, n)
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        first = np.append(0, count[:-1])
        # Segments of the longest item's length; a window is a segment and the next one of its text.
        segments = np.maximum(1, -(-(count - first) // self.longest))
        base = np.cumsum(segments) - segments
        word = np.flatnonzero((self.hashes[slot] == h) & (self.part_at[slot + 1] > self.part_at[slot]))
        owner = np.searchsorted(count, word, "right")
        hot = self._hot(slot[word], base[owner] + (word - first[owner]) // self.longest, int(segments.sum()))
        windows = np.maximum(1, segments - 1)
        text = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        a = first[text] + nth * self.longest
        b = np.minimum(a + size, count[text])
        for k in np.flatnonzero(hot[base[text] + nth]).tolist():
            yield int(text[k]), [joined[x : x + y] for x, y in zip(begin[a[k] : b[k]].tolist(), n[a[k] : b[k]].tolist())]

    def verified(self, texts: list[str], overlap: float = OVERLAP) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text's place, item's place) -> (score, question overlap, answer overlap) of the best passage."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        for t, passage in self.passages(texts):
            for k, score in self.search(set(passage)):
                item = self.items[k][1]
                cut = -(-2 * len(item) // 3) if len(item) > 1 else 1
                # In parts of twice the item's length, so that a short item isn't pieced together from a long passage.
                for begin in range(0, max(1, len(passage) - len(item)), len(item)):
                    part = passage[begin : begin + 2 * len(item)]
                    q = common_part(item[:cut], part) / cut
                    a = common_part(item[cut:], part) / (len(item) - cut) if len(item) > cut else q
                    if q >= overlap and a >= overlap:
                        out[t, k] = max(out.get((t, k), (0.0, 0.0, 0.0)), (score, q, a))
        return out


def _match(batches: Iterator[pa.RecordBatch], index: Index, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        rows: list[tuple] = []
        for a, b in slices([len(t) for t in texts], 1 << 20):
            found = index.verified(texts[a:b])
            rows += [(ids[a + t], index.items[k][0], *found[t, k]) for t, k in sorted(found)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(out), out)], schema=out)


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The index, in shards of about shard_bytes of item texts."""
    spark = benchmark.sparkSession
    items = benchmark.selectExpr("CAST(item_id AS long) AS item_id", "text")
    size, n_items = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    shards = max(1, math.ceil(size / shard_bytes))
    each = saved(items.mapInArrow(_item_words, "item_id long, word string, n long"), "item-words")
    df_all = each.groupBy("word").agg(F.count("*").alias("df"))
    total = each.agg(F.sum("n")).first()[0] or 1
    for s in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
        rows = [(r["item_id"], r["text"]) for r in part.collect()]  # about shard_bytes
        own = spark.createDataFrame([(w,) for w in sorted({w for _, t in rows for w in words(t)})], "word string")
        df = {r["word"]: r["df"] for r in df_all.join(own, "word").collect()}  # words of this shard only
        yield Index(rows, df, n_items, total / max(1, n_items))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap) of each verified pair of a row of docs and an item."""
    out = None
    schema = pa.schema([(id_col, pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    ddl = f"`{id_col}` long, item_id long, score double, question_overlap double, answer_overlap double"
    for index in indexes(benchmark, shard_bytes):
        found = docs.selectExpr(f"CAST(`{id_col}` AS long) AS `{id_col}`", "text").mapInArrow(lambda b, index=index: _match(b, index, schema), ddl)
        out = found if out is None else out.unionAll(found)
    return out


def _keep(batches: Iterator[pa.RecordBatch], index: Index, text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        clean = np.ones(len(texts), bool)
        for a, b in slices([len(t) for t in texts], 1 << 20):
            clean[[a + t for t, _ in index.verified(texts[a:b])]] = False
        yield batch.filter(pa.array(clean))
        release()


def clean(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs in which no item is verified, with all their columns."""
    at = docs.columns.index("text")
    for index in indexes(benchmark, shard_bytes):
        docs = docs.mapInArrow(lambda b, index=index: _keep(b, index, at), docs.schema)
    return docs


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word of each item."""
    for batch in batches:
        rows = [(i, w, n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w, n in Counter(words(t)).items()]
        a, b, c = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["item_id", "word", "n"])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
