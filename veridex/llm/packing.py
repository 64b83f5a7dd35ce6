"""Operator 4: documents packed into as few sequences as can be.

Pieces are placed by best fit (the longest first, each into the fullest sequence that has room). Then a local search
over the sequences that are not full exchanges one piece for one, two for one, or moves one, whenever the sum of
squared fills rises; so gaps gather in few sequences until these are empty.

Pieces are dealt into groups of bounded size, each packed by one task; sequences that are full are final, and so are the fullest
of the others where these hold more than OPEN of the group's pieces: the search found nothing better for them among a whole
group. The pieces of the rest meet again in fewer groups, at most that share of them a round, until one group holds them all. So
neither the number of documents, nor a copied one, nor lengths that do not fit together weigh on a task.

A null text is empty: a piece of one id, the end id. Repeated rows are packed each; null doc_ids are carried. Ties of size go by doc_id.
Only documents longer than a sequence are cut, however long: the pieces after the first are full. An empty table gives an empty
result. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import release, saved, slices, spread, table

VOCABULARY, END_ID, LENGTH = "byte_bpe_50k.json", 0, 2048
#: Pieces that one task packs, and the share of them, from the emptiest sequences, that may meet others in a later round.
GROUP, OPEN = 200_000, 0.5
_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first."""
    first = n % length or min(n, length)
    return [(0, first)] + [(s, length) for s in range(first, n, length)] if n else []


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int) -> Iterator[pa.RecordBatch]:
    from veridex.llm.segments import vocabulary

    vocab = vocabulary(path)
    schema = pa.schema(_FIELDS)
    for batch in batches:
        docs, texts = (batch.column(i).to_pylist() for i in range(2))
        rows: list[list] = [[] for _ in _FIELDS]
        for a, b in slices([len(t or "") for t in texts], 1 << 20):
            for d, got in zip(docs[a:b], vocab.encode([t or "" for t in texts[a:b]])):
                ids = np.append(got, end_id).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    for column, x in zip(rows, (d, k, start, n, zlib.crc32(ids[start : start + n].tobytes()))):
                        column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, schema)], schema=schema)
        release()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Sequences as lists of indexes: the longest piece first, each into the fullest sequence with room."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[list[int]] = [[] for _ in range(length + 1)]  # sequences by what is free
    free = 0  # bit r: room[r] has one
    bins: list[list[int]] = []
    for i in order:
        n = sizes[i]
        fits = free >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free ^= 1 << r
            bins[k].append(i)
            r -= n
        else:
            k, r = len(bins), length - n
            bins.append([i])
        room[r].append(k)
        free |= 1 << r
    return bins


def local_search(bins: list[list[int]], sizes: list[int], length: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull sequences that raise the sum of squared fills.

    Each round fills the fullest of them first, from the emptier ones; the search ends when a round changes nothing.
    """
    done = [b for b in bins if sum(sizes[i] for i in b) == length]
    left = [b for b in bins if b and sum(sizes[i] for i in b) < length]
    while True:
        left.sort(key=lambda b: -sum(sizes[i] for i in b))
        fill = [sum(sizes[i] for i in b) for b in left]
        where: dict[int, set[int]] = defaultdict(set)  # size -> sequences that have a piece of it
        for k, b in enumerate(left):
            for i in b:
                where[sizes[i]].add(k)
        changed = False
        sums: dict[int, int] = {}  # sequence -> bits: what two of its pieces sum to
        reach = 0  # bits: sums of two in any sequence, now or before

        def pair_sums(k: int) -> int:
            nonlocal reach
            if k not in sums:
                counts = Counter(sizes[i] for i in left[k])
                has = sum(1 << n for n in counts)
                found = 0
                for n, c in counts.items():
                    found |= (has if c > 1 else has ^ 1 << n) << n
                sums[k] = found
                reach |= found
            return sums[k]

        for k in range(len(left)):
            pair_sums(k)

        def shift(take: list[int], donor: int, give: list[int], to: int) -> None:
            for i in take:
                left[donor].remove(i)
            for i in give:
                left[to].remove(i)
            left[donor] += give
            left[to] += take
            for k in (donor, to):
                fill[k] = sum(sizes[i] for i in left[k])
                del sums[k]
                pair_sums(k)
            for i in [*take, *give]:
                for k in (donor, to):
                    if any(sizes[j] == sizes[i] for j in left[k]):
                        where[sizes[i]].add(k)
                    else:
                        where[sizes[i]].discard(k)

        def piece(k: int, n: int, besides: int = -1) -> int | None:
            return next((i for i in left[k] if sizes[i] == n and i != besides), None)

        def emptier(n: int, to: int) -> int | None:
            """The emptiest sequence that has a piece of n and is no fuller than `to`."""
            return max((k for k in where.get(n, ()) if k > to and fill[k] <= fill[to] and fill[k]), default=None)

        def two(to: int, gap: int, above: int, held: list[int]) -> tuple[int, list[int], int, list[int]] | None:
            """The exchange of two for one with the highest gain over `above`, from the emptiest sequence that has it."""
            mask, best, most = (2 << gap) - 1, None, 0
            for small in held:
                most = max(most, (reach >> small & mask).bit_length() - 1)
            for k in range(len(left) - 1, to, -1):
                if above >= most:
                    break
                if not fill[k] or fill[k] > fill[to]:
                    continue
                for small in held:
                    gain = (sums[k] >> small & mask).bit_length() - 1
                    if gain > above:
                        above, best = gain, (k, small)
            if best is None:
                return None
            k, small = best
            seen: dict[int, int] = {}
            for j in left[k]:
                if (i := seen.get(small + above - sizes[j])) is not None:
                    return above, [i, j], k, [piece(to, small)]
                seen[sizes[j]] = j
            raise AssertionError("sums of two are out of date")

        for to in range(len(left)):
            while fill[to] and (gap := length - fill[to]):
                best: tuple[int, list[int], int, list[int]] | None = None  # gain of fill, take, donor, give
                held = sorted({sizes[i] for i in left[to]})
                for n in range(gap, 0, -1):
                    if (k := emptier(n, to)) is not None:  # a move
                        best = (n, [piece(k, n)], k, [])
                        break
                if best is None or best[0] < gap:
                    for small in held:  # one for one
                        for gain in range(gap, best[0] if best else 0, -1):
                            if (k := emptier(small + gain, to)) is not None:
                                best = (gain, [piece(k, small + gain)], k, [piece(to, small)])
                                break
                        if best and best[0] == gap:
                            break
                if best is None or best[0] < gap:
                    best = two(to, gap, best[0] if best else 0, held) or best
                if best is None:
                    break
                shift(*best[1:], to)
                changed = True
        left = [b for b in left if b]
        if not changed:
            break
    return done + left


def _pack(batches: Iterator[pa.RecordBatch], length: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    got = pa.Table.from_batches(list(batches), schema=pa.schema(_FIELDS))
    if not len(got):
        return
    got = got.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    sizes = got["length"].to_pylist()
    bins = local_search(best_fit(sizes, length), sizes, length)
    base = (level << 56) + (TaskContext.get().partitionId() << 32)
    index, sequence, offset = [], [], []
    bins.sort(key=lambda b: sum(sizes[i] for i in b))  # the emptiest first
    room = OPEN * len(sizes)
    for k, b in enumerate(bins):
        room -= len(b)
        final = last or room < 0 or sum(sizes[i] for i in b) == length
        at = 0
        for i in b:
            index.append(i)
            sequence.append(base + k if final else None)
            offset.append(at if final else None)
            at += sizes[i]
    out = got.take(pa.array(index)).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
    yield from out.to_batches(max_chunksize=100_000)


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of docs (doc_id, text)."""
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(lambda b: _pieces(b, path, end_id, length), _DDL)


def pack(found: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `length`."""
    left, out, level = saved(found, "pieces"), [], 0
    n = left.count()
    while True:
        groups = max(1, -(-n // group))
        last = groups == 1
        dealt = left.repartition(groups) if groups > 1 else left.coalesce(1)  # by turns: equal rows do not gather
        placed = saved(dealt.mapInArrow(lambda b, level=level, last=last: _pack(b, length, level, last), f"{_DDL}, sequence_id long, offset long"), "packed")
        out.append(placed.where(F.col("sequence_id").isNotNull()))
        if last:
            break
        left, level = placed.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset"), level + 1
        n = left.count()
    result = out[0]
    for df in out[1:]:
        result = result.unionAll(df)
    return result


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(VOCABULARY)))
