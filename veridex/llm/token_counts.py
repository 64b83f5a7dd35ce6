"""Operator 10: token counts by prefix dynamic programming.

For every prefix of a text the exact number of tokens is known, so truncation and budget questions are
answered without encoding again. The recurrence: the encoding of a prefix p ends with one token t, and
without t it is the encoding of the shorter prefix; t is the only suffix of p that is a token and
stays whole beside the shorter prefix's last token. So count(p) = count(p without t) + 1. Two tokens stay whole
beside each other iff merging their concatenation gives just these two, which is looked up in a cache.

No token crosses the place between a non-space and a space, nor a character that only tokens of its own
hold, so a text is cut there, each distinct segment's table is made once, and a text's prefix count is the sum
over the segments before it plus an entry of one segment's table.

Null and empty texts have 0 tokens. Repeated rows are counted each, ties play no part. Very long texts are one segment after the other, U+2581
counts as the space that it stands for, and no text is encoded again and again. An empty table gives an empty result. Columns besides doc_id and text
play no part, whatever they are called.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veridex.llm.common import slices, spread, table
from veridex.llm.segments import BETWEEN, Segments, gather, hashes, points

LIMIT = 4096
MODEL = "piece_bpe_32k.model"
_SPACE = "▁"
#: Characters of a segment whose prefixes are remembered; at four tokens a character their counts are under 256.
SHORT = 63
#: What stands for BETWEEN inside a text: as unknown to models, and as long in UTF-8.
_OTHER = "\U0010fffe"


class PrefixCounter:
    """Exact counts for a sentencepiece BPE model with byte fallback, at every prefix."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        normal = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        pieces = [lib.id_to_piece(i) for i in normal]
        #: The order of merges: by falling score; of equal ones the leftmost comes first.
        self.rank = {p: -lib.get_score(i) for i, p in zip(normal, pieces)}
        #: Length of the longest token that ends in these two characters.
        self.reach: dict[str, int] = {}
        for p in pieces:
            if len(p) > 1:
                self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 0))
        #: Characters that no token of several has; no merge crosses them.
        inner = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = frozenset(chr(c) for c in (9, 10, 13)) - inner
        self.whole = all(_SPACE not in p.lstrip(_SPACE) for p in pieces)  # no space after another character
        assert self.whole, "tokens of this model cross word boundaries"
        assert not {BETWEEN, _OTHER} & {c for p in pieces for c in p} and lib.encode(f"a{_SPACE}b {BETWEEN}") == lib.encode("a b ") + lib.encode(f" {BETWEEN}")[-4:], "this model treats spaces otherwise"
        self.together: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[bytes, str]] = {}  # prefix of a segment -> counts of its prefixes, its last token
        self.cache = Segments(self.table, np.uint16, bits=20, most=24_000_000)

    def _stay(self, a: str, b: str) -> bool:
        """Whether two tokens stay whole beside each other."""
        found = self.together.get((a, b))
        if found is None:
            if len(self.together) > 400_000:
                self.together.clear()
            found = self.together[a, b] = self._apart(a, b)
        return found

    def _apart(self, a: str, b: str) -> bool:
        """Merges a + b, the pair of lowest rank first, the leftmost of these: whether a and b come out of it, and no pair crosses their border."""
        parts, get, cut, none = list(a + b), self.rank.get, len(a), math.inf
        ranks = [get(x + y, none) for x, y in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            if i == cut - 1:
                return False
            cut -= i < cut
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        return len(parts) == 2

    def prefixes(self, s: str) -> list[int]:
        """Token counts of s[:1], s[:2], ... of a segment, spaces as U+2581."""
        counts: list[int] = [0]
        last: list[str] = [""]
        rank, reach, stay = self.rank, self.reach.get, self._stay
        for end in range(1, len(s) + 1):
            for begin in range(max(0, end - reach(s[max(0, end - 2) : end], 1)), end):
                t = s[begin:end]
                if (t in rank or end - begin == 1) and (not begin or stay(last[begin], t)):
                    n = 1 if t in rank else len(t.encode("utf-8", "surrogatepass"))  # an unknown character falls back to its bytes
                    counts.append(counts[begin] + n)
                    last.append(t)
                    break
            else:
                raise AssertionError(f"no last token of {s[:end]!r}")
        return counts[1:]

    def _known(self, s: str) -> bytes:
        """prefixes(s) of a short segment, from the state of its longest prefix that was met before."""
        states, k = self.states, len(s)
        if len(states) > 400_000:
            states.clear()
        while k and s[:k] not in states:
            k -= 1
        counts = states[s[:k]][0] if k else b""
        rank, reach, stay = self.rank, self.reach.get, self._stay
        for end in range(k + 1, len(s) + 1):
            for begin in range(max(0, end - reach(s[max(0, end - 2) : end], 1)), end):
                t = s[begin:end]
                if (t in rank or end - begin == 1) and (not begin or stay(states[s[:begin]][1], t)):
                    counts += bytes(((counts[begin - 1] if begin else 0) + (1 if t in rank else len(t.encode("utf-8", "surrogatepass"))),))
                    states[s[:end]] = counts, t
                    break
            else:
                raise AssertionError(f"no last token of {s[:end]!r}")
        return counts

    def table(self, segment: str) -> np.ndarray:
        """Counts of a segment's prefixes, modulo 65536: differences of neighbours, which are checked here, restore them."""
        s = segment.replace(" ", _SPACE)
        if len(s) <= SHORT:
            return np.frombuffer(self._known(s), np.uint8)
        counts = np.array(self.prefixes(s), np.int64)
        if (np.abs(np.diff(counts)) >= 1 << 15).any():
            raise OverflowError("the count of a prefix changes by more than a table's entry can tell")
        return counts & 0xFFFF

    def segments(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(joined texts, each with a space before it; start, length and text of each segment; code points)."""
        joined = "".join(f" {t}{BETWEEN}" for t in texts)
        cp = points(joined)
        sep, space = cp == ord(BETWEEN), cp == 32
        lone = sep | np.isin(cp, [ord(c) for c in self.alone])
        start = np.ones(len(cp), bool)
        start[1:] = lone[1:] | lone[:-1] | (space[1:] & ~space[:-1])
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, len(cp)))
        of = np.cumsum(sep[begin])
        keep = ~sep[begin]
        return joined, cp, begin[keep], length[keep], of[keep]

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the number of tokens of text[:1], text[:2], ... text."""
        own = [t.replace(_SPACE, " ").replace(BETWEEN, _OTHER) for t in texts]  # the library counts these alike
        joined, cp, begin, length, of = self.segments(own)
        at, n = self.cache.find(joined, begin, length, hashes(cp, begin, length))
        low = gather(self.cache.values, at, n).astype(np.int64)
        step = np.diff(low, prepend=0)
        step = (step + (1 << 15)) % (1 << 16) - (1 << 15)
        first = np.cumsum(np.append(0, n[:-1]))
        step[first] = low[first]
        inside = np.cumsum(step)
        inside -= np.repeat(np.append(0, inside[(first - 1)[1:]]), n)
        full = inside[first + n - 1]
        before = np.cumsum(full) - full
        total = inside + np.repeat(before, n)
        sizes = np.bincount(of, weights=n, minlength=len(own)).astype(np.int64)[: len(own)]
        ends = np.cumsum(sizes)
        out = []
        for i in range(len(texts)):
            a, b = ends[i] - sizes[i], ends[i]
            base = total[a - 1] if a else 0
            out.append((total[a:b] - base)[1:])  # without the space before the text
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int, store: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    import zlib

    of = counter(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n, fits, blobs, sizes = [], [], [], []
        for a, b in slices([len(t) for t in texts], 1 << 19):
            for t, c in zip(texts[a:b], of.counts(texts[a:b])):
                n.append(int(c[-1]) if len(c) else 0)
                fits.append(longest_prefix(c, limit))
                sizes.append(len(t.encode("utf-8", "surrogatepass")))
                if store:
                    blobs.append(zlib.compress(np.diff(c, prepend=0).astype("<i2").tobytes(), 1))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fits, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(blobs, pa.binary())] if store else [])], schema=out)


def prefix_counts(docs: DataFrame, path: str, limit: int = LIMIT, store: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars[, prefixes]) of each row of docs (doc_id, text).

    fits_chars: characters of the longest prefix of at most `limit` tokens. prefixes: the whole table, for stored().
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fits_chars", pa.int64())] + ([("prefixes", pa.binary())] if store else [])
    ddl = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long" + ", prefixes binary" * store
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(lambda b: _count(b, path, limit, store, pa.schema(fields)), ddl)


def stored(blob: bytes) -> np.ndarray:
    """The counts that prefix_counts(store=True) keeps of a text: any budget is answered from them."""
    import zlib

    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<i2").astype(np.int64))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(MODEL))
