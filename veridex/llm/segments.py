"""Vectorised pre-tokenisation, and a cache from a segment's hash to what a vocabulary makes of it.

The public tokenizers cut a text into segments that no token crosses; the result for a text is the
concatenation of the results for its segments. Segments are found with array operations over many
texts at once, each distinct one is encoded once, and the rest are looked up. Texts for which the
array rules could differ from the library (special strings, code points whose class changed between
Unicode versions) go to the library whole.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER, SEP, UNSURE = range(6)
#: Stands between texts; a text that has it goes to the library.
BETWEEN = "\U0010ffff"


def _class(category: str) -> int:
    return LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OTHER


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point; UNSURE where Unicode 3.2 and this Python disagree, as other versions may too."""
    old = unicodedata.ucd_3_2_0.category
    out = np.full(0x110000, UNSURE, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        now, then = unicodedata.category(c), old(c)
        if now != "Cs" and then != "Cn" and _class(now) == _class(then):
            out[cp] = _class(now)
    white = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[white] = SPACE
    out[0x180E] = UNSURE  # was white space once
    out[ord(BETWEEN)] = SEP
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(cp: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
    """'s 't 're 've 'm 'll 'd at the positions `at` become segments of their own."""
    n = len(cp)
    at = at[at + 1 < n]
    one = cp[at + 1]
    two = np.where(at + 2 < n, cp[np.minimum(at + 2, n - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for hit, length in ((at[short], 2), (at[long], 3)):
        start[hit + 1] = False
        end = hit + length
        start[end[end < n]] = True


def byte_level(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Segment starts under 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+."""
    n = len(cp)
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SEP)
    space = kind == SPACE
    follows = np.zeros(n, bool)  # a white space that something other than white space follows
    follows[:-1] = space[:-1] & ~space[1:] & (kind[1:] != SEP)
    start |= follows
    attached = np.zeros(n, bool)
    attached[1:] = (follows & (cp == 32))[:-1]
    quote = np.flatnonzero((cp == 39) & start & ~attached)
    start &= ~attached
    _contractions(cp, start, quote)
    return start


def word_level(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Segment starts under 's|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+; white space makes segments too."""
    start = np.ones(len(cp), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SEP)
    start |= kind == NUMBER
    _contractions(cp, start, np.flatnonzero((cp == 39) & start))
    return start


_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _MUL), ("down", _INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[start:start+length]; equal runs have equal hashes wherever they lie."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64) * _MUL)


class Segments:
    """Direct-mapped cache: hash of a segment -> (offset, length) in an array of values; bounded, since it begins anew when full."""

    def __init__(self, make, dtype, bits: int = 20, most: int = 6_000_000):
        self.make, self.dtype, self.bits, self.most = make, dtype, bits, most
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.key, self.at, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.values, self.used = np.zeros(1 << 16, self.dtype), 0

    def _add(self, values: list) -> int:
        end = self.used + len(values)
        if end > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(max(len(self.values), end), self.dtype)])
        self.values[self.used : end] = values
        at, self.used = self.used, end
        return at

    def find(self, joined: str, starts: np.ndarray, lengths: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, length) in self.values for each segment; new ones are made from joined[start:start+length]."""
        if self.used > self.most:
            self.clear()
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, n = self.at[slot], self.n[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            made_at, made_n = np.empty(len(new), np.int32), np.empty(len(new), np.int32)
            begin = starts[miss][first].tolist()
            end = (starts[miss][first] + lengths[miss][first]).tolist()
            make, add = self.make, self._add
            for k, (b, e) in enumerate(zip(begin, end)):
                values = make(joined[b:e])
                made_at[k], made_n[k] = add(values), len(values)
            at[miss], n[miss] = made_at[back], made_n[back]
            to = slot[miss][first]
            self.key[to], self.at[to], self.n[to] = new, made_at, made_n
        return at, n


def gather(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs values[at:at+n], one after the other."""
    total = int(n.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(n, dtype=np.int64)
    index = np.arange(total, dtype=np.int64) + np.repeat(at.astype(np.int64) - (ends - n), n)
    return values[index]


class Vocabulary:
    """Ids of texts, as the tokenizers library gives them for a byte-level BPE file.

    word_end: the file's suffix of the last symbol of a word, if it has one; then white space is dropped and
    text is normalised and lower-cased first, as the file says.
    """

    #: Stands for the word end; no byte of UTF-8.
    END = b"\xff"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.word_end = spec["model"].get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in letters} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(letters))}
        ranks, self.ids = {}, {}
        for token, i in spec["model"]["vocab"].items():
            if token in self.special:
                continue
            ends = self.word_end and token.endswith(self.word_end)
            raw = bytes(byte[c] for c in (token.removesuffix(self.word_end) if ends else token)) + self.END * bool(ends)
            ranks[raw] = i
        if self.word_end:
            ranks[self.END] = 1 << 20
        engine = tiktoken.Encoding("segments", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        self.piece = engine._core_bpe.encode_single_piece
        self.dtype = np.uint16 if max(spec["model"]["vocab"].values()) < 1 << 16 else np.uint32
        self.cache = Segments(self._make, self.dtype)

    def _make(self, segment: str) -> list[int]:
        return self.piece(segment.encode() + self.END * bool(self.word_end))

    def slow(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _risky(self, text: str) -> bool:
        return BETWEEN in text or any(s in text for s in self.special) or bool((classes()[points(text)] == UNSURE).any())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        own = list(texts)
        if self.word_end:
            own = [t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in own]
        joined = BETWEEN.join(own) + BETWEEN
        if self.word_end:
            risky = [i for i, t in enumerate(own) if "Σ" in t or "İ" in t] if "Σ" in joined or "İ" in joined else []
        else:
            risky = []
        cp = points(joined)
        kind = classes()[cp]
        if (kind == UNSURE).any() or int((kind == SEP).sum()) != len(own) or any(s in joined for s in self.special):
            risky = sorted({*risky, *(i for i, t in enumerate(own) if self._risky(t))})
        if risky:
            for i in risky:
                own[i] = ""
            joined = BETWEEN.join(own) + BETWEEN
        if self.word_end:
            joined = joined.lower()
        if risky or self.word_end:
            cp = points(joined)
            kind = classes()[cp]
        begin = np.flatnonzero((word_level if self.word_end else byte_level)(cp, kind))
        length = np.diff(np.append(begin, len(cp)))
        what = kind[begin]
        last = np.cumsum(what == SEP)  # the number of texts that have ended
        keep = what != SEP if not self.word_end else (what != SEP) & (what != SPACE)
        begin, length, of = begin[keep], length[keep], last[keep]
        at, n = self.cache.find(joined, begin, length, hashes(cp, begin, length))
        ids = gather(self.cache.values, at, n)
        sizes = np.bincount(of, weights=n, minlength=len(own)).astype(np.int64)[: len(own)]
        out = np.split(ids, np.cumsum(sizes)[:-1])
        for i in risky:
            out[i] = self.slow(texts[i])
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One a worker process."""
    return Vocabulary(path)
