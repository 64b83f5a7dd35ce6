"""Operator 1: quality rules by weak supervision, in DataFrame functions only.

Each rule votes for a document (1), against it (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns (at most 3 ** rules of them, however many documents there are) estimates the share of good documents and how
often each rule is right on good and on bad ones; a document is kept if its posterior probability
of being good is at least `THRESHOLD`. The base conditions reject on their own.

A null or empty text has no words, so it fails the base. Texts of any length are taken whole. Repeated rows are judged each, and count each. An
empty table gives an empty result. Columns besides doc_id and text play no part in votes().
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import saved, spread, table

#: WINDOW is what the pairwise hashing in statistics() makes.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
_WHITE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ITERATIONS, THRESHOLD = 25, 0.5
#: Before the first step: the share of good documents, how often a rule is right on good ones, and on bad ones (each kind of
#: defect is seen by few rules). BELIEF: the strength of these, in documents; what EM learns of a rule has no other bound.
PRIOR, RIGHT_GOOD, RIGHT_BAD, BELIEF = 0.8, 0.99, 0.2, 20.0


@dataclass(frozen=True)
class Rule:
    """Conditions in SQL that both engines read, over the columns of statistics()."""

    name: str
    good: str
    bad: str

    @property
    def vote(self) -> str:
        return f"CASE WHEN n_words = 0 THEN 0 WHEN {self.bad} THEN -1 WHEN {self.good} THEN 1 ELSE 0 END"


RULES = (
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols >= n_words"),
    Rule("marks", "100 * n_marks <= 15 * word_chars", "100 * n_marks >= 30 * word_chars"),
    Rule("word_length", "10 * word_chars BETWEEN 30 * n_words AND 68 * n_words", "10 * word_chars < 25 * n_words OR 10 * word_chars > 120 * n_words"),
    Rule("lines", "n_dup_lines = 0", "10 * n_dup_lines >= 3 * n_lines"),
    Rule("repeats", "100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    # Distinct words grow with the root of a text's length; up to 1,000 words the shares are the stricter bounds.
    Rule("variety", "100 * n_distinct >= 40 * n_words OR n_distinct * n_distinct >= 160 * n_words", "100 * n_distinct < 20 * n_words AND n_distinct * n_distinct < 40 * n_words"),
    Rule("sentences", "n_stops > 0 AND n_words BETWEEN 3 * n_stops AND 40 * n_stops", "n_stops = 0 OR n_words < 2 * n_stops OR n_words > 100 * n_stops"),
    Rule("capitals", "100 * n_upper <= 15 * word_chars", "100 * n_upper >= 40 * word_chars"),
)


def _count(text: Column, chars: str) -> Column:
    """Characters of text that are among `chars`; one pass of a regular expression is faster than translate()."""
    return F.length(text) - F.length(F.regexp_replace(text, "[" + re.escape(chars) + "]", ""))


def _after(array: Column, k: int) -> Column:
    return F.slice(array, F.lit(1 + k), F.greatest(F.lit(0), F.size(array) - k))


def _repeated(words: Column, hashed: Column, n: Column) -> Column:
    """Words in windows that a text has twice or more.

    Windows are first compared by hash; only texts with two equal hashes compare the words themselves, sorted together with their
    places. Sorting keeps long texts at n log n.
    """
    starts = F.sequence(F.lit(0), n - WINDOW)
    keys = F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i + 1, WINDOW)))
    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def same(pairs: Column, j: Column, d: int) -> Column:
        return F.coalesce(F.get(pairs, j + d)["k"] == F.get(pairs, j)["k"], F.lit(False)) & (j + d >= 0)

    # Places as (place or -1), with the pairs kept in a variable by a one-element transform.
    at = F.transform(F.array(placed), lambda pairs: F.array_sort(F.filter(F.transform(pairs, lambda p, j: F.when(same(pairs, j, -1) | same(pairs, j, 1), p["i"])), lambda x: x.isNotNull())))[0]
    covered = F.transform(F.array(at), lambda a: F.aggregate(F.transform(a, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(a, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))[0]
    return F.when((n >= WINDOW) & (F.size(F.array_distinct(hashed)) < F.size(hashed)), covered).otherwise(F.lit(0))


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_distinct, n_stops, n_upper), one row a document.

    carry: all columns of docs too, in the struct `row`.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    df = docs.select("doc_id", *rows, text.alias("text"))
    rows = ["row"] if carry else []
    df = df.select("doc_id", *rows, "text", F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"))
    df = df.select(
        "doc_id", *rows, "words", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("w"),
        F.length(F.array_join("words", "")).alias("word_chars"), _count(F.col("text"), _SYMBOLS).alias("n_symbols"), _count(F.col("text"), _MARKS).alias("n_marks"),
        _count(F.col("text"), ".!?").alias("n_stops"), _count(F.col("text"), _UPPER).alias("n_upper"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    hashed = F.col("w")
    for k in (1, 2, 4):  # hashes of 2, 4 and 8 neighbours
        df = df.withColumn("w8", F.zip_with(hashed, _after(hashed, k), lambda a, b: F.xxhash64(a, b)))
        hashed = F.col("w8")
    df = df.withColumn("hashed", F.slice("w8", F.lit(1), F.greatest(F.lit(0), F.col("n") - (WINDOW - 1))))
    longs = ("word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_marks", "n_stops", "n_upper")
    return df.select(
        "doc_id", *rows, F.col("n").cast("long").alias("n_words"), *(F.col(c).cast("long").alias(c) for c in longs),
        _repeated(F.col("words"), F.col("hashed"), F.col("n")).cast("long").alias("n_repeat_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def votes(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return stats.withColumn("votes", F.array(*(F.expr(r.vote) for r in rules)))


def _weight(v: str, s: str, c: str) -> str:
    return f"CASE {v} WHEN 1 THEN ln({s} / (1 - {c})) WHEN -1 THEN ln((1 - {s}) / {c}) ELSE 0D END"


def estimate(voted: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> tuple[float, list[float], list[float]]:
    """(share of good documents, each rule's rate of right votes on good ones, and on bad ones), by expectation-maximisation.

    The whole iteration is one SQL expression over the array of vote patterns and their counts.
    """
    js = range(n_rules)
    patterns = voted.groupBy("votes").count().agg(F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("count").cast("double").alias("n")))).alias("p"))
    odds = " + ".join(["ln(t.pi / (1 - t.pi))", *(_weight(f"x.v[{j}]", f"t.s[{j}]", f"t.c[{j}]") for j in js)])
    posts = f"transform(p, x -> named_struct('v', x.v, 'n', x.n, 'g', 1D / (1D + exp(-({odds})))))"

    def total(what: str) -> str:
        return f"aggregate(q, 0D, (a, x) -> a + {what})"

    def rate(j: int, side: int, share: str, first: float) -> str:
        return f"({total(f'CASE WHEN x.v[{j}] = {side} THEN x.n * {share} ELSE 0D END')} + {BELIEF * first}D) / ({total(f'CASE WHEN x.v[{j}] <> 0 THEN x.n * {share} ELSE 0D END')} + {BELIEF}D)"

    good = ", ".join(rate(j, 1, "x.g", RIGHT_GOOD) for j in js)
    bad = ", ".join(rate(j, -1, "(1D - x.g)", RIGHT_BAD) for j in js)
    share = f"({total('x.n * x.g')} + {BELIEF * PRIOR}D) / ({total('x.n')} + {BELIEF}D)"
    step = f"transform(array({posts}), q -> named_struct('pi', {share}, 's', array({good}), 'c', array({bad})))[0]"
    start = f"named_struct('pi', {PRIOR}D, 's', array_repeat({RIGHT_GOOD}D, {n_rules}), 'c', array_repeat({RIGHT_BAD}D, {n_rules}))"
    row = patterns.selectExpr(f"aggregate(sequence(1, {iterations}), {start}, (t, i) -> {step}) AS t").first()["t"]
    return row["pi"], list(row["s"]), list(row["c"])


def posterior(model: tuple[float, list[float], list[float]]) -> Column:
    from math import log

    pi, s, c = model
    odds = F.lit(log(pi / (1 - pi)))
    for j, (a, b) in enumerate(zip(s, c)):
        v = F.col("votes")[j]
        odds = odds + F.when(v == 1, log(a / (1 - b))).when(v == -1, log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """statistics() with votes, posterior, base_failed and kept."""
    voted = saved(votes(statistics(docs, carry), rules).withColumn("base_failed", base_failed()), "votes")
    model = estimate(voted.where(~F.col("base_failed")), len(rules))
    return voted.withColumn("posterior", posterior(model)).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    return judged(docs, carry=True).where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spread(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def _sql() -> str:
    js = range(len(RULES))
    vs = ", ".join(f"{r.vote} AS v{j}" for j, r in enumerate(RULES))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    marks = _MARKS.replace("'", "''")
    odds = "ln(pi / (1 - pi))" + "".join(" + " + _weight(f"v{j}", f"s{j}", f"c{j}").replace("0D", "0") for j in js)

    def rate(j: int, side: int, share: str, first: float) -> str:
        return f"(sum(CASE WHEN v{j} = {side} THEN n * {share} ELSE 0 END) + {BELIEF * first}) / (sum(CASE WHEN v{j} <> 0 THEN n * {share} ELSE 0 END) + {BELIEF})"

    steps = ", ".join([f"{rate(j, 1, 'g', RIGHT_GOOD)} AS s{j}" for j in js] + [f"{rate(j, -1, '(1 - g)', RIGHT_BAD)} AS c{j}" for j in js])
    starts = ", ".join([f"CAST({x} AS DOUBLE) AS {c}{j}" for c, x in (("s", RIGHT_GOOD), ("c", RIGHT_BAD)) for j in js])
    names = ", ".join(f"{x}{j}" for x in "sc" for j in js)
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: translate(x, {white}, '') <> '') AS lines FROM d),
    win AS (SELECT r, i, words[i:i + {WINDOW - 1}] AS k FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
    rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
    cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range({WINDOW})) AS o) GROUP BY r),
    s AS (SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(translate(text, {white}, '')) AS BIGINT) AS word_chars,
                 CAST(length(text) - length(translate(text, '{_SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(length(text) - length(translate(text, '{marks}', '')) AS BIGINT) AS n_marks,
                 CAST(length(text) - length(translate(text, '.!?', '')) AS BIGINT) AS n_stops, CAST(length(text) - length(translate(text, '{_UPPER}', '')) AS BIGINT) AS n_upper,
                 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
    v AS (SELECT *, {vs}, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM s),
    pat AS (SELECT {", ".join(f"v{j}" for j in js)}, CAST(count(*) AS DOUBLE) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
    em(it, pi, {names}) AS (
        SELECT 0, CAST({PRIOR} AS DOUBLE) AS pi, {starts}
        UNION ALL
        SELECT it + 1, (sum(n * g) + {BELIEF * PRIOR}) / (sum(n) + {BELIEF}), {steps}
        FROM (SELECT em.*, pat.*, 1 / (1 + exp(-({odds}))) AS g FROM em, pat WHERE it < {ITERATIONS}) GROUP BY it),
    j AS (SELECT v.*, 1 / (1 + exp(-({odds}))) AS posterior FROM v, (SELECT * FROM em WHERE it = {ITERATIONS}))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {THRESHOLD} AS kept, round(posterior, 6) AS posterior FROM j"""


ORACLE_SQL = _sql()
