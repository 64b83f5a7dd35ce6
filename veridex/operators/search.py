"""Lexical search: BM25 over a table of documents, and ranking of the catalog's datasets for a question."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridex.plans.dialect import accents
from veridex.sources.catalog import Catalog, Dataset
from veridex.sources.shared import work_dir

K1, B = 1.5, 0.4
#: Added for the first five places of the text search.
PLACES = (25, 20, 15, 10, 5)


def terms(text: Column) -> Column:
    """Lower-case words of two letters or digits at least, without accents, and pairs of neighbours."""
    one = F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), *accents()), F.lit(r"[a-z0-9]{2,}"), F.lit(0))

    def both(w: Column) -> Column:  # w: the words, extracted once
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
        return F.concat(w, pairs)

    return F.transform(F.array(one), both)[0]


def _counted(text: Column, q: list[str]) -> Column:
    """Struct (dl, tf): the number of terms, and how often each of q occurs; a text's terms are made once."""
    short = lambda t: F.struct(F.size(t).alias("dl"), F.filter(t, lambda x: x.isin(*q)).alias("hits"))
    count = lambda a, term: F.size(F.filter(a, lambda x: x == F.lit(term)))
    counts = lambda s: F.struct(s["dl"].alias("dl"), F.array(*(count(s["hits"], w) for w in q)).alias("tf"))
    return F.transform(F.transform(F.array(terms(text)), short), counts)[0]


def bm25(docs: DataFrame, key: str, text: str, question: str, top: int) -> DataFrame:
    """(key, score) of the `top` best documents; the best score is 1.

    One pass over the texts writes the length and the counts of the question's terms of each; totals and scores come from these.
    """
    spark = docs.sparkSession
    q = spark.range(1).select(F.array_distinct(terms(F.lit(question))).alias("q")).first()["q"]
    if not q:
        return docs.select(F.col(key), F.lit(0.0).alias("score")).limit(0)
    where = work_dir(spark, "bm25")
    cores = spark.sparkContext.defaultParallelism  # a small table is often one file, which one task would read
    spread = docs.repartition(cores) if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores else docs
    spread.select(F.col(key), _counted(F.col(text), q).alias("c")).select(key, "c.dl", "c.tf").write.mode("overwrite").parquet(where)
    counted = spark.read.parquet(where)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(q)))).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    score = F.lit(0.0)
    for i in range(len(q)):
        tf = F.col("tf")[i].cast("double")
        score = score + F.lit(idf(n, stats[f"df{i}"] or 0)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    best = counted.where(F.exists("tf", lambda x: x > 0)).select(key, score.alias("s")).orderBy(F.desc("s"), key).limit(top)
    most = F.max("s").over(Window.partitionBy())  # over the `top` rows
    return best.select(key, F.round(F.col("s") / most, 4).alias("score"))


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


class CatalogIndex:
    """BM25 over the catalog's texts: term counts of each active dataset. A catalog is small; it needs no job."""

    def __init__(self, texts: dict[str, str]):
        self.counts = {k: Counter(self.terms(t)) for k, t in texts.items()}
        self.length = {k: sum(c.values()) for k, c in self.counts.items()}
        self.mean = sum(self.length.values()) / max(1, len(texts)) or 1.0
        self.df = Counter(w for c in self.counts.values() for w in c)

    @staticmethod
    def terms(text: str) -> list[str]:
        w = re.findall(r"[a-z0-9]{2,}", plain(text))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    def search(self, question: str, top: int) -> list[tuple[str, float]]:
        """(key, score) of the best, the best score 1; of equal scores by key."""
        found = {}
        for k, c in self.counts.items():
            s = sum(idf(len(self.counts), self.df[w]) * c[w] * (K1 + 1) / (c[w] + K1 * (1 - B + B * self.length[k] / self.mean)) for w in dict.fromkeys(self.terms(question)) if c[w])
            if s > 0:
                found[k] = s
        most = max(found.values(), default=1.0)
        return [(k, round(found[k] / most, 4)) for k in sorted(found, key=lambda k: (-found[k], k))[:top]]


_INDEXES: dict[str, CatalogIndex] = {}


def index_of(texts: dict[str, str]) -> CatalogIndex:
    """The index of these texts; made anew when any of them changes."""
    mark = hashlib.sha256(json.dumps(texts, sort_keys=True).encode()).hexdigest()
    if mark not in _INDEXES:
        while len(_INDEXES) >= 8:
            _INDEXES.pop(next(iter(_INDEXES)))
        _INDEXES[mark] = CatalogIndex(texts)
    return _INDEXES[mark]


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))


# Words of a question that say nothing about the subject; that ask for a register, a ranking, a series; that name a step.
STOP = set("a an and are as at by do for from how in is it me of on or show tell that the there to want was were what when which who with you".split())
REGISTER = set("list register inventory which".split())
RANKING = set("most least top largest smallest highest lowest ranking".split())
SERIES = set("daily monthly yearly hourly evolution history trend series".split())
PERIOD = set("day days week month months year years today yesterday since between during daily monthly yearly".split())


def _words(text: str) -> set[str]:
    found = set(re.findall(r"[a-z0-9]+", plain(text)))
    return found | {w[:-1] for w in found if len(w) > 3 and w.endswith("s")}


def _hits(question: set[str], field: str) -> int:
    """Words of the question in a field: short ones as whole words, others anywhere."""
    own, text = _words(field), plain(field)
    return sum(1 for w in question if (w in own if len(w) < 5 else w in text))


def keyword_score(d: Dataset, raw: set[str], perspectives: frozenset[str] = frozenset()) -> int:
    """perspectives: those that datasets of the catalog take and the question names."""
    words = {w for w in raw if len(w) >= 3 and w not in STOP}
    score = 3 * sum(1 for t in d.tags if _hits(words, t)) + 2 * min(1, _hits(words, d.context))
    n = _hits(words, f"{d.name} {d.title}")
    score += 4 * n if n >= 2 else 2 * n
    score += sum(h for q in d.questions if (h := _hits(words, q)) >= 2)
    if not d.grain.get("step") and len(d.columns) < 5:
        score -= 4
    if raw & RANKING:
        score += -6 if not d.metrics else -4 if d.supports_ranking is False else 4
    if raw & SERIES and d.grain.get("step") not in (None, "static"):
        score += 3
    if raw & REGISTER and not raw & PERIOD and not any(re.fullmatch(r"(19|20)\d{2}", w) for w in raw):
        score += 8 if d.grain.get("step") == "static" else -8
    if score > 0:
        score += 9 if d.family_default and not raw & (PERIOD | SERIES) else 0
        score += 6 if any(_hits(words, t) for t in d.measure_terms) else 0
        score += 10 if any(len(a) >= 4 and not a.isdigit() and a in raw for c in d.columns for a in map(plain, c.aliases)) else 0
        if d.perspective and perspectives:
            score += 6 if plain(d.perspective) in perspectives else -6
    return max(0, score)


def rank(spark, catalog: Catalog, question: str, top: int = 3, owner: str | None = None) -> list[tuple[str, int, str]]:
    """(key, score, band) of the datasets that suit a question: keyword rules, and a bonus by place in the text search."""
    return [r[:3] for r in ranked(catalog, question, top, owner)]


def asked_for(question: str) -> set[str]:
    """The words of a question that name its subject."""
    return {w for w in re.findall(r"[a-z0-9]+", plain(question)) if len(w) >= 3 and w not in STOP | PERIOD and not w.isdigit()}


def ranked(catalog: Catalog, question: str, top: int = 3, owner: str | None = None) -> list[tuple[str, int, str, list[str]]]:
    """(key, score, band, words of the question that the dataset has) of the datasets that suit a question."""
    active = [d for d in catalog.datasets.values() if d.status == "active" and owner in (None, d.owner)]
    raw = _words(question)
    named = frozenset(plain(d.perspective) for d in active if d.perspective and plain(d.perspective) in raw)
    score = {d.key: keyword_score(d, raw, named) for d in active}
    texts = {d.key: f"{d.name} {d.title} {' '.join(d.tags)} {d.context} {' '.join(c.name for c in d.columns)}" for d in active}
    for place, (key, _) in zip(PLACES, index_of(texts).search(question, len(PLACES))):
        score[key] += place
    asked = asked_for(question)
    by_key = {d.key: d for d in active}

    def strong(d: Dataset) -> set[str]:
        return {w for w in asked if _hits({w}, f"{d.name} {d.title} {' '.join(d.tags)}")}

    def matched(d: Dataset) -> set[str]:
        return strong(d) | {w for w in asked if _hits({w}, d.context)}

    def band(d: Dataset) -> str:
        return "high" if asked and strong(d) == asked else "medium" if asked and 2 * len(matched(d)) >= len(asked) else "low"

    best = sorted((k for k, s in score.items() if s > 0), key=lambda k: (-score[k], k))[:top]
    return [(k, score[k], band(by_key[k]), sorted(matched(by_key[k]))) for k in best]
