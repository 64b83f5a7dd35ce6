"""Operator 8: URL filters. A weighted vocabulary over URLs, counted by an Aho-Corasick automaton.

A term counts where it stands between boundaries: the characters beside it in the lower-cased URL are
neither letters a-z nor digits. One strict term, or `soft_limit` distinct soft terms, reject a URL.
Host and path rules come first: the longest rule that fits decides, and only URLs that none fits are
left to the vocabulary.

Nulls and URLs without "://" have an empty host and path, so no rule fits them; the vocabulary still
sees the whole URL (null: empty, allowed), however long. Repeated rows are judged each; rules of equal length never both fit. An
empty table gives an empty result. Columns of the input that are not asked for don't matter, whatever they are called.
The vocabulary is a file of terms and weights; another can be given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.llm.common import table

VOCABULARY = Path(__file__).with_name("url_terms.tsv")


def vocabulary(path: str | Path = VOCABULARY) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict terms, soft terms) of a file with a term and its weight in each line; a term of both weights is strict."""
    weights: dict[str, str] = {}
    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if line.strip() and not line.startswith("#"):
            term, _, weight = line.partition("\t")
            if weight not in ("strict", "soft") or not term:
                raise ValueError(f"{path}, line {n}: a term, a tab, and strict or soft")
            if weights.get(term.lower()) != "strict":
                weights[term.lower()] = weight
    return tuple(sorted(t for t, w in weights.items() if w == "strict")), tuple(sorted(t for t, w in weights.items() if w == "soft"))


STRICT, SOFT = vocabulary()
SOFT_LIMIT = 2


@dataclass(frozen=True)
class Rule:
    """A host and all its subdomains, for paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, by host and then path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path), r.name)):  # the last to fit wins
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _is_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _judge(batches: Iterator[pa.RecordBatch], strict: tuple[str, ...], soft: tuple[str, ...], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):  # a term of both lists is strict
        for term in terms:
            machine.add_word(term.lower(), (kind, term.lower()))
    if len(machine):
        machine.make_automaton()
    for batch in batches:
        found: tuple[list, list] = ([], [])
        for url in batch.column("__url").to_pylist():
            text = url or ""
            hits: dict[str, set[str]] = {"strict": set(), "soft": set()}
            for end, (kind, term) in machine.iter(text) if len(machine) else ():
                begin = end - len(term) + 1
                if not (begin and _is_word(text[begin - 1])) and not (end + 1 < len(text) and _is_word(text[end + 1])):
                    hits[kind].add(term)
            found[0].append(sorted(hits["strict"]))
            found[1].append(sorted(hits["soft"]))
        columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "__url"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found[0], pa.list_(pa.string())), pa.array(found[1], pa.list_(pa.string()))], schema=out)


def judge(urls: DataFrame, id_col: str, url_col: str, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """(id, host, path, rule, verdict, strict_terms, soft_terms) of each row; the vocabulary's size bounds what tasks hold."""
    host, path = host_and_path(F.col(url_col))
    df = urls.select(F.col(id_col).alias("__id"), F.translate(F.col(url_col), _UPPER, _LOWER).alias("__url"), host.alias("host"), path.alias("path"))
    kind = df.schema["__id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([("__id", to_arrow_type(df.schema["__id"].dataType)), ("host", pa.string()), ("path", pa.string()), ("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string()))])
    df = df.mapInArrow(lambda b: _judge(b, strict, soft, out), f"__id {kind}, host string, path string, strict_terms array<string>, soft_terms array<string>")
    ruled = longest_rule(F.col("host"), F.col("path"), rules)
    bad = (F.size("strict_terms") > 0) | (F.size("soft_terms") >= soft_limit)
    return df.withColumn("ruled", ruled).select(
        F.col("__id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "strict_terms", "soft_terms",
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), "page_id", "url").select("page_id", "host", "path", "rule", "verdict", F.concat_ws(",", "strict_terms").alias("strict_terms"), F.concat_ws(",", "soft_terms").alias("soft_terms"))


def _sql() -> str:
    def hit(t: str) -> str:
        return f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"

    def terms(of: tuple[str, ...]) -> str:
        return "concat_ws(',', " + ", ".join(f"CASE WHEN {hit(t)} THEN '{t}' END" for t in sorted(of)) + ")"

    ruled = "".join(f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: (-len(r.host), -len(r.path), r.name)))
    verdicts = "".join(f" WHEN '{r.name}' THEN '{r.verdict}'" for r in RULES)
    n_soft = " + ".join(f"CAST({hit(t)} AS INTEGER)" for t in SOFT)
    return f"""
    WITH a AS (SELECT page_id, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') AS u,
                      CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
         b AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
         c AS (SELECT *, CASE{ruled} END AS rule, {terms(STRICT)} AS strict_terms, {terms(SOFT)} AS soft_terms, {n_soft} AS n_soft FROM b)
    SELECT page_id, host, path, rule,
           CASE rule{verdicts} ELSE CASE WHEN strict_terms <> '' OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END END AS verdict,
           strict_terms, soft_terms FROM c"""


ORACLE_SQL = _sql()
