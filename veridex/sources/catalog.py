"""Dataset contracts: loading, lookup, description; scans that carry the contract's metadata on their fields."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridex.sources import files

CONTRACTS = Path(__file__).parent.parent / "contracts"
_KNOWN = {"name", "owner", "title", "status", "tags", "context", "grain", "prune", "portal_url", "columns", "metrics", "patterns", "questions", "measure_terms", "family", "family_default", "perspective", "has_total_row", "source", "files_url", "supports_ranking", "examples"}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    semantic: str = "dimension"
    unit: str | None = None
    cast: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    available_from: str | None = None


@dataclass(frozen=True)
class Metric:
    id: str
    columns: list[str]
    kind: str
    unit: str | None = None
    default: str | None = None
    forbidden: list[str] = field(default_factory=list)
    interval_hours: float | None = None
    modes: dict[str, dict[str, str]] = field(default_factory=dict)

    def column(self, mode: str):
        """The mode's expression as a Column."""
        return F.expr(self.modes[mode]["sql"])


@dataclass(frozen=True)
class Dataset:
    name: str
    owner: str
    title: str
    status: str
    tags: list[str]
    context: str
    grain: dict[str, Any]
    columns: list[Column]
    metrics: list[Metric]
    prune: str | None = None
    portal_url: str | None = None
    patterns: list[dict[str, str]] = field(default_factory=list)
    questions: list[str] = field(default_factory=list)
    measure_terms: list[str] = field(default_factory=list)
    family: str | None = None
    family_default: bool = False
    perspective: str | None = None
    has_total_row: bool = False
    #: The files below the engine's folder, as a glob; by default one of the dataset's name.
    source: str | None = None
    #: Where the files are published, with {names} for what changes from file to file.
    files_url: str | None = None
    supports_ranking: bool | None = None
    #: Questions with the SQL that answers them.
    examples: list[dict[str, str]] = field(default_factory=list)

    @property
    def key(self) -> str:
        return f"{self.owner}/{self.name}"

    def paths(self, spark: SparkSession, folder: str, years: set[int] | None = None) -> list[str]:
        """The files; only those of `years` where these are proven to do."""
        glob = f"{folder}/{self.source or self.name + '.parquet'}"
        return files.prune_paths(files.listed(spark, glob), years) if re.search(r"[*?\[{]", glob) else [glob]

    def reads(self, path: str, folder: str) -> bool:
        """Whether a path (or glob) is one of the dataset's files."""
        own = f"{folder.rstrip('/')}/{self.source or self.name + '.parquet'}"
        if files._plain(path) == files._plain(own) or re.fullmatch(re.escape(files._plain(own)).replace(r"\*", "[^/]*").replace(r"\?", "[^/]"), files._plain(path)):
            return True
        return bool(self.files_url and re.fullmatch(re.sub(r"\\\{\w+\\\}", "[^/]+", re.escape(self.files_url)), path))

    def scan(self, spark: SparkSession, folder: str, years: set[int] | None = None) -> DataFrame:
        """The table, with contract facts in the fields' metadata; declared casts are applied. Several files are united by name."""
        paths = self.paths(spark, folder, years)
        df = files.union_by_name(spark, paths) if len(paths) > 1 else spark.read.parquet(*paths)
        facts = {c.name: c for c in self.columns}
        metric = {c: m for m in self.metrics for c in m.columns}
        out = []
        for f in df.schema.fields:
            c, m = facts.get(f.name), metric.get(f.name)
            about = {"dataset": self.key, "column": f.name}
            if c and c.unit:
                about["unit"] = c.unit
            if m:
                about |= {"metric": m.id, "kind": m.kind, "unit": m.unit or about.get("unit", "")}
            x = F.expr(c.cast) if c and c.cast else F.col(f.name)
            out.append(x.alias(f.name, metadata=about))
        return df.select(*out)

    def mode(self, spark: SparkSession, folder: str, metric: str, mode: str, by: list[str]) -> DataFrame:
        """A metric's declared mode for each of `by`, as the column of the mode's name.

        A mode's shape may ask for more: series, a row for each time, in its order; ranking, the place by falling value; share, the part
        of the sum over all.
        """
        m = next(m for m in self.metrics if m.id == metric)
        shape, keys = m.modes[mode].get("shape"), by + ([self.grain["temporal_column"]] if m.modes[mode].get("shape") == "series" else [])
        out = self.scan(spark, folder).groupBy(*keys).agg(m.column(mode).alias(mode))
        if shape == "series":
            return out.orderBy(*keys)
        if shape == "ranking":  # one row for each of `by`
            return out.withColumn("place", F.rank().over(Window.orderBy(F.desc_nulls_last(mode))).cast("long"))
        return out.withColumn("part", F.col(mode) / F.sum(mode).over(Window.partitionBy())) if shape == "share" else out

    def describe(self) -> str:
        """The contract as Markdown."""
        lines = [f"# {self.key}: {self.title}", self.context, f"Grain: {self.grain}", "", "| column | type | semantic | unit |", "|-|-|-|-|"]
        lines += [f"| {c.name} | {c.type} | {c.semantic} | {c.unit or ''} |" for c in self.columns]
        lines += [f"- metric {m.id}: {m.kind}, {m.unit or 'no unit'}, default {m.default}, modes {sorted(m.modes)}" for m in self.metrics]
        lines += [f"- pattern {p['id']}: `{p['sql']}`" for p in self.patterns]
        lines += [f"- {a}: {f}" for c in self.columns for a, f in c.aliases.items()]
        lines += [f"- since {c.available_from}: {c.name}" for c in self.columns if c.available_from]
        lines += [f"- example: {e['question']} `{e['sql']}`" for e in self.examples[:2]]
        lines += [f"- warning: {c.name} holds numbers as text; cast it: {c.cast}" for c in self.columns if c.type == "string" and (c.cast or c.semantic == "metric")]
        return "\n".join(lines)


@dataclass(frozen=True)
class Catalog:
    datasets: dict[str, Dataset]

    def find(self, name: str, owner: str | None = None) -> Dataset | None:
        """By key, by name, then regardless of case and - or _."""
        active = self.datasets
        if name in active:
            return active[name]

        def plain(s: str) -> str:
            return s.casefold().replace("-", "_")

        for same in (lambda d: d.name == name, lambda d: plain(d.name) == plain(name)):
            for key in sorted(active):
                if same(active[key]) and (owner is None or active[key].owner == owner):
                    return active[key]
        return None

    def listing(self, owner: str | None = None) -> list[tuple[str, str]]:
        return [(d.key, d.title) for _, d in sorted(self.datasets.items()) if d.status == "active" and owner in (None, d.owner)]

    def of_path(self, path: str, folder: str) -> Dataset | None:
        """The one dataset that has a file; None where several could."""
        found = [d for d in self.datasets.values() if d.status == "active" and d.reads(path, folder)]
        return found[0] if len(found) == 1 else None

    def alias(self, dataset: str, word: str) -> str:
        """The filter text that a word of the contract stands for."""
        d = self.find(dataset)
        for c in d.columns if d else ():
            for a, text in c.aliases.items():
                if a.casefold() == word.casefold():
                    return text
        raise KeyError(f"{dataset} has no value {word}")

    def with_casts(self, casts: dict[str, dict[str, str]]) -> Catalog:
        """The catalog with casts that were measured, dataset key -> column -> cast, where the contract declares none."""
        def laid(d: Dataset) -> Dataset:
            own = casts.get(d.key, {})
            return replace(d, columns=[replace(c, cast=c.cast or own.get(c.name)) for c in d.columns])

        return Catalog({k: laid(d) for k, d in self.datasets.items()})

    def register(self, spark: SparkSession, folder: str, names: set[str] | None = None, years: dict[str, set[int] | None] | None = None) -> None:
        """A temporary view for each active dataset, or for those of `names`; of files by year only those of `years`."""
        for d in self.datasets.values():
            if d.status == "active" and (names is None or d.name.lower() in names):
                d.scan(spark, folder, (years or {}).get(d.name.lower())).createOrReplaceTempView(d.name)


def measured_casts(spark: SparkSession, catalog: Catalog, folder: str) -> dict[str, dict[str, str]]:
    """dataset key -> column -> cast, for text columns of metrics whose every value one of the known number formats reads."""
    out: dict[str, dict[str, str]] = {}
    for d in catalog.datasets.values():
        columns = [c for c in d.columns if c.type == "string" and c.semantic == "metric" and not c.cast]
        if d.status != "active" or not columns:
            continue
        df = spark.read.parquet(*d.paths(spark, folder))
        forms = [f"TRY_CAST({{c}} AS DOUBLE)", "TRY_CAST(REPLACE(REPLACE({c}, '.', ''), ',', '.') AS DOUBLE)", "TRY_CAST(REPLACE({c}, ',', '') AS DOUBLE)"]
        tests = [F.sum(F.expr(f"CAST(NULLIF(TRIM({c.name}), '') IS NOT NULL AND {f.format(c=c.name)} IS NULL AS INT)")).alias(f"{c.name}_{i}") for c in columns for i, f in enumerate(forms)]
        row = df.agg(*tests).first()
        for c in columns:
            fits = next((f.format(c=c.name) for i, f in enumerate(forms) if row[f"{c.name}_{i}"] == 0), None)
            if fits:
                out.setdefault(d.key, {})[c.name] = fits
    return out


CACHE_VERSION = 1


def manifest(folder: Path) -> dict[str, str]:
    """Each contract file's name and the hash of what it holds."""
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(folder.glob("*.yaml"))}


def build_cache(folder: Path, path: Path) -> None:
    """The contracts as JSON, which is read many times faster, with the manifest of the files that they are of."""
    datasets = [asdict(d) for d in _loaded(folder).datasets.values()]
    path.write_text(json.dumps({"version": CACHE_VERSION, "manifest": manifest(folder), "count": len(datasets), "datasets": datasets}, default=str), encoding="utf-8")


def _cached(folder: Path, path: Path) -> Catalog | None:
    """The contracts of a cache that is of these very files; None where it is not, or cannot be read."""
    try:
        raw = json.loads(path.read_text(encoding="utf-8"))
        if raw["version"] != CACHE_VERSION or raw["manifest"] != manifest(folder) or raw["count"] != len(raw["datasets"]):
            return None
        return _catalog(raw["datasets"])
    except (OSError, ValueError, KeyError, TypeError):
        return None


def _catalog(raws: list[dict]) -> Catalog:
    out = {}
    for raw in raws:
        d = Dataset(**raw | {"columns": [Column(**c) for c in raw["columns"]], "metrics": [Metric(**m) for m in raw["metrics"]]})
        out[d.key] = d
    return Catalog(out)


def _loaded(folder: Path) -> Catalog:
    import yaml

    raws = []
    for path in sorted(folder.glob("*.yaml")):
        for raw in yaml.load(path.read_text(encoding="utf-8"), getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            if unknown := set(raw) - _KNOWN:
                raise ValueError(f"{path.name}: unknown properties {sorted(unknown)}")
            raws.append(raw)
    return _catalog(raws)


@functools.lru_cache(maxsize=8)
def _load(folder: Path, cache: Path | None, _: str) -> Catalog:
    return (_cached(folder, cache) if cache else None) or _loaded(folder)


def load(folder: Path = CONTRACTS, cache: Path | None = None) -> Catalog:
    """The contracts of a folder, from the JSON cache where this is of the same files; read once while the files stay the same."""
    return _load(folder, cache, json.dumps(manifest(folder)))
