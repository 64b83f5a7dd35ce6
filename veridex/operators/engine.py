"""Governed execution: guard, file pruning, paging, deadline, typed and cited results."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections import OrderedDict, deque
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.operators import search
from veridex.operators.telemetry import Telemetry
from veridex.plans import dialect, guard, typing, years
from veridex.sources import files
from veridex.sources.catalog import Catalog, load

PAGE, MAX_PAGE, SECONDS = 100, 1000, 30.0
#: Threads of submit(), and seconds before a second try.
THREADS, PAUSE = 8, 1.5
#: Settings of the session that statements run in: quoted names, times without a zone.
CONF = {"spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}
_TRANSIENT = re.compile(r"connection (reset|refused|closed)|timed? ?out|slow ?down|service unavailable|unknownhost|temporar", re.IGNORECASE)


class RateLimiter:
    """At most `per_minute` calls in 60 s and `burst` in a second for a key, and `total` in 60 s for all; of more than `keys` callers the one that called longest ago is forgotten."""

    def __init__(self, per_minute: int = 60, total: int = 600, burst: int = 20, keys: int = 20_000, clock=time.monotonic):
        self.per_minute, self.total, self.burst, self.keys, self.clock = per_minute, total, burst, keys, clock
        self.calls: OrderedDict[str, deque] = OrderedDict()  # in the order of the latest call
        self.all: deque = deque()
        self.lock = threading.Lock()

    def allow(self, key: str) -> tuple[bool, str]:
        with self.lock:
            now, key = self.clock(), key[:256]
            own = self.calls.get(key) or deque()
            for times in (self.all, own):
                while times and times[0] <= now - 60:
                    times.popleft()
            if sum(1 for t in own if t > now - 1) >= self.burst:
                return False, "too many queries at once"
            if len(self.all) >= self.total or len(own) >= self.per_minute:
                return False, "too many queries a minute"
            own.append(now)
            self.all.append(now)
            self.calls[key] = own
            self.calls.move_to_end(key)
            while len(self.calls) > self.keys:
                self.calls.popitem(last=False)
            return True, ""


def markdown(columns: list[str], rows: list) -> str:
    def cell(v: object) -> str:
        return "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def shares(columns: list[str], rows: list, types: list[dict]) -> list[float] | None:
    """Each row's part of the total of the one measure, where that means something: 2-12 complete rows, all positive."""
    measure = [i for i, t in enumerate(types) if rows and isinstance(rows[0][i], (int, float)) and not isinstance(rows[0][i], bool) and t["role"] == "measure"]
    dimension = [i for i, t in enumerate(types) if t["role"] == "dimension"]
    if not 2 <= len(rows) <= 12 or len(measure) != 1 or not dimension or types[measure[0]]["additive"] is not True:
        return None
    values = [r[measure[0]] for r in rows]
    if any(v is None or v <= 0 for v in values) or max(values) <= 100:
        return None
    return [v / sum(values) for v in values]


def today(now: datetime | None = None, zone: str = "UTC") -> str:
    """The footer that tells what relative times in a question mean."""
    now = now or datetime.now(timezone.utc)
    return f"Today is {now:%Y-%m-%d}, yesterday was {now - timedelta(days=1):%Y-%m-%d}; it is {now:%H:%M} UTC. Times of the data are in {zone}."


@dataclass
class Result:
    columns: list[str]
    rows: list
    truncated: bool
    next_offset: int | None
    schema: dict
    sources: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def text(self) -> str:
        out = [markdown(self.columns, self.rows) if self.rows else "No rows.", *self.notes]
        if self.truncated:
            out.append(f"More rows from offset {self.next_offset}.")
        return "\n\n".join([*out, today(), "```json\n" + json.dumps({"result": self.schema, "sources": self.sources}, default=str) + "\n```"])


@dataclass
class Prepared:
    """A statement that passed the guard: its DataFrame, and what it reads."""

    df: DataFrame
    sql: str
    datasets: list[str]
    files: list[str]
    #: Years that the files were pruned to; None where nothing is proven.
    years: set[int] | None


class Engine:
    """The service: list, search, describe, execute.

    Each statement runs in a session of its own, so neither engines nor statements see each other's views. Statements read the
    catalog's datasets, and files of `places` through readers; by default those are the files of the engine's folder.
    """

    def __init__(self, spark: SparkSession, folder: str, catalog: Catalog | None = None, limiter: RateLimiter | None = None, places: files.Places | None = None, telemetry: Telemetry | None = None):
        self.spark, self.folder, self.catalog, self.limiter = spark, folder.rstrip("/"), catalog or load(), limiter
        self.places = places or files.Places((folder,))
        self.telemetry = telemetry or Telemetry()
        self._pool: ThreadPoolExecutor | None = None

    def session(self) -> SparkSession:
        out = self.spark.newSession()
        out.conf.set("spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions"))
        for key, value in CONF.items():
            out.conf.set(key, value)
        return out

    def list_datasets(self, owner: str | None = None) -> DataFrame:
        return self.spark.createDataFrame(self.catalog.listing(owner), "key string, title string")

    def search(self, question: str, top: int = 10, owner: str | None = None) -> DataFrame:
        """(key, score, band, matched) of the best datasets; matched: words of the question that the dataset has."""
        return self.spark.createDataFrame(search.ranked(self.catalog, question, top, owner), "key string, score long, band string, matched array<string>")

    def others(self, question: str, owner: str) -> list[tuple[str, str]]:
        """(owner, key) of the best dataset of each other owner."""
        found = [(o, search.ranked(self.catalog, question, 1, o)) for o in sorted({d.owner for d in self.catalog.datasets.values() if d.status == "active"} - {owner})]
        return [(o, r[0][0]) for o, r in found if r]

    def describe(self, name: str, coverage: bool = False) -> str:
        """The contract as Markdown; coverage: also which times the files hold."""
        d = self.catalog.find(name)
        if not d:
            return f"No dataset {name}."
        if not coverage or d.status != "active" or not d.grain.get("temporal_column"):
            return d.describe()
        r = self.freshness([d.key]).first()
        return d.describe() + f"\n- coverage: {r['first']} to {r['last']}, {r['rows']} rows"

    def freshness(self, keys: list[str] | None = None) -> DataFrame:
        """(dataset, first, last, rows) of the datasets with a time column, in one job."""
        out = None
        for d in self.catalog.datasets.values():
            t = d.grain.get("temporal_column")
            if d.status == "active" and t and (keys is None or d.key in keys):
                df = d.scan(self.spark, self.folder).agg(F.min(t).cast("timestamp_ntz").alias("first"), F.max(t).cast("timestamp_ntz").alias("last"), F.count("*").alias("rows")).select(F.lit(d.key).alias("dataset"), "first", "last", "rows")
                out = df if out is None else out.unionAll(df)
        return out if out is not None else self.spark.createDataFrame([], "dataset string, first timestamp_ntz, last timestamp_ntz, rows long")

    def health(self) -> dict:
        return {"status": "ok", "datasets": len(self.catalog.listing()), "spark": self.spark.version, "calls": {f"{c}:{r}": n for (c, r), n in self.telemetry.counts.items()}}

    def datasets(self) -> list[dict]:
        return [{"key": k, "title": t, "url": self.catalog.datasets[k].portal_url} for k, t in self.catalog.listing()]

    def prepare(self, sql: str) -> Prepared:
        """The statement after rewriting, guard and analysis, over the files that it can need."""
        session = self.session()
        read: list[tuple[str, str, list[str], dict[str, str]]] = []  # view, kind, paths as written, options

        def reader(name: str, args: list[list]) -> str:
            paths = self._literals(args[0] if args else [])
            options = {}
            for a in args[1:]:
                if len(a) != 3 or a[1].text not in ("=", ":=", "=>") or a[2].kind not in ("word", "string", "number"):
                    raise guard.Rejected("a reader's options are names with a literal each")
                options[a[0].word] = dialect.literal(a[2]) if a[2].kind == "string" else a[2].text
            try:
                paths = [self.places.check(p) for p in paths]
            except ValueError as e:
                raise guard.Rejected(str(e)) from None
            read.append((f"reader_{len(read)}__", dialect.READERS[name], paths, options))
            return read[-1][0]

        text = guard.rewritten(sql, reader)
        allowed = {d.name for d in self.catalog.datasets.values() if d.status == "active"}
        tree = guard.check(session, text, allowed, {r[0] for r in read}, prechecked=True)
        names = set(guard.relations(tree))
        used = [d for d in self.catalog.datasets.values() if d.status == "active" and d.name.lower() in names]
        behind = [d for r in read for p in r[2] if (d := self.catalog.of_path(p, self.folder)) is not None]
        keys = {d.key for d in [*used, *behind]}
        pruned = None
        # Files are pruned where the statement reads one dataset, by its name or by one glob.
        one = used[0] if len(names) == 1 and used else behind[0] if len(names) == len(read) == len(behind) == 1 and len(read[0][2]) == 1 else None
        if one is not None and one.prune == "year":
            pruned = years.proven(tree, one.grain["temporal_column"])
        listed: list[str] = []
        for d in used:
            listed += d.paths(session, self.folder, pruned)
        self.catalog.register(session, self.folder, names, {one.name.lower(): pruned} if one else None)
        for view, kind, paths, options in read:
            found = []
            for p in paths:
                if p.lower().startswith("https://"):
                    found.append(files.fetched(session, p))
                else:
                    found += files.listed(session, p) if re.search(r"[*?\[{]", p) else [p]
            found = files.prune_paths(found, pruned)
            if not found:
                raise guard.Rejected("no file has this name")
            listed += found
            try:
                files.read(session, kind, found, options).createOrReplaceTempView(view)
            except ValueError as e:
                raise guard.Rejected(str(e)) from None
        df = session.sql(text)
        if bad := typing.text_sums(df, tree):
            raise guard.Rejected(f"{', '.join(bad)} is text; cast it before summing")
        return Prepared(df, text, sorted(keys), listed, pruned)

    @staticmethod
    def _literals(arg: list) -> list[str]:
        """The paths of a reader: a string literal, or a list of them."""
        if len(arg) == 1 and (p := dialect.literal(arg[0])) is not None:
            return [p]
        items = arg[0].items if len(arg) == 1 and isinstance(arg[0], dialect.Group) and arg[0].open == "[" else dialect.tokens(arg[0].text[6:-1]) if len(arg) == 1 and arg[0].kind == "code" and arg[0].text.startswith("array(") else []
        found = [dialect.literal(x) for x in items if x.text != ","]
        if not found or None in found:
            raise guard.Rejected("a reader's paths are string literals")
        return found

    def query(self, sql: str) -> DataFrame:
        """The statement as a DataFrame, after the guard; files of years that it cannot need are not listed."""
        return self.prepare(sql).df

    def years(self, sql: str) -> set[int] | None:
        """Years of files that the statement can need, of the one dataset that it reads."""
        tree = guard.parsed(self.spark, guard.rewritten(sql))
        names = set(guard.relations(tree))
        d = self.catalog.find(names.pop()) if len(names) == 1 else None
        return years.proven(tree, d.grain["temporal_column"]) if d and d.prune == "year" else None

    def execute(self, sql: str, limit: int = PAGE, offset: int = 0, seconds: float = SECONDS, caller: str = "") -> Result:
        return self.telemetry.told("execute", lambda: self._execute(sql, limit, offset, seconds, caller), sql=sql, limit=limit, offset=offset)

    def submit(self, sql: str, **about) -> Future:
        """execute() in one of THREADS threads that are there already."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(THREADS, thread_name_prefix="veridex")
            for f in [self._pool.submit(time.sleep, 0.01) for _ in range(THREADS)]:
                f.result()
        return self._pool.submit(self.execute, sql, **about)

    def _execute(self, sql: str, limit: int, offset: int, seconds: float, caller: str) -> Result:
        if self.limiter:
            ok, why = self.limiter.allow(caller)
            if not ok:
                raise guard.Rejected(why)
        limit, offset = max(1, min(limit, MAX_PAGE)), max(0, offset)
        p = self.prepare(sql)
        df = p.df
        page = self._retried(df.offset(offset).limit(limit + 1), seconds)
        rows, more = page[:limit], len(page) > limit
        route = self.route(sql)
        types = typing.columns(df, self.catalog, sql, rows)
        typing.pattern_unit(types, self._pattern(route))
        notes = self._unit_notes(sql)
        if not more and not offset and (part := shares(df.columns, rows, types)):
            notes.append("Shares of the total: " + ", ".join(f"{p:.1%}" for p in part))
        schema = {"query_id": hashlib.sha1(" ".join(sql.split()).encode()).hexdigest()[:12], "route": route, "datasets": p.datasets, "columns": types}
        sources = [{"dataset": k, "url": u} for k in p.datasets if (u := self.catalog.datasets[k].portal_url)]
        return Result(df.columns, rows, more, offset + limit if more else None, schema, sources, notes)

    def _pattern(self, route: dict) -> dict | None:
        return next((x for d in self.catalog.datasets.values() for x in d.patterns if route["pattern"] == f"{d.key}.{x['id']}"), None)

    def _retried(self, df: DataFrame, seconds: float) -> list:
        """Rows of df; what fails by the network is tried once more."""
        began = time.monotonic()
        try:
            return self._within(df, seconds)
        except TimeoutError:
            raise
        except Exception as e:
            if not _TRANSIENT.search(str(e)) or time.monotonic() - began + PAUSE >= seconds:
                raise
        time.sleep(PAUSE)
        return self._within(df, seconds - (time.monotonic() - began))

    def _within(self, df: DataFrame, seconds: float) -> list:
        """Rows of df; its jobs are cancelled after `seconds`."""
        sc, tag, out = self.spark.sparkContext, f"veridex-{uuid.uuid4().hex}", []

        def run() -> None:
            sc.addJobTag(tag)
            try:
                out.append(df.collect())
            except Exception as e:
                out.append(e)
            finally:
                sc.removeJobTag(tag)

        thread = InheritableThread(target=run, session=df.sparkSession)
        thread.start()
        thread.join(seconds)
        if thread.is_alive():
            sc.cancelJobsWithTag(tag)
            thread.join(10)
            raise TimeoutError(f"stopped after {seconds:g} s; a filter on the time column reads fewer files")
        if isinstance(out[0], Exception):
            raise out[0]
        return out[0]

    def route(self, sql: str) -> dict:
        """Whether the statement is a governed pattern, with literals only for its parameters."""
        text = " ".join(sql.strip().rstrip(";").split()).lower()
        value = r"('[^']*'|-?\d+(\.\d+)?|(date|timestamp) '[^']*')"
        for d in self.catalog.datasets.values():
            for p in d.patterns:
                shape = re.sub(r"\\\{\w+\\\}", lambda _: value, re.escape(" ".join(p["sql"].split()).lower()))
                if re.fullmatch(shape, text):
                    return {"tier": "pattern", "pattern": f"{d.key}.{p['id']}"}
        return {"tier": "adhoc", "pattern": None}

    def _unit_notes(self, sql: str) -> list[str]:
        """A literal interval that differs from the contract's."""
        found = re.findall(r"(\w+)\s*\*\s*(\d+(?:\.\d+)?)\s*\)\s*/\s*1000", sql)
        hours = {c: m.interval_hours for d in self.catalog.datasets.values() for m in d.metrics if m.interval_hours for c in m.columns}
        return [f"{c} holds intervals of {hours[c]:g} h, but the statement multiplies by {k}." for c, k in found if c in hours and float(k) != hours[c]]
