"""Guard, pruning, paging, typing, search, limits."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from veridex import registry
from veridex.operators import search
from veridex.operators.engine import Engine, RateLimiter, markdown, shares
from veridex.plans import guard, typing, years
from veridex.sources import catalog, files


@pytest.fixture(scope="module")
def engine(spark, sf):
    return Engine(spark, sf)


GOOD = [
    "SELECT 1 AS a", "SELECT * FROM orders a, lineitem b WHERE a.o_orderkey = b.l_orderkey", "WITH t AS (SELECT * FROM orders) SELECT count(*) FROM t", "DESCRIBE SELECT * FROM orders", "-- note\nSELECT count(*) FROM orders",
    "SELECT * FROM range(10)", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 3", "SELECT a.* FROM orders a JOIN customer ON c_custkey = o_custkey", "SELECT o_orderkey FROM orders UNION SELECT l_orderkey FROM lineitem", "SELECT 'DROP TABLE x' AS s",
    "WITH orders AS (SELECT o_orderkey FROM orders) SELECT * FROM orders", "SELECT sequence(1, 5) AS s", "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' - INTERVAL 400 DAY", "SELECT \"o_orderkey\" FROM orders QUALIFY rank() OVER (ORDER BY o_totalprice) = 1",
]
BAD = [
    "DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM range(100000000)", "SELECT * FROM range(10000 * 10000)", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT * FROM orders a ASOF JOIN lineitem b",
    "WITH RECURSIVE t AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t) SELECT * FROM t", "SELECT * FROM other", "INSERT INTO orders SELECT 1", "SELECT * FROM orders, lineitem, customer", "SHOW TABLES", "SELECT 1000000000000000", "SET x = 1", "SELECT current_user()", "SELEC 1", "SELECT * FROM read_files('x')", "",
]


@pytest.mark.parametrize("sql", GOOD)
def test_allowed(engine, sql):
    engine.query(sql)


@pytest.mark.parametrize("sql", BAD)
def test_rejected(engine, sql):
    with pytest.raises(guard.Rejected):
        engine.query(sql)


def test_size_is_checked_first(engine):
    with pytest.raises(guard.Rejected, match="characters"):
        engine.query("SELECT " + "1," * guard.MAX_CHARS + "1")


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'", {1996}),
        ("o_orderdate BETWEEN '1996-03-01' AND '1997-02-01'", {1996, 1997}),
        ("year(o_orderdate) = 1997", {1997}),
        ("EXTRACT(YEAR FROM o_orderdate) IN (1996, 1998)", {1996, 1998}),
        ("'1996-01-01' <= o_orderdate AND o_orderdate <= '1996-12-31'", {1996}),
        ("o_orderdate >= '1996-01-01'", None),
        ("year(o_orderdate) = 1997 OR o_totalprice > 3", None),
        ("NOT year(o_orderdate) = 1997", None),
        ("o_orderdate >= '1996-01-01T00:00:00Z' AND o_orderdate < '1997-01-01'", None),
        ("o_custkey = 1996 AND year(o_orderdate) = 1997", None),
    ],
)
def test_years(engine, where, want):
    assert engine.years(f"SELECT count(*) FROM orders WHERE {where}") == want


def test_pruned_equals_full(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    paths = []
    for y in range(1995, 2002):
        part = orders.where(f"year(o_orderdate) = {y}").toPandas()
        paths.append(str(tmp_path / f"ORDERS_{y}.parquet"))
        part.to_parquet(paths[-1], coerce_timestamps="us")
    where = "o_orderdate >= '1996-08-01' AND o_orderdate < '1998-01-01'"
    orders.createOrReplaceTempView("orders")
    found = years.proven(guard.parsed(spark, f"SELECT * FROM orders WHERE {where}"), "o_orderdate")
    kept = files.prune_paths(paths, found)
    assert [files.year_of(p) for p in kept] == [1996, 1997]
    assert spark.read.parquet(*kept).where(where).count() == orders.where(where).count()
    assert files.only_years(spark.read.parquet(*paths), found).where(where).count() == orders.where(where).count()
    assert files.prune_paths(paths, {1990}) == paths  # a year without a file


def test_union_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "1,5")], "a int, v string").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(2, 2.5, True)], "a long, v double, c boolean").write.parquet(str(tmp_path / "y"))
    df = files.union_by_name(spark, [str(tmp_path / "x"), str(tmp_path / "y")])
    assert df.dtypes == [("a", "bigint"), ("v", "string"), ("c", "boolean")]
    assert sorted(map(tuple, df.collect())) == [(1, "1,5", None), (2, "2.5", True)]


def test_pages(engine):
    r = engine.execute("SELECT id AS x FROM range(500) ORDER BY id", limit=10, offset=480)
    assert [x[0] for x in r.rows] == list(range(480, 490)) and r.truncated and r.next_offset == 490
    r = engine.execute("SELECT id AS x FROM range(500) ORDER BY id", limit=10, offset=490)
    assert len(r.rows) == 10 and not r.truncated
    assert len(engine.execute("SELECT id FROM range(5000)", limit=99_999).rows) == 1000
    assert "|" in r.text()


def test_deadline(engine):
    with pytest.raises(TimeoutError):
        engine.execute("SELECT count(*) FROM range(10000000) a JOIN range(10000000) b ON a.id % 7 = b.id % 7", seconds=1)


def test_text_sum(engine):
    with pytest.raises(guard.Rejected, match="o_orderstatus"):
        engine.execute("SELECT sum(o_orderstatus) AS s FROM orders")
    with pytest.raises(guard.Rejected, match="o_orderstatus"):
        engine.query("SELECT avg(CASE WHEN o_custkey > 3 THEN o_orderstatus END) AS s FROM orders")
    engine.query("SELECT sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS s, sum(TRY_CAST(o_orderstatus AS DOUBLE)) AS t FROM orders")


def types(engine, sql):
    return {c["name"]: c for c in engine.execute(sql).schema["columns"]}


def test_typing(engine):
    t = types(engine, "SELECT o_orderstatus, SUM(o_totalprice) AS s, AVG(o_totalprice) AS m, COUNT(DISTINCT o_custkey) AS d, 100.0 * SUM(o_totalprice) / COUNT(o_custkey) AS p, SUM(o_totalprice * 2) AS f FROM orders GROUP BY 1")
    assert (t["s"]["unit"], t["s"]["additive"], t["s"]["metric"]) == ("USD", True, "order_value")
    assert (t["m"]["unit"], t["m"]["additive"]) == ("USD", False)
    assert (t["d"]["unit_tier"], t["d"]["additive"]) == ("count", False)
    assert t["p"]["role"] == "ratio" and t["p"]["unit"] == "%"
    assert t["f"]["unit"] is None
    assert types(engine, "SELECT SUM(c_acctbal) AS s FROM customer")["s"]["additive"] is False
    assert types(engine, "SELECT o_totalprice AS x FROM orders UNION ALL SELECT l_quantity FROM lineitem")["x"]["unit"] is None
    assert types(engine, "SELECT SUM(o_totalprice) OVER (PARTITION BY o_orderstatus) AS w FROM orders")["w"]["additive"] is False
    energy = types(engine, "SELECT SUM(value * 0.5) / 1000 AS e FROM events")["e"]
    assert (energy["unit"], energy["unit_tier"]) == ("GWh", "mode_ast")
    assert types(engine, "SELECT CAST(NULL AS DOUBLE) AS n, o_orderkey FROM orders LIMIT 3")["n"]["all_null"]


def test_routes_sources_notes(engine):
    r = engine.execute("SELECT o_orderdate, SUM(o_totalprice) AS total FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-02-01' GROUP BY o_orderdate")
    assert r.schema["route"] == {"tier": "pattern", "pattern": "sales/orders.value_between"}
    assert r.sources == [{"dataset": "sales/orders", "url": "https://example.org/orders"}]
    r = engine.execute("SELECT SUM(value * 2) / 1000 AS e FROM events")
    assert r.schema["route"]["tier"] == "adhoc" and "0.5 h" in r.notes[0]
    r = engine.execute("SELECT o_orderstatus, SUM(o_totalprice) AS total FROM orders GROUP BY 1")
    assert r.notes[0].startswith("Shares of the total")


def test_shares_gates():
    t = [{"role": "dimension", "additive": None}, {"role": "measure", "additive": True}]
    assert shares(["a", "v"], [("x", 300.0), ("y", 100.0)], t) == [0.75, 0.25]
    assert shares(["a", "v"], [("x", 300.0), ("y", -1.0)], t) is None
    assert shares(["a", "v"], [("x", 3.0), ("y", 1.0)], t) is None
    assert shares(["a", "v"], [("x", 300.0)], t) is None


def test_additivity():
    m = catalog.Metric
    assert typing.additive(m("a", [], "energy", default="sum")) is True
    assert typing.additive(m("a", [], "energy", forbidden=["sum"])) is False
    assert typing.additive(m("a", [], "price", default="sum")) is False
    assert typing.additive(m("a", [], "average_power", default="sum")) is None
    assert typing.additive(m("a", [], "energy", unit="%")) is False


def test_rate_limit():
    now = [0.0]
    limiter = RateLimiter(per_minute=3, total=5, burst=3, clock=lambda: now[0])
    assert [limiter.allow("a")[0] for _ in range(4)] == [True, True, True, False]
    now[0] = 2
    assert not limiter.allow("a")[0] and limiter.allow("b")[0] and limiter.allow("b")[0] and not limiter.allow("c")[0]
    now[0] = 61.5
    assert limiter.allow("a")[0]


def test_bm25_is_brute_force(spark):
    docs = {1: "Load of the region, load curve", 2: "Região e carga", 3: "carga carga", 4: "", 5: None, 6: "the load"}
    df = spark.createDataFrame(list(docs.items()), "k int, t string")

    def terms(t):
        w = re.findall(r"[a-z0-9]{2,}", search.plain(t or ""))
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    q = list(dict.fromkeys(terms("load carga região")))
    own = {k: Counter(terms(t)) for k, t in docs.items()}
    mean = sum(sum(c.values()) for c in own.values()) / len(own)

    def score(c):
        return sum(math.log(1 + (len(own) - (n := sum(1 for x in own.values() if x[w])) + 0.5) / (n + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.6 + 0.4 * sum(c.values()) / mean)) for w in q if c[w])

    want = {k: score(c) for k, c in own.items() if score(c) > 0}
    top = max(want.values())
    assert {r["k"]: r["score"] for r in search.bm25(df, "k", "t", "load carga região", 10).collect()} == {k: round(s / top, 4) for k, s in want.items()}
    assert search.bm25(df, "k", "t", "", 3).count() == 0


def test_rank_and_lookup(spark, engine):
    best = search.rank(spark, engine.catalog, "monthly orders revenue")
    assert best[0][0] == "sales/orders" and "sales/old_orders" not in dict((k, s) for k, s, _ in best)
    assert engine.catalog.find("ORDERS").key == "sales/orders" and engine.catalog.find("old-orders").key == "sales/old_orders" and engine.catalog.find("none") is None
    assert "grain" in engine.describe("orders").lower() and engine.list_datasets().count() == 9


def test_markdown():
    assert markdown(["a"], [(None,), ("x|y",)]) == "| a |\n|-|\n|  |\n| x\\|y |"


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 1 / 0 AS a, -1 / 0 AS b, 0 / 0 AS c, 6 / 4 AS d, 7 // 2 AS e, CAST(NULL AS DOUBLE) / 0 AS f", [(math.inf, -math.inf, "nan", 1.5, 3, None)]),
        ("SELECT a / b AS x FROM (VALUES (8, 2), (1, 0), (NULL, 0), (3, NULL)) t(a, b) ORDER BY x", [(4.0,), (math.inf,), (None,), (None,)]),
        ("SELECT 2 * 6 / 3 / 2 AS a, 10 - 6 / 3 AS b, (1 + 2) / 4 AS c, CASE WHEN 1 / 2 < 1 THEN 3 END / 2 AS d", [(2.0, 8.0, 0.75, 1.5)]),
        ("SELECT x FROM (VALUES (2), (NULL), (1)) t(x) ORDER BY x DESC", [(2,), (1,), (None,)]),
        ("SELECT x FROM (VALUES (2), (NULL), (1)) t(x) ORDER BY x LIMIT 2", [(1,), (2,)]),
        ("SELECT x FROM (VALUES (2), (NULL), (1)) t(x) ORDER BY x NULLS FIRST LIMIT 1", [(None,)]),
        ("SELECT dayofweek(DATE '2024-01-07') AS a, extract(dow FROM DATE '2024-01-08') AS b, strftime(DATE '2024-03-05', 'on %d.%m.%Y, it''s') AS c", [(0, 1, "on 05.03.2024, it's")]),
        ("SELECT datediff('month', DATE '2024-01-31', DATE '2024-02-01') AS a, date_diff('year', DATE '2023-12-31', DATE '2024-01-01') AS b", [(1, 1)]),
        ("SELECT 'it''s' AS a, regexp_extract('ab12', '\\d+') AS b, 'a\\\\' AS c", [("it's", "12", "a\\\\")]),
        ("SELECT strip_accents('Ação, ñandú, Ệ, й') AS a, [1, 2][1] AS b, 'a\\d' AS c, 5::VARCHAR AS d", [("Acao, nandu, E, и", 2, "a\\d", "5")]),
        ("SELECT g, s FROM (VALUES ('a', 1), ('a', 3), ('b', 2)) t(g, s) QUALIFY s = max(s) OVER (PARTITION BY g) ORDER BY g", [("a", 3), ("b", 2)]),
        ("SELECT string_agg(s, '-' ORDER BY s DESC) AS a, arg_max(s, k) AS b FROM (VALUES ('x', 1), ('y', 0)) t(s, k)", [("y-x", "x")]),
    ],
)
def test_dialect(engine, sql, want):
    got = [tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in engine.query(sql).collect()]
    assert got == want


def test_accents_are_duckdbs(engine):
    import duckdb

    text = "".join(chr(c) for c in range(0x20, 0x2000) if chr(c).isprintable() and chr(c) not in "'\\")
    want = duckdb.execute("SELECT strip_accents(?)", [text]).fetchone()[0]
    assert engine.query("SELECT strip_accents('" + text.replace("'", "''") + "') AS a").first()["a"] == want


def test_engines_do_not_see_each_other(spark, sf):
    small, large = Engine(spark, sf), Engine(spark, sf.replace("0.001", "0.01"))
    n = [e.query("SELECT count(*) AS n FROM orders").first()["n"] for e in (small, large, small)]
    assert n[0] == n[2] < n[1] and not spark.catalog.tableExists("orders_of_engine")


def test_pruning_of_statements(spark, sf):
    e = registry.year_files(spark, sf)
    p = e.prepare(registry.PRUNED)
    assert p.years == {1996, 1997} and [files.year_of(f) for f in p.files] == [1996, 1997]
    assert sorted(files.year_of(f) for f in p.df.inputFiles() for f in [f.rsplit("/", 1)[0]]) and {files.year_of(f.rsplit("/", 1)[0]) for f in p.df.inputFiles()} == {1996, 1997}
    full = e.prepare(registry.UNPRUNED)
    assert full.years is None and len(full.files) > 2 and sorted(full.df.collect()) == sorted(p.df.collect())
    glob = e.prepare(f"SELECT count(*) AS n FROM read_parquet('{e.folder}/ORDERS_*.parquet', union_by_name = true) WHERE strftime(o_orderdate, '%Y') = '1996'")
    assert glob.years == {1996} and len(glob.files) == 1 and glob.datasets == ["sales/orders"]
    assert glob.df.first()["n"] == e.query("SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1996").first()["n"]


def test_what_a_statement_reads(engine, sf):
    assert engine.prepare("SELECT count(*) AS n FROM orders").datasets == ["sales/orders"]
    assert engine.prepare("SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)").datasets == ["sales/customer", "sales/orders"]
    assert engine.prepare(f"SELECT count(*) AS n FROM read_parquet('{sf}/events.parquet')").datasets == ["web/events"]
    assert engine.catalog.of_path("https://files.example.org/orders/ORDERS_1997.parquet", sf).key == "sales/orders"
    assert engine.catalog.of_path("https://files.example.org/orders/x/ORDERS_1997.parquet", sf) is None
    r = engine.execute("SELECT count(*) AS n FROM orders")
    assert r.sources == [{"dataset": "sales/orders", "url": "https://example.org/orders"}] and "Today is" in r.text()


def test_places():
    p = files.Places(("/data/x", "s3://Bucket/p/"), ("example.org",))
    for good in ("/data/x/a.parquet", "file:///data/x/a", "s3://bucket/p/q", "https://a.example.org/x.csv", "https://EXAMPLE.org/x"):
        p.check(good)
    for bad in ("/data/xy/a", "/data/x/../y", "/data/x/{..,b}/c", "s3://bucket/P/q", "s3://bucket/other", "https://example.org.evil/x", "https://u@example.org/x", "https://example.org:8/x", "https://example.org/x?y", "https://[::1]/x", "http://example.org/x", "https://evil.example/#.example.org/x", "/data/x/a\nb"):
        with pytest.raises(ValueError):
            p.check(bad)


def test_listing_and_fetching(spark, tmp_path):
    import io

    (tmp_path / "a_1999.csv").write_text("k\n1\n")
    now = [0.0]
    assert len(files.listed(spark, f"{tmp_path}/*.csv", clock=lambda: now[0])) == 1
    (tmp_path / "a_2000.csv").write_text("k\n2\n")
    assert len(files.listed(spark, f"{tmp_path}/*.csv", clock=lambda: now[0])) == 1
    now[0] = 601
    assert len(files.listed(spark, f"{tmp_path}/*.csv", clock=lambda: now[0])) == 2
    asked = []

    def open_url(request, timeout):
        asked.append(request)
        return io.BytesIO(b"k;v\n1;x\n2;y\n")

    for _ in range(2):
        where = files.fetched(spark, "https://files.example.org/d/t.csv", open_url=open_url, clock=lambda: 0.0)
    assert len(asked) == 1 and asked[0].get_header("User-agent") == files.AGENT
    assert files.read(spark, "csv", [where], {"delim": ";"}).count() == 2
    with pytest.raises(ValueError):
        files.read(spark, "csv", [where], {"evil": "1"})
    files.anonymous_s3(spark, "storage.example.org", "x-1")
    assert "Anonymous" in spark._jsc.hadoopConfiguration().get("fs.s3a.aws.credentials.provider")


def test_modes_by_meaning(engine):
    spelled = types(engine, "WITH t AS (SELECT e.value AS v, e.event_type AS k FROM events e) SELECT k, (SUM(0.5 * v)) / 1000.0 AS energy, SUM(v * 0.25) / 1000 AS other FROM t GROUP BY k")
    assert (spelled["energy"]["unit"], spelled["energy"]["unit_tier"], spelled["energy"]["mode"]) == ("GWh", "mode_ast", "total_energy")
    assert spelled["other"]["unit"] is None
    t = types(engine, "SELECT SUM(o_totalprice) / SUM(o_custkey) AS r, strftime(o_orderdate, '%Y-%m') AS m, COUNT(*) * 0.5 AS my_pct FROM orders GROUP BY 2")
    assert t["r"]["role"] == "ratio" and t["r"]["unit_tier"] == "ast_share" and t["m"]["role"] == "temporal" and t["my_pct"]["role"] != "temporal"
    t = types(engine, "SELECT o_orderpriority, SUM(o_totalprice) * 1 AS total FROM orders GROUP BY o_orderpriority")
    assert (t["total"]["unit"], t["total"]["unit_tier"]) == ("USD", "pattern_output_unit")


def test_casts_are_recognised(spark, tmp_path):
    spark.createDataFrame([(1, "1.234,5"), (2, "7,25"), (3, None), (4, "")], "k long, v string").write.parquet(str(tmp_path / "texts.parquet"))
    raw = {"name": "texts", "owner": "web", "title": "T", "status": "active", "tags": [], "context": "", "grain": {}, "columns": [catalog.Column("k", "bigint", "identifier"), catalog.Column("v", "string", "metric", "kg")], "metrics": [catalog.Metric("w", ["v"], "flow", "kg", "sum")]}
    plain = catalog.Catalog({"web/texts": catalog.Dataset(**raw)})
    casts = catalog.measured_casts(spark, plain, str(tmp_path))
    assert list(casts) == ["web/texts"] and "','" in casts["web/texts"]["v"]
    e = Engine(spark, str(tmp_path), plain.with_casts(casts))
    assert e.query("SELECT SUM(v) AS s FROM texts").first()["s"] == 1241.75
    with pytest.raises(guard.Rejected):
        Engine(spark, str(tmp_path), plain).query("SELECT SUM(v) AS s FROM texts")


def test_contract_cache(tmp_path):
    from pathlib import Path

    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "x.yaml").write_text(Path(catalog.CONTRACTS / "fixtures.yaml").read_text())
    cache = tmp_path / "cache.json"
    catalog.build_cache(folder, cache)
    assert catalog._cached(folder, cache) == catalog.load(folder) == catalog.load(folder, cache)
    (folder / "x.yaml").write_text((folder / "x.yaml").read_text() + "\n# changed\n")
    assert catalog._cached(folder, cache) is None and catalog.load(folder, cache) == catalog.load(folder)
    cache.write_text("{broken")
    assert catalog._cached(folder, cache) is None


def test_service(spark, sf):
    import json
    import threading
    import urllib.request

    from veridex.operators.http import server
    from veridex.operators.telemetry import Telemetry, error_class, redacted

    lines = []
    e = Engine(spark, sf, telemetry=Telemetry(lines.append))
    assert e.submit("SELECT count(*) AS n FROM orders WHERE o_orderpriority <> 'jo@example.org'").result().rows
    with pytest.raises(guard.Rejected):
        e.execute("DROP TABLE x")
    told = [json.loads(x) for x in lines]
    assert [t["result"] for t in told] == ["ok", "rejected"] and "jo@" not in lines[0] and e.health()["calls"] == {"execute:ok": 1, "execute:rejected": 1}
    assert redacted("password=abc 4539148803436467") == "password=<secret> <number>" and error_class(TimeoutError()) == "timeout"
    s = server(e)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    for path, want in (("health", "ok"), ("datasets", "sales/orders")):
        assert want in urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/{path}").read().decode()
    s.shutdown()
    assert "coverage:" in e.describe("orders", coverage=True) and "example:" in e.describe("orders")
    assert e.others("monthly orders revenue", "web")[0][1].startswith("sales/") and "orders" in e.search("monthly orders revenue").first()["matched"]


def test_retries_what_fails_by_the_network(engine, monkeypatch):
    from veridex.operators import engine as module

    calls = []

    def flaky(df, seconds):
        calls.append(seconds)
        if len(calls) == 1:
            raise RuntimeError("Connection reset by peer")
        return df.collect()

    monkeypatch.setattr(module, "PAUSE", 0.01)
    monkeypatch.setattr(engine, "_within", flaky)
    assert engine.execute("SELECT 1 AS a").rows and len(calls) == 2


def test_rate_limit_forgets_the_oldest_caller():
    now = [0.0]
    limiter = RateLimiter(per_minute=2, total=100, burst=2, keys=2, clock=lambda: now[0])
    assert all(limiter.allow(k)[0] for k in "aabbcc") and not limiter.allow("c")[0]
    assert len(limiter.calls) == 2 and limiter.allow("a")[0]  # a was forgotten


def test_catalog_index_is_bm25():
    texts = {"a": "load of the region", "b": "region and load load", "c": "other words"}
    found = search.index_of(texts).search("load region", 5)
    assert [k for k, _ in found] == ["b", "a"] and found[0][1] == 1.0 and search.index_of(texts) is search.index_of(dict(texts)) is not search.index_of(texts | {"d": "x"})
