"""Stores: commits over several tables, refreshed tables, raw landing, embeddings, snapshots and paging."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyvane.operators import embedding, snapshots
from tallyvane.plans import embedding_job, jobs, refresh
from tallyvane.plans import run_store as rs
from tallyvane.sources import raw_zone
from tallyvane.sources.store import Store
from tallyvane.streaming import news_flow


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"a": "k bigint, v string", "b": "k bigint"})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commit_shows_all_tables_or_none(spark, store, monkeypatch):
    a, b = spark.createDataFrame([(1, "x")], "k bigint, v string"), spark.createDataFrame([(1,), (2,)], "k bigint")
    assert rows(store.read("a")) == [] and not store.is_done("one")
    bad = b.withColumn("k", F.when(F.col("k") == 2, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("k")))
    with pytest.raises(Exception, match="lost"):
        store.commit("one", "job", lambda: {"a": a, "b": bad})
    assert rows(store.read("a")) == [] and store.manifests().count() == 0  # a was written, but never committed
    assert store.commit("one", "job", lambda: {"a": a, "b": b}) == {"a": 1, "b": 2}
    assert rows(store.read("a")) == [(1, "x", "one")] and len(rows(store.read("b"))) == 2

    def never():
        raise AssertionError("a finished commit was computed again")

    assert store.commit("one", "job", never) == {}
    store.commit("two", "job", lambda: {"a": a.withColumn("v", F.lit("y"))})
    assert rows(store.latest("a", ["k"])) == [(1, "y", "two")] and store.next_name("n") == "n-000000000003"


def test_extra_columns_are_not_stored(spark, store):
    store.commit("one", "job", lambda: {"b": spark.createDataFrame([("z", 5)], "other string, k bigint")})
    assert rows(store.read("b")) == [(5, "one")]


def test_refresh_rewrites_only_what_moved(spark, tmp_path):
    table = refresh.KeyedTable(spark, str(tmp_path / "t"), "company_id bigint, total double", buckets=4)
    base = [(c, dt.datetime(2020, 1, d), float(c)) for c in range(20) for d in (1, 2)]
    make = lambda r: spark.createDataFrame(r, "company_id bigint, ts timestamp, x double")
    seen = []

    def run(r):
        df = make(r)

        def compute(keys):
            seen.append(sorted(k[0] for k in keys.collect()))
            return refresh.of(keys, df).groupBy("company_id").agg(F.sum("x").alias("total"))

        return refresh.refresh(table, refresh.newest(df), compute)

    assert run(base) == 20 and run(base) == 0
    folders = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").glob("bucket=*")}
    assert run(base + [(7, dt.datetime(2020, 1, 3), 100.0)]) == 1 and seen == [list(range(20)), [7]]
    after = {p.name: sorted(f.name for f in p.iterdir()) for p in (tmp_path / "t").glob("bucket=*")}
    assert sum(folders[b] != after[b] for b in folders) == 1  # one bucket of four was replaced
    got = {r["company_id"]: r["total"] for r in table.read().collect()}
    assert got == {c: 2.0 * c + (100 if c == 7 else 0) for c in range(20)}
    assert run([(None, dt.datetime(2021, 1, 1), 1.0)]) == 0


def test_raw_zone_keeps_what_it_cannot_read(spark, tmp_path):
    zone = raw_zone.raw_zone(spark, str(tmp_path / "raw"))
    day = dt.datetime(2024, 5, 1, 9)
    payloads = spark.createDataFrame([("p", "/e", day, '{"a": 1}'), ("p", "/e", day, "{cut"), ("p", "/e", day, None), ("q", "/f", day, "[1, 2]")],
                                     "provider string, endpoint string, retrieved_at timestamp, payload string")
    assert raw_zone.land(zone, "first", payloads) == 4 and raw_zone.land(zone, "first", payloads) == 0
    report = {r["provider"]: (r["landed"], r["bad"]) for r in raw_zone.landing_report(zone).collect()}
    assert report == {"p": (3, 2), "q": (1, 0)}
    opened = raw_zone.open_payloads(zone, "p", day.date()).select(F.try_variant_get("value", "$.a", "int").alias("a")).collect()
    assert sorted(str(r["a"]) for r in opened) == ["1", "None", "None"]
    assert raw_zone.open_payloads(zone, "p", dt.date(2020, 1, 1)).count() == 0


def test_embedding_job_resumes_and_isolates(spark, tmp_path):
    store = embedding_job.vector_store(spark, str(tmp_path / "v"))
    items = spark.createDataFrame([("news", i, "poison" if i == 3 else f"text {i}", {"entity_id": str(i)}) for i in range(12)]
                                  + [("news", 5, "text 5", None), ("event", 5, "  ", None), ("event", 6, None, None), ("event", 7, "other", None)],
                                  "entity_type string, entity_id bigint, content string, metadata map<string, string>")
    inner = embedding.hashing_encoder(8)

    def encoder(texts):
        if "poison" in texts:
            raise ValueError("no")
        return inner(texts)

    assert embedding_job.embed_missing(store, items.filter("entity_id < 4"), encoder, 8, chunk=4) == {"vectors": 3, "failures": 1}
    assert embedding_job.embed_missing(store, items, encoder, 8, slices=3) == {"vectors": 9, "failures": 0}
    assert embedding_job.embed_missing(store, items, encoder, 8) == {"vectors": 0, "failures": 0}
    # a mended text is tried again
    mended = items.withColumn("content", F.when(F.col("content") == "poison", "mended").otherwise(F.col("content")))
    assert embedding_job.embed_missing(store, mended, encoder, 8) == {"vectors": 1, "failures": 0}
    assert store.read("vectors").select("entity_type", "entity_id").distinct().count() == store.read("vectors").count() == 13


def test_snapshot_days_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "s")
    companies = spark.createDataFrame([(1, "A")], "company_id bigint, ticker string")
    scores = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), 0.0)], "company_id bigint, ts timestamp, overall_score double")
    bars = lambda n: spark.createDataFrame([(1, dt.datetime(2020, 1, d + 1), float(d), d) for d in range(n)],
                                           "company_id bigint, ts timestamp, close double, volume bigint")
    assert snapshots.stored_snapshots(spark, path).count() == 0
    first, second = F.lit(dt.datetime(2020, 1, 5, 6)), F.lit(dt.datetime(2020, 1, 9, 6))
    snapshots.write_snapshot(bars(3), scores, companies, first, path)
    snapshots.write_snapshot(bars(5), scores, companies, second, path)
    snapshots.write_snapshot(bars(8), scores, companies, F.lit(dt.datetime(2020, 1, 9, 18)), path)
    listed = {str(r["day"]): (r["bars"], r["as_of"].hour, r["scores"]) for r in snapshots.snapshot_list(snapshots.stored_snapshots(spark, path)).collect()}
    assert {d: (n, s) for d, (n, _, s) in listed.items()} == {"2020-01-05": (3, 1), "2020-01-09": (8, 1)}


def run_inputs(spark):
    companies = spark.createDataFrame([(i, f"S{i}", "tech" if i % 2 else "food") for i in range(4)], "company_id bigint, ticker string, sector string")
    day = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    bars = spark.createDataFrame([(i, day(d), 100.0 + i + d, 10) for i in range(4) for d in range(120)], "company_id bigint, ts timestamp, close double, volume bigint")
    scores = spark.createDataFrame([(i, day(3), 70.0, 20.0) for i in range(4)], "company_id bigint, ts timestamp, overall_score double, risk_score double")
    analyses = spark.createDataFrame([(9, 1, "completed", day(5), "bullish", 0.5, 2)],
                                     "analysis_id bigint, company_id bigint, status string, created_at timestamp, llm_direction string, llm_confidence double, evidence_count int")
    spec = lambda run, sector, bench, snap=None, lo=0: (run, "equal_weight", "queued", sector, day(lo), day(lo + 110), 1000.0, 21, 2, 5, 65.0,
                                                        "moderate", 0.5, 1.0, bench, snap)
    specs = spark.createDataFrame(
        [spec(1, None, "s1"), spec(2, "tech", "none"), spec(3, "food", "S0", dt.date(2020, 2, 1)), spec(4, "food", "S0", dt.date(2019, 1, 1)), spec(5, None, "S1", lo=5000)],
        "run_id bigint, strategy string, status string, sector string, start_date timestamp, end_date timestamp, initial_capital double, rebalance_days int, top_n int, "
        "lookback int, threshold double, risk_profile string, max_position_weight double, max_sector_weight double, benchmark_ticker string, snapshot_day date")
    pinned = bars.filter(F.col("ts") <= F.lit(dt.datetime(2020, 2, 1))).join(companies, "company_id").select(
        F.lit(dt.date(2020, 2, 1)).alias("snapshot_day"), "ticker", "ts", "close")
    return specs, bars, companies, scores, analyses, pinned


def test_run_store_and_detail(spark, tmp_path):
    store = rs.run_store(spark, str(tmp_path / "runs"))
    specs, *inputs = run_inputs(spark)
    first = rs.execute_queue(store, specs.filter("run_id < 3"), *inputs)
    assert first["runs"] == 2 and rs.execute_queue(store, specs.filter("run_id < 3"), *inputs) == {}
    assert rs.execute_queue(store, specs, *inputs)["runs"] == 3
    status = {r["run_id"]: (r["status"], r["error_message"], r["benchmark_source"], r["coverage_mode"]) for r in store.read("runs").collect()}
    assert status == {1: ("completed", None, "live", "unpinned"), 2: ("completed", None, "none", "unpinned"), 3: ("completed", None, "snapshot", "pinned"),
                      4: ("failed", "Snapshot 2019-01-01 not found", None, None), 5: ("failed", "No price data available", None, None)}
    assert {r["run_id"] for r in store.read("benchmarks").collect()} == {1, 3}
    assert store.read("curves").filter("run_id = 3").count() == 32  # the snapshot ends on the first of February
    assert {(r["run_id"], r["analysis_id"]) for r in store.read("ai_evaluations").collect()} == {(1, 9), (2, 9)}
    detail = {r["run_id"]: r for r in rs.run_detail(store, listed=5).collect()}
    assert detail[1]["has_more"] and len(detail[1]["trades"]) == 5 and not detail[2]["has_more"] and len(detail[2]["trades"]) == 4
    assert detail[2]["benchmark"] is None and detail[4]["result"] is None and detail[4]["trades"] == []
    seen = [tuple(r[c] for c in rs.TRADE_ORDER) for page in rs.pages(store.read("trades").filter("run_id = 1"), rs.TRADE_ORDER, 3) for r in page]
    assert len(seen) == 8 and seen == sorted(set(seen))
    back = [r["run_id"] for page in rs.pages(store.read("runs"), ["run_id"], 2, descending=True) for r in page]
    assert back == [5, 4, 3, 2, 1] and list(rs.pages(store.read("runs").limit(0), ["run_id"], 2)) == []


def test_news_epochs_change_four_tables_once(spark, tmp_path):
    from tallyvane.catalog.registry import load_all
    from tallyvane.sources.views import Market

    load_all()
    from tallyvane.catalog.stores import batch_market, raw_articles

    m = Market.open(spark, "/root/testdata/sf0.001")

    root = str(tmp_path / "news")

    def inputs(batch):
        b = batch_market(m, batch)
        return raw_articles(b), b.companies(), b.bars(), b.now, b.days_ago(170)

    handle = news_flow.news_batch(root, inputs, min_weight=0.2)
    docs = m.table("documents")
    count = lambda: {t: news_flow.news_store(spark, root).read(t).count() for t in news_flow.TABLES}
    handle(docs.filter("doc_id % 2 = 0"), 0)
    half = count()
    handle(docs.filter("doc_id % 2 = 0"), 0)
    assert count() == half and half["events"] > half["alerts"] > 0
    handle(docs, 1)  # the even half comes again under a new epoch, and adds nothing
    store = news_flow.news_store(spark, root)
    for table, key in (("articles", ["news_id"]), ("links", ["company_id", "news_id"]), ("events", ["company_id", "news_id"]), ("alerts", ["company_id", "source_id"])):
        assert store.read(table).select(*key).distinct().count() == store.read(table).count() > half[table]


def test_profiles_and_statements_in_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "f"), jobs.FUNDAMENTALS)
    none = spark.createDataFrame([], "company_id bigint, payload string")
    companies = spark.createDataFrame([(1, "old", "s", "i"), (2, "two", "s", "i")], "company_id bigint, name string, sector string, industry string")
    income = spark.createDataFrame([(1, '[{"date": "2024-03-31", "period": "Q1", "revenue": 5, "netIncome": 1}]')], "company_id bigint, payload string")
    profile = companies.filter("company_id = 1").withColumn("name", F.lit("new")).withColumn("sector", F.lit(""))
    assert jobs.store_fundamentals(store, none, income, none, none, companies, profile) == {"statements": 1, "profiles": 1}
    assert jobs.store_fundamentals(store, none, income, none, none, companies, profile) == {}
    assert [tuple(r)[:4] for r in store.latest("profiles", ["company_id"]).collect()] == [(1, "new", "s", "i")]
    again = profile.withColumn("name", F.lit("newer"))
    assert jobs.store_fundamentals(store, none, income, none, none, companies, again) == {"statements": 0, "profiles": 1}
    assert [r["name"] for r in store.latest("profiles", ["company_id"]).collect()] == ["newer"]


def test_context_keeps_ten_newest_and_names_what_is_missing(spark):
    from tallyvane.operators import context

    companies = spark.createDataFrame([(1,), (2,), (3,)], "company_id bigint")
    day = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    news = spark.createDataFrame([(1, i, day(i // 2), f"t{i}") for i in range(25)], "company_id bigint, news_id bigint, at timestamp, title string")
    risk = spark.createDataFrame([(1, day(1), 5.0), (1, day(2), 7.0), (2, None, 1.0)], "company_id bigint, ts timestamp, risk_score double")
    facts = spark.createDataFrame([(1, "2020-03-31", float("nan")), (2, "2020-03-31", 0.5)], "company_id bigint, period string, roe double")
    macro = spark.createDataFrame([("cpi", day(1), 1.0), ("cpi", day(3), 3.0), ("vix", day(2), None)], "indicator string, ts timestamp, value double")
    parts = [context.section_rows(news, "news", "at", "news_id"), context.section_rows(risk, "risk", "ts"), context.section_rows(facts, "metrics", "period")]
    got = {r["company_id"]: r for r in context.assemble(companies, parts, macro).select(
        "company_id", F.transform("news_snapshot", lambda v: F.try_variant_get(v, "$.news_id", "int")).alias("news"), "news_count", "event_count",
        F.try_variant_get("risk_snapshot", "$.risk_score", "double").alias("risk"), "macro_snapshot", "missing_snapshots").collect()}
    assert got[1]["news"] == list(range(24, 14, -1)) and got[1]["news_count"] == 25 and got[1]["risk"] == 7.0
    assert got[1]["missing_snapshots"] == ["market_snapshot", "technical_snapshot", "fundamental_snapshot"]
    assert got[2]["missing_snapshots"] == ["market_snapshot", "technical_snapshot"] and got[2]["news"] is None
    assert got[3]["missing_snapshots"] == [f"{s}_snapshot" for s in context.REQUIRED] and got[3]["macro_snapshot"] == {"cpi": 3.0}


def test_plain_rules(spark):
    from tallyvane.functions import ids
    from tallyvane.operators import pricing, retrieval

    raw = spark.createDataFrame([(1, "1700000000", "1", None, "2", "x", "0", "7.9"), (2, "1700000000000", None, "3", "2", "1", "4.5", None), (3, "2023-11-14T22:13:20Z", *["1"] * 6)],
                                "company_id bigint, timestamp string, open string, high string, low string, close string, adjusted_close string, volume string")
    got = [tuple(r)[1:] for r in pricing.normalized_bars(raw, "s").orderBy("company_id").collect()]
    assert {r[0] for r in got} == {dt.datetime(2023, 11, 14, 22, 13, 20)}
    assert [r[1:] for r in got] == [(1.0, 0.0, 2.0, 0.0, None, 7, "s"), (0.0, 3.0, 2.0, 1.0, 4.5, 0, "s"), (1.0, 1.0, 1.0, 1.0, 1.0, 1, "s")]
    names = spark.createDataFrame([(" a-b_c.1 ",), ("a b",), ("",), (None,), ("x" * 101,)], "v string")
    assert [r[0] for r in names.select(ids.valid_identifier("v")).collect()] == ["a-b_c.1", None, None, None, None]
    hits = spark.createDataFrame([("news", 1), ("news", 1), ("events", 1)], "bucket string, query_id int")
    counts = retrieval.bucket_counts(hits, spark.createDataFrame([(1,), (2,)], "query_id int")).orderBy("query_id").collect()
    assert [tuple(r) for r in counts] == [(1, 2, 0, 1, 0, 3), (2, 0, 0, 0, 0, 0)]
