"""Queries against their SQL on tables that the given folders don't have."""

import duckdb

from tallyvane.catalog.registry import load_all
from tallyvane.sources.tables import TABLES
from tallyvane.streaming import drain


def differs(spark, folder, name, changed, folders=()):
    """Rows of a query and of its SQL that the other doesn't have.

    ``changed``: the smallest tables' rows as SQL, by name; ``folders``: tables that are folders of files.
    """
    con = duckdb.connect()
    for t in TABLES:
        given = f"'/root/testdata/sf0.001/{t}.parquet'"
        con.execute(f"CREATE TABLE {t} AS {changed.get(t, 'SELECT * FROM {}').format(given)}")
        if t in folders:
            spark.createDataFrame(con.execute(f"FROM {t}").to_arrow_table()).repartition(3).write.parquet(f"{folder}/{t}.parquet")
        else:
            con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    q = load_all()[name]
    df = q.run(spark, str(folder))
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert want
    return [x for x in got if x not in want], [x for x in want if x not in got], len(got) - len(want)


def test_entities_that_share_an_id_are_all_embedded(spark, tmp_path):
    """Ids of a long conversation's analyses meet those of the next conversations."""
    more = ("SELECT * FROM {} UNION ALL SELECT * FROM (VALUES (0, 102, 'assistant', 'a much longer answer'), (0, 102, 'assistant', 'a much longer answer'), "
            "(1, 2, 'assistant', 'short'), (2, 1, 'assistant', NULL), (2, 2, 'assistant', NULL))")
    assert differs(spark, tmp_path, "embedding_job", {"conversations": more}) == ([], [], 0)


def test_streamed_tables_may_be_folders(spark, tmp_path):
    assert differs(spark, tmp_path, "news_to_alerts", {}, ["documents", "events"]) == ([], [], 0)
    events = spark.read.parquet(f"{tmp_path}/events.parquet").count()
    assert drain.drain(drain.event_stream(spark, str(tmp_path))).count() == events > 0


def test_portfolios_without_any_weight(spark, tmp_path):
    """Suppliers whose last quarter is all returns score 0; here every other one is, and customers hold one each."""
    changed = {
        "lineitem": "SELECT * REPLACE (CASE WHEN l_suppkey % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag) FROM {} WHERE l_linenumber = 1",
        "orders": "SELECT * REPLACE (o_orderkey AS o_custkey) FROM {}",
        "customer": "SELECT * REPLACE (c_custkey + 150 * i AS c_custkey) FROM {}, range(10) r(i)"}
    for name in ("portfolio_texts", "portfolio_summaries"):
        (tmp_path / name).mkdir()
        assert differs(spark, tmp_path / name, name, changed) == ([], [], 0)
