"""News of companies that share a stored name."""

import duckdb

from tallyvane.catalog.registry import load_all
from tallyvane.sources.tables import TABLES


def test_headlines_name_companies_by_key(spark, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        rows = f"SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'"
        if t == "supplier":
            rows = f"SELECT * REPLACE ('Supplier#' || lpad((s_suppkey % 3)::VARCHAR, 9, '0') AS s_name) FROM ({rows})"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    q = load_all()["news_to_alerts"]
    df = q.run(spark, str(tmp_path))
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want
