"""All marked points of both targets."""

import duckdb

from wardfield import catalog
from wardfield.catalog import clustering

from test_queries import FOLDER, TABLES, table


def test_marked_points_equal_sql_for_both_targets(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = catalog.QUERIES["marked_points"](spark, FOLDER)
    rows = df.collect()
    want = con.sql(catalog.SQL["marked_points"])
    assert table(df.columns, rows) == table(want.columns, want.fetchall())
    # Ten marks a target, each with one value.
    assert sorted((r["scenario"], r["index"], r["criterion"], r["k"]) for r in rows) == sorted(clustering.MARKED)
    assert [sum(m[0] == t for m in clustering.MARKED) for t in ("R12", "R34")] == [10, 10]
