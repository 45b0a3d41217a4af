"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from clausewright.plans import queries as plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{file}')")
    return con


def shown(row):
    return str([round(v, 9) if isinstance(v, float) else v for v in row])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, sql, name):
    found = plans.QUERIES[name](spark, DATA)
    names = sorted(found.columns)
    said = sql.execute(plans.ORACLES[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == names
    wanted = sorted(shown([row[columns.index(n)] for n in names]) for row in said.fetchall())
    assert sorted(shown([row[n] for n in names]) for row in found.collect()) == wanted


@pytest.mark.parametrize(("name", "least"), [("detected_types", -16), ("file_outcomes", 0)])  # the outcomes' SQL has no rows of ids below 0
def test_files_without_text_and_with_odd_ids_are_as_in_sql(spark, tmp_path, name, least):
    texts = [None, "", "\n", "1. A bar.\n2. The bar of claim 1."]
    spark.createDataFrame([(i, texts[i // 4 % 4]) for i in range(least, 32)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [None, "", "<p>a</p>"][i % 3 - i // 12]) for i in range(24)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = plans.QUERIES[name](spark, str(tmp_path))
    said = con.execute(f"select {', '.join(found.columns)} from ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(shown, found.collect())) == sorted(map(shown, said))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
