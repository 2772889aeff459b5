"""The queries that have SQL against it, on the small tables and on awkward rows."""

from collections import Counter

import duckdb
import pytest

from stallwise.llm import variants, warc
from stallwise.llm.oracles import ORACLES
from stallwise.llm.queries import QUERIES
from tests.llm.helpers import awkward

SMALL = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(row[i] for i in order) for row in rows)


def answer(name, **tables):
    con = duckdb.connect()
    for table, source in tables.items():
        con.register(table, source) if not isinstance(source, str) else con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{source}'")
    found = con.execute(ORACLES[name])
    return rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ORACLES)
def test_small_tables(spark, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    assert got == answer(name, **{t: f"{SMALL}/{t}.parquet" for t in ("documents", "pages")}) and got[1]


def test_awkward_documents(spark):
    given = awkward(spark)
    df = variants.report(given)
    assert rows_of(df.columns, df.collect()) == answer("op12_variants", documents=given.toArrow())


def test_awkward_pages(spark):
    pages = spark.createDataFrame([(1, "u", "é"), (1, "u", "é"), (2, None, None), (3, "u", ""), (0, "u", "é")], "page_id long, url string, html string")
    df = warc.report(pages)
    assert rows_of(df.columns, df.collect()) == answer("op10_warc", pages=pages.toArrow())
