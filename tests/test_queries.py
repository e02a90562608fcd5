"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandlake.plans import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DIR):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{t}')")
    got, want = QUERIES[name](spark, DIR).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_fisher_of_chances_below_doubles_equals_sql(spark, tmp_path):
    """Words that 600 documents of quality 1 share and as many of quality 0 lack: chances down to e^-828."""
    word = {"ACGTA": 600, "CCCCC": 575, "GGGGG": 530, "TTTTT": 500, "AAAAA": 90}
    texts = [" x".join(w for w, m in word.items() if i < m) or "n" for i in range(1200)]
    texts[700] = texts[1100] = "AAAAA"
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, 'en', 's')", list(enumerate(texts)))
    con.sql("create table labels as select doc_id, (doc_id < 600)::integer as quality from documents")
    for t in ("documents", "labels"):
        con.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = con.sql(SQL["fisher_exact_words"]).df()
    assert want.log_p.min() == float("-inf") and ((want.log_p < -709) & (want.log_p > -745)).any()
    assert rows(QUERIES["fisher_exact_words"](spark, str(tmp_path)).toPandas()) == rows(want)
