import re

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op3_exact_topk", "op4_warc", "op5_nearest_neighbours"])
def test_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    by = list(want.columns)
    want, got = (x.sort_values(by).reset_index(drop=True) for x in (want, got))
    assert got.equals(want)


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"op(1|2|6|7|8|9|10)_", n)])
def test_runs_on_its_table(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0
