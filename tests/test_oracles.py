"""Every registered query against its SQL twin, side by side."""

import duckdb
import pandas as pd
import pytest

from braidwell import catalog, catalog_fusion, catalog_more, catalog_rules  # noqa: F401
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return (0, "")
        if isinstance(x, (bool, int, float)) or hasattr(x, "item"):
            return (1, f"{float(x):.9g}")
        return (2, str(pd.Timestamp(x)) if isinstance(x, pd.Timestamp) else str(x))

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, SMALL).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["query_id", "rank", "locator"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_expanded_details_of_odd_documents_equal_sql(spark, tmp_path):
    """Lines with every kind of space around them, line ends that aren't, and documents without title or text."""
    odd = [*map(chr, (32, 9, 13, 11, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200B, 0x2028, 0x202F, 0x3000, 0xFEFF))]
    texts = ["\n".join(["a", "b", f"{x}# c", f"{x} {x}", f"{x} d{y}{x}", "\U0001f600" * 500]) for x in odd for y in odd]
    rows = [(4 * i + j, t, "en") for i, t in enumerate(texts) for j in range(2)] + [(4000 + i, t, g) for i in range(8) for t, g in [(texts[i] if i < 4 else None, None if i % 2 else "")]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = catalog.QUERIES["expanded_details"](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLE_SQL["expanded_details"]).df()
    assert plain(got) == plain(want)
