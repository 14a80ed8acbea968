"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from mnemograph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(frame, columns):
    """Rows as text; a null is a null whatever its type is called."""
    return sorted(str(tuple(None if x != x or x is None or str(x) == "<NA>" else (float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in row)) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)
