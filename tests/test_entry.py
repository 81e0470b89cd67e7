"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def _rows(frame, names):
    return sorted(str(tuple(None if v != v else v for v in row)) for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and _rows(got, names) == _rows(want, names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_scratch_tables_are_deleted_but_for_those_kept(spark):
    import os

    from talweg.functions.lineage import cut, scratch

    where = lambda df: df._talweg_path.removeprefix("file://")
    with scratch() as kept:
        one, two = cut(spark.range(3)), cut(spark.range(4))
        with scratch() as inner:
            three, four = cut(spark.range(5)), cut(spark.range(6))
            inner.append(three)
        assert os.path.exists(where(three)) and not os.path.exists(where(four))
        kept.append(two)
    assert [os.path.exists(where(x)) for x in (one, two, three)] == [False, True, False] and two.count() == 4
