"""Every query of the library that SQL can express gives DuckDB's rows on the same tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import pytest

from curbside.plans import catalog

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="test tables are not here")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    found = catalog.queries()[name](spark, DATA)
    expected = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(found.columns)
    ours = sorted(repr(plain(tuple(r))) for r in found.select(*names).collect())
    assert ours == sorted(repr(plain(r)) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_give_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
