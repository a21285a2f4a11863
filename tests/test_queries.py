"""Every query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from datascout.plans import registry

SF = "/root/testdata/sf0.001"


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(v)

    return [columns[i] for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.SQL:
        assert rows
        return
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = db.execute(registry.SQL[name])
    columns = [c[0] for c in got.description]
    assert shown(df.columns, rows) == shown(columns, got.fetchall())
