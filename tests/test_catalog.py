"""Every query against its SQL, at the smallest scale."""

import math

import pytest

from lodestone.plans import catalog
from tests.conftest import SF


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.10g}") + 0.0)
    return repr(v)


def rows(names, data):
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(normal(r[i]) for i in by) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    made = duck.execute(catalog.SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, made.fetchall())
