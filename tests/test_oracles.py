"""Every query with SQL gives the same rows as DuckDB on the same tables."""

from __future__ import annotations

import decimal
import math

import pytest

from heddle import plans  # noqa: F401
from heddle.registry import ORACLES, QUERIES


def _plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 9)
    return str(v)


def _key(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted(([_plain(r[c]) for c in cols] for r in got.collect()), key=_key)
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(([_plain(r[i]) for i in at] for r in found.fetchall()), key=_key)
