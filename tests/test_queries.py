"""Every roster query against its SQL on the same rows."""

import math

import pytest

from lineupkit.plans import registry
SF = "/root/testdata/sf0.001"


def _order(row) -> str:
    """Exact columns first; rounded ones may differ in the last digit."""
    return str([x for x in row if not isinstance(x, float)] + [round(x, 4) + 0.0 for x in row if isinstance(x, float)])


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    """Their operators are compared with plain numpy in test_models.py and test_nearest.py."""
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*cols).collect()), key=_order)
    want = duck.execute(registry.SQL[name])
    assert sorted(x[0] for x in want.description) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    expected = sorted((tuple(r) for r in duck.execute(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall()), key=_order)
    assert len(rows) == len(expected)
    assert rows or name == "c10_support_mask"  # no pair has its support in the smallest tables
    assert sum(not all(map(_same, a, b)) for a, b in zip(rows, expected, strict=True)) == 0
