"""Every registered query with SQL against DuckDB at sf0.001."""

import math
from collections import Counter

import duckdb
import pytest

from ontoloom.plans import catalog, catalog_documents, catalog_edges, catalog_reasoning, catalog_structures

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return Counter(tuple(fix(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def shared():
    """Tables that many queries derive anew are derived once here; the queries' own ways stay."""
    patch, made = pytest.MonkeyPatch(), {}
    names = {catalog_edges: ("_edges", "_closed", "_saturated"), catalog_reasoning: ("_state",), catalog_documents: ("_documents", "_read_back"), catalog_structures: ("_forest",)}
    for module, name in [(m, n) for m, ns in names.items() for n in ns]:
        f = getattr(module, name)
        patch.setattr(module, name, lambda spark, d, f=f: made.setdefault(f, None) or made.__setitem__(f, f(spark, d)) or made[f])
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cur = con.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want, got = _norm(cur.fetchall(), names), _norm([tuple(r) for r in df.collect()], df.columns)
    assert got == want
