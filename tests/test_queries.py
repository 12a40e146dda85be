"""Every registered query against its SQL on the smallest tables; and the entry module without the text operators."""

import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from cadenza.plans.registry import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    return db


def canonical(df):
    """Sorted columns, and rows sorted by their keys and then by coarse numbers."""
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    columns = sorted(df.columns)
    rows = [tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)]
    exact = lambda r: [repr(v) for v in r if not isinstance(v, float) or v.is_integer()]
    return columns, sorted(rows, key=lambda r: (exact(r), [f"{v:.3f}" for v in r if isinstance(v, float)]))


def same(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 + 1e-6 * abs(y)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, data, con, name):
    query = QUERIES[name]
    columns, found = canonical(query.run(spark, data).toPandas())
    wanted_columns, wanted = canonical(con.sql(query.oracle()).df())
    assert columns == wanted_columns and len(found) == len(wanted)
    assert all(same(x, y) for a, b in zip(found, wanted) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_runs(spark, data, name):
    assert QUERIES[name].run(spark, data).count() > 0


def test_entry_without_text_operators():
    code = "import sys; sys.modules['cadenza.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rpartition("/tests/")[0])
