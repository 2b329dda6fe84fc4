import math
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["public_tokenizers", "umbraline.llm", "corpus_pipeline"])
def test_entry_without_optional_parts(name):
    code = f"import sys; sys.modules[{name!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    n, pipeline, subset = said.stdout.split()[-3:]
    assert int(n) >= 38 and (pipeline, subset) == ("False", "True")


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_equal_their_sql(spark, small, name):
    import duckdb

    with duckdb.connect() as db:
        for t in ("documents", "pages", "conversations", "events"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        cursor = db.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    got = entry.queries()[name](spark, small)
    order = sorted(got.columns)
    assert sorted(columns) == order
    plain = lambda rows: sorted((tuple(_plain(r[c]) for c in order) for r in rows), key=str)
    assert plain(got.collect()) == plain(want)
