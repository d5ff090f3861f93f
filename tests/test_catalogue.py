"""Every query of the catalogue against its SQL on the smallest tables, and the package without its training part."""

import math
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from palimpsest.catalogue import ORACLES, QUERIES


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return str(x)[:19] if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, smallest, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(smallest).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = Counter(tuple(cell(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert Counter(tuple(map(cell, r)) for r in df.select(*columns).collect()) == expected


def test_nothing_imports_the_training_part():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['palimpsest.llm'] = None\nimport __spark_entry__ as e\nassert 'exact_spans' in e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    text = [p for p in (root / "palimpsest").rglob("*.py") if "llm" not in p.parts and "palimpsest.llm" in p.read_text()]
    assert text == []
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
