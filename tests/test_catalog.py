import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from loomstat import catalog

REPO = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEAVY = {"edge_dist_max", "edge_dist_min", "edge_dist_mean", "corr_pairs"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n not in HEAVY])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    cur = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(v) for v in r]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_queries_without_sql(spark, sf):
    for name in catalog.queries().keys() - catalog.oracle_sql().keys():
        if name.startswith("dist_"):
            rows = catalog.queries()[name](spark, sf).collect()
            assert rows and all(abs(r.p + r.q - 1) < 1e-8 for r in rows), name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_subpackage(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("loomstat", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "loomstat").mkdir()
    for p in (REPO / "loomstat").iterdir():
        if p.name != "llm":
            (tmp_path / "loomstat" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[1:] == ["False"] and int(out.stdout.split()[0]) > 80, out.stderr
