"""Every registered query of the platform against DuckDB on the smallest tables; the entry contract; the package without ``llm``."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from rallyspark.plans import catalogue
from tests.conftest import ROOT, SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    want = db.sql(catalogue.ORACLES[name])
    names = list(want.columns)
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [["rallyspark.llm"], ["corpus_pipeline"], ["rallyspark.llm", "corpus_pipeline"]])
def test_imports_without_the_corpus_part(gone, tmp_path):
    """A copy of the repository without the folders, as the driver makes it; each may be missing alone."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", *(["llm"] if "rallyspark.llm" in gone else []), *[f"{g}.py" for g in gone]))
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), 'pipeline' in q, any(x[:2] == 'op' and x[2].isdigit() for x in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    n, pipeline, corpus = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, check=True, capture_output=True, text=True).stdout.split()
    assert int(n) >= len(catalogue.QUERIES) and pipeline == "False" and corpus == str("rallyspark.llm" not in gone)
