"""The driver contract: entry(), queries() and oracle_sql()."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from medialake import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SMOKE = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def test_every_catalog_query_has_an_oracle():
    """The training-data operators are optional, and some have no SQL form; the catalog's all have one."""
    assert set(registry.queries()) <= set(E.oracle_sql()) <= set(E.queries())
    assert len(registry.queries()) >= 95


@pytest.mark.parametrize("absent", ["medialake.llm", "corpus_pipeline", "xxhash"])
def test_entry_stands_without_the_optional_part(absent):
    code = (f"import sys; sys.modules[{absent!r}] = None\n"
            "import __spark_entry__ as E; from medialake import registry\n"
            "assert set(E.queries()) == set(registry.queries()) == set(E.oracle_sql())")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.columns == ["file_hash", "file_path", "file_size", "matches_pattern",
                          "file_count", "is_original"]
    rows = df.collect()
    assert len(rows) > 0
    # every group has exactly one original
    originals = {}
    for r in rows:
        originals[r.file_hash] = originals.get(r.file_hash, 0) + int(r.is_original)
    assert set(originals.values()) == {1}


def test_oracle_sql_runs_in_duckdb():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        con.execute(sql).fetchall()
