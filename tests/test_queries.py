"""Every registered query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from quillgrid.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return held


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLES:
        found = con.execute(catalogue.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, found.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_corpus_package():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in [*root.glob("quillgrid/**/*.py")]:
        if "llm" not in path.parts:
            assert "quillgrid.llm" not in path.read_text(), path
