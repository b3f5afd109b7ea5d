"""Registered queries beside their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from starloom.queries import ORACLES, QUERIES  # noqa: E402


def canon(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(r[n] for n in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, db, name):
    assert canon(QUERIES[name](spark, small).toArrow()) == canon(db.execute(ORACLES[name]).to_arrow_table())


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    text = "".join(p.read_text() for p in (ROOT / "starloom").rglob("*.py") if "llm" not in p.parts)
    assert "starloom.llm" not in text
