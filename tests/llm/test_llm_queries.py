"""Registered queries of the subpackage beside their SQL on the smallest tables, and those without SQL on their own terms."""

from pathlib import Path

import duckdb
import pytest

from starloom.llm.queries import ORACLES, QUERIES


def canon(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(r[n] for n in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, db, name):
    assert canon(QUERIES[name](spark, small).toArrow()) == canon(db.execute(ORACLES[name]).to_arrow_table())


def test_top_items_are_bounded_by_the_counts(spark, small, db):
    rows = QUERIES["p3_top"](spark, small).collect()
    for r in rows:
        n = db.execute(f"select count(*) from session_events where {r['field']} = ?", [r["item"]]).fetchone()[0]
        assert r["low"] <= n <= r["high"]
    assert {r["field"] for r in rows} == {"user_agent", "geo_city_name"}


def test_template_leaks_hold_the_exact_ones(spark, small, db):
    leaks = QUERIES["p8_templates"](spark, small).collect()
    exact = {tuple(r) for r in db.execute(ORACLES["p8_found"]).fetchall()}
    assert {(r["doc_id"], r["item_id"]) for r in leaks if r["kind"] == "exact"} == exact
    assert len({(r["doc_id"], r["item_id"]) for r in leaks}) == len(leaks)


def test_every_document_has_ids_and_subjects(spark, small, db):
    docs = {r[0] for r in db.execute("select doc_id from documents").fetchall()}
    ids = QUERIES["p7_ids"](spark, small).collect()
    assert sorted(r["doc_id"] for r in ids) == sorted(docs)
    lengths = QUERIES["p7_lengths_by_source"](spark, small)
    assert sum(r["n_tokens"] for r in lengths.collect()) == sum(len(r["ids"]) for r in ids)
    found = QUERIES["p9_found"](spark, small).collect()
    known = {r[0] for r in db.execute("select subject from subjects").fetchall()}
    assert {r["doc_id"] for r in found} == docs and {r["subject"] for r in found} <= known
    assert len({tuple(r) for r in found}) == len(found)
    weights = QUERIES["p9_composition"](spark, small).collect()
    assert abs(sum(r["weight"] for r in weights) - len(docs)) < 0.01
