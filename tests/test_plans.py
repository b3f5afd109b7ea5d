"""Validation, derivation, DDL, descriptions and the command line; no Spark job runs."""

import json

import pytest

from starloom.plans import cli, ddl, derive
from starloom.plans import model as m
from starloom.plans.validate import Fault, InvalidDescription, make_env
from starloom.sources.spec import SpecError, parse_spec

DEFAULTS = {"integer": "-1", "text": "'?'", "character": "'?'"}

VISIT = m.Table(
    "visits",
    (
        m.Column("id", "uuid", False),
        m.Column("seen_at", "timestamp without time zone", False),
        m.Column("shop", "integer", False),
        m.Column("city_name", "text"),
        m.Column("city_land", "text"),
        m.Column("browser", "character varying(20)"),
        m.Column("spent", "integer"),
    ),
    (m.PrimaryKey("id"),),
)
CLICK = m.Table(
    "clicks",
    (
        m.Column("id", "uuid", False),
        m.Column("at", "timestamp without time zone", False),
        m.Column("shop", "integer", False),
        m.Column("visit_id", "uuid"),
        m.Column("ad_id", "integer"),
        m.Column("kind", "text", False),
    ),
    (m.PrimaryKey("id"), m.ForeignKey("visits", (("visit_id", "id"), ("shop", "shop"))), m.ForeignKey("ads", (("ad_id", "id"),))),
)
AD = m.Table("ads", (m.Column("id", "serial", False), m.Column("name", "text")), (m.PrimaryKey("id"),))
VISITS = m.Fact(
    "visit",
    "visits",
    (
        m.DimTime("seen_at"), m.TenantId("shop"), m.DimVal("city_name", "city"), m.DimVal("city_land", "city"), m.DimVal("browser", "agent"),
        m.FactCount("n"), m.FactCountDistinct("people"), m.FactSum("money", "spent"), m.FactAverage("mean", "spent"),
    ),
)
CLICKS = m.Fact("click", "clicks", (m.DimTime("at"), m.NoDimId("shop"), m.DimId("ad_id", "ads"), m.DimVal("kind", "kind"), m.FactCount("n")), parents=("visit",))


def env(**settings):
    return make_env([VISIT, CLICK, AD], [VISITS, CLICKS], m.Settings(**settings), DEFAULTS)


def faults(tables, facts, defaults=DEFAULTS):
    with pytest.raises(InvalidDescription) as e:
        make_env(tables, facts, None, defaults)
    return [(f.kind, *f.subject) for f in e.value.faults]


def test_fact_table():
    t = derive.fact_table(env(), VISITS)
    assert t.name == "fact_visit_by_minute"
    assert [(c.name, c.type) for c in t.columns] == [
        ("seen_at_minute_id", "bigint"), ("shop", "integer"), ("n", "integer"), ("people", "json"), ("money", "integer"),
        ("mean_count", "integer"), ("mean_sum", "integer"), ("agent_id", "integer"), ("city_id", "integer"),
    ]
    assert not any(c.nullable for c in t.columns)
    assert t.constraints == (m.UniqueKey(("seen_at_minute_id", "shop", "agent_id", "city_id")),)


def test_inherited_references_come_last():
    t = derive.fact_table(env(time_unit=m.TimeUnit.WEEK), CLICKS)
    assert [c.name for c in t.columns] == ["at_week_id", "shop", "n", "ad_id", "kind_id", "agent_id", "city_id"]


def test_dimension_tables():
    existing, kind = derive.dimension_tables(env(), CLICKS)
    assert existing is AD and kind.name == "dim_kind"
    agent, city = derive.dimension_tables(env(dim_id_type="bigserial"), VISITS)
    assert [c.name for c in city.columns] == ["id", "name", "land"]
    assert city.columns[0].type == "bigserial" and city.constraints == (m.PrimaryKey("id"), m.UniqueKey(("name", "land")))
    assert agent.columns[1] == m.Column("browser", "character varying(20)", False)


def test_sessions_and_page_views():
    from starloom.queries import _PAGE_VIEW, _SESSION, environment

    e = environment(_SESSION, _PAGE_VIEW)
    session, view = (derive.fact_table(e, f) for f in e.facts)
    assert [c.name for c in session.columns] == ["created_at_minute_id", "publisher_id", "session_count", "geo_id", "user_agent_id"]
    assert session.constraints == (m.UniqueKey(("created_at_minute_id", "publisher_id", "geo_id", "user_agent_id")),)
    assert [c.name for c in view.columns] == [
        "created_at_minute_id", "publisher_id", "view_count", "referrer_id", "page_type_id", "geo_id", "user_agent_id",
    ]
    geo, agent = derive.dimension_tables(e, e.fact("session"))
    assert [c.name for c in geo.columns] == ["id", "country_name", "city_name", "continent_name"]
    assert [c.name for c in agent.columns] == ["id", "browser_name", "os", "name"]
    assert ddl.dimension_indexes(geo) == [("country_name",), ("city_name",), ("continent_name",)]
    page_type = derive.dimension_tables(e, e.fact("page_view"))[1]
    assert ddl.dimension_indexes(page_type) == []
    assert [i for (i,) in ddl.fact_indexes(e, e.fact("page_view"))] == [
        "created_at_minute_id", "publisher_id", "referrer_id", "page_type_id", "geo_id", "user_agent_id",
    ]


def test_lineage_and_order():
    e = env()
    assert derive.dependencies(e, CLICKS)["fact_click_by_minute"] == ["clicks", "visits", "ads", "dim_kind", "dim_city", "dim_agent"]
    order = derive.build_order(e)
    assert order.index("dim_city") < order.index("fact_click_by_minute") and len(order) == 5


def test_every_fault_is_found_once():
    bad = m.Table("t", (m.Column("a", "blob"), m.Column("a", "text"), m.Column("when", "timestamp")), (m.PrimaryKey("x"), m.UniqueKey(("y",)), m.ForeignKey("no", (("z", "q"),))))
    fact = m.Fact("f", "t", (m.DimTime("when"), m.DimVal("a", "d"), m.DimId("b", "gone"), m.FactSum("s", "c")), parents=("nobody",))
    found = faults([bad, bad], [fact, fact])
    assert len(found) == len(set(found))
    kinds = {f[0] for f in found}
    assert kinds == {"MissingColumn", "MissingTable", "MissingFact", "MissingNotNullConstraint", "MissingTypeDefault", "DuplicateTable", "DuplicateFact", "DuplicateColumn"}
    assert ("MissingColumn", "t", "c") in found and ("MissingTypeDefault", "blob") in found
    assert found.index(("MissingColumn", "t", "x")) < found.index(("MissingFact", "nobody")) < found.index(("DuplicateTable", "t"))


def test_missing_time_and_tables():
    assert faults([AD], [m.Fact("f", "nowhere", ())]) == [("MissingTable", "nowhere")]
    assert ("MissingTimeColumn", "f") in faults([AD], [m.Fact("f", "ads", (m.FactCount("n"),))])


def test_added_checks():
    a = m.Fact("a", "visits", (m.DimTime("seen_at"),), parents=("b",))
    b = m.Fact("b", "visits", (m.DimTime("seen_at"),), parents=("a",))
    assert faults([VISIT], [a, b])[0][0] == "CyclicParents"
    loose = m.Table("clicks", CLICK.columns, (m.PrimaryKey("id"),))
    assert faults([VISIT, loose, AD], [VISITS, CLICKS]) == [("MissingForeignKey", "clicks", "visits")]
    keyless = m.Table("visits", VISIT.columns)
    assert faults([keyless], [VISITS])[0][0] == "MissingPrimaryKey"
    clash = m.Fact("f", "visits", (m.DimTime("seen_at"), m.DimVal("city_name", "city"), m.DimVal("browser", "city")))
    ok = make_env([VISIT], [clash], None, DEFAULTS)
    assert [c.name for c in derive.dimension_tables(ok, clash)[0].columns] == ["id", "name", "browser"]
    twice = m.Fact("g", "visits", (m.DimTime("seen_at"), m.DimVal("browser", "city")), parents=("f",))
    assert faults([VISIT], [clash, twice])[0][0] == "NameClash"


def test_default_is_the_first_matching_key():
    e = m.Env((), (), m.Settings(), (("time", "1"), ("timestamp", "2"), ("text", "3")))
    assert e.default_for("timestamp without time zone") == "1" and e.default_for("TEXT") is None


def test_ddl():
    e = env(suffix_template="_x")
    agent = derive.dimension_tables(e, VISITS)[0]
    assert ddl.dimension_ddl(e, agent) == [
        "create table dim_agent_x (\n  id serial not null,\n  browser character varying(20) not null\n)\n;\n",
        "alter table dim_agent_x add primary key (id);\n",
        "alter table dim_agent_x add unique (browser);\n",
    ]
    text = ddl.fact_ddl(e, VISITS)
    assert text[1].count("\n") == 4  # four key columns, one on a line
    assert [t.split("(")[1].split(")")[0] for t in text[2:]] == ["seen_at_minute_id", "shop", "agent_id", "city_id", "shop, seen_at_minute_id"]
    assert ddl.add_constraints(e, CLICK)[1] == (
        "alter table clicks_x add foreign key (visit_id, shop) references visits (id, shop) on update restrict on delete restrict;\n"
    )
    assert ddl.write_layout(e, VISITS) == {"partition_by": ["shop"], "sort_by": ["seen_at_minute_id"]}


def test_id_types():
    assert [derive.id_type_of_reference(t) for t in ("serial", "SMALLSERIAL", "bigserial", "uuid")] == ["integer", "smallint", "bigint", "uuid"]


SPEC = """
tables:
  - name: visits
    columns: [[id, uuid, notnull], [at, timestamp, notnull], [city, text]]
    constraints: [{type: primary, column: id}]
facts:
  - name: visit
    tablename: visits
    columns: [{type: dimtime, column: at}, {type: dimval, column: city, table: place}, {type: factcount, column: n}]
  - name: hidden
    tablename: visits
    persistent: false
    columns: [{type: dimtime, column: at}]
defaults: {text: "'?'"}
"""


def test_command_line(tmp_path, capsys):
    spec = tmp_path / "s.yaml"
    spec.write_text(SPEC)
    assert cli.main([str(spec), str(tmp_path / "out"), "-t", "hour", "--dim-prefix", "d_"]) == 0
    out = tmp_path / "out"
    assert sorted(p.name for p in (out / "create").iterdir()) == ["d_place.sql", "fact_visit_by_hour.sql"]
    for folder in ("fullrefresh", "increfresh"):
        assert sorted(p.name for p in (out / folder).iterdir()) == ["d_place.sql", "fact_visit_by_hour.sql"]
    assert "d_place{{suff}}" in (out / "fullrefresh" / "d_place.sql").read_text()
    assert "{{suff}}" not in (out / "increfresh" / "fact_visit_by_hour.sql").read_text()
    assert json.loads((out / "facts.json").read_text()) == ["fact_visit_by_hour"]
    assert json.loads((out / "dimensions.json").read_text()) == ["d_place"]
    assert set(json.loads((out / "dependencies.json").read_text())) == {"d_place", "fact_visit_by_hour", "fact_hidden_by_hour"}
    spec.write_text(SPEC.replace("{type: dimtime, column: at}, {type: dimval", "{type: dimval"))
    assert cli.main([str(spec), str(out)]) == 1 and "MissingTimeColumn" in capsys.readouterr().err
    spec.write_text("tables: []")
    assert cli.main([str(spec), str(out)]) == 1


@pytest.mark.parametrize(
    "change", [{"facts": [{"name": "f"}]}, {"defaults": {"integer": -1}}, {"tables": [{"name": "t", "columns": [["a"]], "constraints": []}]},
               {"tables": [{"name": "t", "columns": [["a", "text", "maybe"]], "constraints": []}]},
               {"tables": [{"name": "t", "columns": [], "constraints": [{"type": "check"}]}]},
               {"facts": [{"name": "f", "tablename": "t", "columns": [{"type": "factsum", "column": "x"}]}]}]
)
def test_bad_descriptions(change):
    with pytest.raises(SpecError):
        parse_spec({"tables": [], "facts": [], "defaults": {}} | change)


def test_faults_print():
    assert str(Fault("MissingTable", ("x",))) == "MissingTable(x)"


def test_session_settings():
    from starloom.session import settings

    big, small = settings(100_000, 1000, 4), settings(0.1, 2, 4)
    assert int(big["spark.sql.shuffle.partitions"]) == 100_000 and int(small["spark.sql.shuffle.partitions"]) == 24


@pytest.mark.parametrize("args", [["--refresh", "full"], ["--refresh", "incremental", "--end", "2024-01-01"], ["--merge"], ["--refresh", "full", "--end", "2024-01-01", "--merge"]])
def test_bounds_are_asked_for_at_parsing(args, capsys):
    with pytest.raises(SystemExit):
        cli.parsed(["in.yaml", "out", *args])
    assert "need" in capsys.readouterr().err or "--merge" in args
    assert cli.parsed(["in.yaml", "out", "--refresh", "incremental", "--end", "2024-01-02", "--start", "2024-01-01", "--merge"]).merge
