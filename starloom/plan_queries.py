"""Registered queries of what is derived from descriptions: DDL, names, files, faults, loads as text, refreshes.

The expected rows beside them are written out: fixed values, taken from the rules and not from the code.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom import api
from starloom import queries as q
from starloom.operators.fact import load_fact
from starloom.plans import build, cli, ddl, derive, sqltext
from starloom.plans import model as m
from starloom.plans.validate import InvalidDescription, make_env
from starloom.sources.spec import SpecError, parse_spec, parse_text
from starloom.sources.store import TableStore


def _sql_value(v) -> str:
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(columns: str, rows: Sequence[tuple]) -> str:
    """SQL of constant rows; ``columns``: 'name type, ...' as in a schema."""
    lines = ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in rows)
    named = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f"cast({n} as {'varchar' if t == 'string' else t}) as {n}" for n, t in named)
    return f"select {casts} from (values {lines}) t({', '.join(n for n, _ in named)})"


def _constant(name: str, columns: str, expected: Sequence[tuple]):
    """Registers a function that gives rows in the driver."""

    def add(f):
        q.query(name, _values(columns, expected))(lambda spark, folder: spark.createDataFrame(list(f()), columns))
        return f

    return add


# --- descriptions -------------------------------------------------------------------------

_TIME = "timestamp without time zone"
_GOLDEN_TABLES = [
    q._t("session_events", [{"type": "primary", "column": "id"}], "!id uuid", f"!created_at {_TIME}", "!publisher_id integer",
         "browser_name character varying(50)", "os character varying(50)", "geo_country_name character varying(50)",
         "geo_city_name character varying(50)", "geo_continent_name character varying(15)", "user_agent_name character varying(100)"),
    q._t("page_view_events",
         [{"type": "primary", "column": "id"},
          {"type": "foreign", "table": "session_events", "columns": [["session_event_id", "id"], ["publisher_id", "publisher_id"]]},
          {"type": "foreign", "table": "referrers", "columns": [["referrer_id", "id"], ["publisher_id", "publisher_id"]]}],
         "!id uuid", f"!created_at {_TIME}", "!publisher_id integer", "session_event_id uuid", "!page_type character varying(20)", "referrer_id integer"),
    q._t("referrers", [{"type": "primary", "column": "id"}, {"type": "unique", "columns": ["publisher_id", "name"]}],
         "!id integer", "!publisher_id integer", "!name character varying(100)"),
]


def _golden(tables=_GOLDEN_TABLES, facts=(q._SESSION, q._PAGE_VIEW), **settings) -> m.Env:
    parsed = parse_spec({"tables": tables, "facts": list(facts), "defaults": q._DEFAULTS})
    return make_env(parsed[0], parsed[1], m.Settings(**({"suffix_template": ""} | settings)), parsed[2])


def _new_dimensions(env: m.Env, fact: m.Fact) -> list[m.Table]:
    return [t for t in derive.dimension_tables(env, fact) if not derive.is_existing(env, t)]


# --- DDL and indexes -------------------------------------------------------------------------


def _index(table: str, column: str) -> str:
    return f"create index  on {table} ({column})\n;\n"


_DIMENSION_DDL = [
    ("dim_geo", 0, "create table dim_geo (\n  id serial not null,\n  country_name character varying(50) not null,\n"
                   "  city_name character varying(50) not null,\n  continent_name character varying(15) not null\n)\n;\n"),
    ("dim_geo", 1, "alter table dim_geo add primary key (id);\n"),
    ("dim_geo", 2, "alter table dim_geo add unique (country_name,\n                                city_name,\n                                continent_name);\n"),
    ("dim_geo", 3, _index("dim_geo", "country_name")), ("dim_geo", 4, _index("dim_geo", "city_name")), ("dim_geo", 5, _index("dim_geo", "continent_name")),
    ("dim_user_agent", 0, "create table dim_user_agent (\n  id serial not null,\n  browser_name character varying(50) not null,\n"
                          "  os character varying(50) not null,\n  name character varying(100) not null\n)\n;\n"),
    ("dim_user_agent", 1, "alter table dim_user_agent add primary key (id);\n"),
    ("dim_user_agent", 2, "alter table dim_user_agent add unique (browser_name, os, name);\n"),
    ("dim_user_agent", 3, _index("dim_user_agent", "browser_name")), ("dim_user_agent", 4, _index("dim_user_agent", "os")),
    ("dim_user_agent", 5, _index("dim_user_agent", "name")),
    ("dim_page_type", 0, "create table dim_page_type (\n  id serial not null,\n  page_type character varying(20) not null\n)\n;\n"),
    ("dim_page_type", 1, "alter table dim_page_type add primary key (id);\n"),
    ("dim_page_type", 2, "alter table dim_page_type add unique (page_type);\n"),
]


@_constant("dimension_ddl", "table_name string, position int, statement string", _DIMENSION_DDL)
def _():
    env = _golden()
    for fact in env.facts:
        for t in _new_dimensions(env, fact):
            yield from ((t.name, i, s) for i, s in enumerate(ddl.dimension_ddl(env, t)))


_PAGE_VIEW_KEY = ["created_at_minute_id", "publisher_id", "referrer_id", "page_type_id", "geo_id", "user_agent_id"]
_FACT_DDL = [
    ("fact_page_view_by_minute", 0, "create table fact_page_view_by_minute (\n  created_at_minute_id bigint not null,\n  publisher_id integer not null,\n"
     "  view_count integer not null,\n  referrer_id integer not null,\n  page_type_id integer not null,\n  geo_id integer not null,\n"
     "  user_agent_id integer not null\n)\n;\n"),
    ("fact_page_view_by_minute", 1, "alter table fact_page_view_by_minute add unique (" + (",\n" + " " * 49).join(_PAGE_VIEW_KEY) + ");\n"),
    *[("fact_page_view_by_minute", 2 + i, _index("fact_page_view_by_minute", c)) for i, c in enumerate(_PAGE_VIEW_KEY)],
]


@_constant("fact_ddl", "table_name string, position int, statement string", _FACT_DDL)
def _():
    env = _golden()
    yield from (("fact_page_view_by_minute", i, s) for i, s in enumerate(ddl.fact_ddl(env, env.fact("page_view"))))


_TENANT = q._fact("visit", "session_events", "dimtime created_at", "tenantid publisher_id", "dimval browser_name user_agent", "dimval os user_agent",
                  "dimval geo_country_name geo", "factcount n")


@_constant(
    "index_lists", "table_name string, position int, columns string",
    [("fact_visit_by_minute", 0, "created_at_minute_id"), ("fact_visit_by_minute", 1, "publisher_id"), ("fact_visit_by_minute", 2, "geo_id"),
     ("fact_visit_by_minute", 3, "user_agent_id"), ("fact_visit_by_minute", 4, "publisher_id, created_at_minute_id"),
     ("dim_user_agent", 0, "browser_name"), ("dim_user_agent", 1, "os")],
)
def _():
    env = _golden(facts=[_TENANT])
    fact = env.fact("visit")
    yield from ((derive.fact_table_name(env.settings, fact), i, ", ".join(c)) for i, c in enumerate(ddl.fact_indexes(env, fact)))
    for t in _new_dimensions(env, fact):  # a single column needs none
        yield from ((t.name, i, ", ".join(c)) for i, c in enumerate(ddl.dimension_indexes(t)))


@_constant(
    "foreign_key_ddl", "table_name string, statement string",
    [("page_view_events", "alter table page_view_events add foreign key (session_event_id, publisher_id) references session_events (id, publisher_id)"
      " on update restrict on delete restrict;\n"),
     ("page_view_events", "alter table page_view_events add foreign key (referrer_id, publisher_id) references referrers (id, publisher_id)"
      " on update restrict on delete restrict;\n")],
)
def _():
    env = _golden()
    yield from (("page_view_events", s) for s in ddl.add_constraints(env, env.table("page_view_events"))[1:])


# --- derived tables, names, types ----------------------------------------------------------


@_constant(
    "derived_tables", "table_name string, position int, column_name string, column_type string",
    [("fact_stats_by_hour", 0, "created_at_hour_id", "bigint"), ("fact_stats_by_hour", 1, "publisher_id", "integer"), ("fact_stats_by_hour", 2, "n", "integer"),
     ("fact_stats_by_hour", 3, "people", "json"), ("fact_stats_by_hour", 4, "first_city", "character varying(50)"),
     ("fact_stats_by_hour", 5, "pub_count", "integer"), ("fact_stats_by_hour", 6, "pub_sum", "integer"), ("fact_stats_by_hour", 7, "geo_id", "bigint"),
     ("dim_geo", 0, "id", "bigserial"), ("dim_geo", 1, "country_name", "character varying(50)")],
)
def _():
    columns = ["dimtime created_at", "nodimid publisher_id", "factcount n", "factcountdistinct people", "factmin first_city geo_city_name",
               "factaverage pub publisher_id", "dimval geo_country_name geo"]
    env = _golden(facts=[q._fact("stats", "session_events", *columns)], time_unit=m.TimeUnit.HOUR, dim_id_type="bigserial")
    for t in (derive.fact_table(env, env.facts[0]), *_new_dimensions(env, env.facts[0])):
        yield from ((t.name, i, c.name, c.type) for i, c in enumerate(t.columns))


@_constant(
    "names", "what string, name string",
    [("fact second", "f_session_per_second"), ("time second", "created_at_second_key"), ("fact minute", "f_session_per_minute"), ("time minute", "created_at_minute_key"),
     ("fact hour", "f_session_per_hour"), ("time hour", "created_at_hour_key"), ("fact day", "f_session_per_day"), ("time day", "created_at_day_key"),
     ("fact week", "f_session_per_week"), ("time week", "created_at_week_key"), ("reference d_geo", "geo_key"), ("reference d_user_agent", "user_agent_key"),
     ("reference referrers", "referrer_id"), ("reference d_page_type", "page_type_key"), ("column geo_city_name of geo", "city_name"),
     ("column os of geo", "os")],
)
def _():
    for unit in m.TimeUnit:
        env = _golden(dim_prefix="d_", fact_prefix="f_", fact_infix="_per_", dim_id_column="key", time_unit=unit)
        yield f"fact {unit.label}", derive.fact_table_name(env.settings, env.fact("session"))
        yield f"time {unit.label}", derive.time_column_name(env.settings, "created_at")
    for fact in env.facts:
        yield from ((f"reference {t.name}", derive.reference_column(env, fact, t)) for t in derive.dimension_tables(env, fact))
    yield "column geo_city_name of geo", derive.dim_column_name("geo", "geo_city_name")
    yield "column os of geo", derive.dim_column_name("geo", "os")


@_constant(
    "id_types", "id_type string, reference_type string",
    [("serial", "integer"), ("smallserial", "smallint"), ("bigserial", "bigint"), ("BigSerial", "bigint"), ("uuid", "uuid"), ("integer", "integer")],
)
def _():
    yield from ((t, derive.id_type_of_reference(t)) for t in ("serial", "smallserial", "bigserial", "BigSerial", "uuid", "integer"))


@_constant(
    "type_defaults", "type_text string, default_text string",
    [("integer", "-1"), ("character varying(20)", "'x'"), ("timestamp without time zone", "'short'"), ("numeric(9,6)", "none"), ("INTEGER", "none")],
)
def _():
    defaults = {"timestamp": "'long'", "integer": "-1", "time": "'short'", "character": "'x'"}
    for t in ("integer", "character varying(20)", "timestamp without time zone", "numeric(9,6)", "INTEGER"):
        yield t, m.default_for(defaults, t) or "none"


@_constant(
    "name_suffixes", "mode string, physical_name string",
    [("full", "dim_geo{{suff}}"), ("incremental", "dim_geo"), ("full, template _new", "dim_geo_new")],
)
def _():
    env = _golden(suffix_template="{{suff}}")
    yield "full", derive.suffixed(env, m.Mode.FULL, "dim_geo")
    yield "incremental", derive.suffixed(env, m.Mode.INCREMENTAL, "dim_geo")
    yield "full, template _new", derive.suffixed(_golden(suffix_template="_new"), m.Mode.FULL, "dim_geo")


@_constant(
    "build_orders", "position int, table_name string",
    [(0, "dim_geo"), (1, "dim_user_agent"), (2, "fact_session_by_minute"), (3, "dim_page_type"), (4, "fact_page_view_by_minute")],
)
def _():
    names = derive.build_order(_golden())
    # dimensions come before the facts that read them; among themselves in any order, here by name
    first = sorted(n for n in names[: names.index("fact_session_by_minute")] if n != "dim_page_type")
    yield from enumerate([*first, "fact_session_by_minute", *(n for n in names if n not in (*first, "fact_session_by_minute"))])


@_constant(
    "public_functions", "role string, function_name string",
    [("validated description", "make_env"), ("fact table", "fact_table"), ("dimension tables", "dimension_tables"), ("lineage", "dependencies"),
     ("DDL of a dimension", "dimension_ddl"), ("DDL of a fact", "fact_ddl"), ("load of a dimension", "dimension_sql"), ("load of a fact", "fact_sql")],
)
def _():
    roles = {"validated description": api.make_env, "fact table": api.fact_table, "dimension tables": api.dimension_tables, "lineage": api.dependencies,
             "DDL of a dimension": api.dimension_ddl, "DDL of a fact": api.fact_ddl, "load of a dimension": api.dimension_sql, "load of a fact": api.fact_sql}
    yield from ((k, f.__name__) for k, f in roles.items())


# --- descriptions as text, and what may be wrong with them ---------------------------------------

_YAML = """
tables:
  - name: visits
    columns: [[id, uuid, notnull], [at, timestamp, notnull], [city, text], [spent, integer, "null"]]
    constraints: [{type: primary, column: id}, {type: unique, columns: [at, city]}, {type: foreign, table: towns, columns: [[city, name]]}]
facts:
  - name: visit
    tablename: visits
    columns: [{type: dimtime, column: at}, {type: dimval, column: city, table: place}, {type: factsum, column: s, sourcecolumn: spent}]
  - name: hidden
    tablename: visits
    persistent: false
    parentfacts: [visit]
    columns: [{type: dimtime, column: at}, {type: factcount, column: n}]
defaults: {text: "'?'", integer: "-1"}
"""


@_constant(
    "yaml_source", "node string, detail string",
    [("visits.id", "uuid not null"), ("visits.at", "timestamp not null"), ("visits.city", "text null"), ("visits.spent", "integer null"),
     ("visits", "PrimaryKey"), ("visits", "UniqueKey"), ("visits", "ForeignKey"), ("visit", "visits persistent"), ("visit.at", "DimTime of at"),
     ("visit.city", "DimVal of city"), ("visit.s", "FactSum of spent"), ("hidden", "visits, not persistent, of visit"), ("hidden.at", "DimTime of at"),
     ("hidden.n", "FactCount of nothing"), ("default text", "'?'"), ("default integer", "-1")],
)
def _():
    tables, facts, defaults = parse_text(_YAML, "here")
    for t in tables:
        yield from ((f"{t.name}.{c.name}", f"{c.type} {'null' if c.nullable else 'not null'}") for c in t.columns)
        yield from ((t.name, type(c).__name__) for c in t.constraints)
    for f in facts:
        yield f.name, f.table + (" persistent" if f.persistent else ", not persistent") + "".join(f", of {p}" for p in f.parents)
        yield from ((f"{f.name}.{c.column}", f"{type(c).__name__} of {c.source or 'nothing'}") for c in f.columns)
    yield from ((f"default {k}", v) for k, v in defaults.items())


@_constant(
    "description_errors", "fault string, n int",
    [("no tables", 1), ("short column", 1), ("odd nullability", 1), ("odd constraint", 1), ("odd fact column", 1), ("sum of nothing", 1), ("number as default", 1),
     ("no YAML", 1), ("nothing wrong", 0)],
)
def _():
    cases = {
        "no tables": _YAML.replace("tables:", "table:", 1), "short column": _YAML.replace("[city, text]", "[city]"), "odd nullability": _YAML.replace('"null"', "maybe"),
        "odd constraint": _YAML.replace("type: unique", "type: check"), "odd fact column": _YAML.replace("dimtime", "dimdate"),
        "sum of nothing": _YAML.replace(", sourcecolumn: spent", ""), "number as default": _YAML.replace('"-1"', "-1"), "no YAML": "tables: [", "nothing wrong": _YAML,
    }
    for name, text in cases.items():
        try:
            parse_text(text, "here")
            yield name, 0
        except SpecError:
            yield name, 1


def _changed(table: str, change) -> list[dict]:
    return [t | change(t) if t["name"] == table else t for t in _GOLDEN_TABLES]


_KEYED = [{"type": "primary", "column": "id"}]
_CASES = {
    "missing columns of keys": dict(tables=_changed("referrers", lambda t: {"constraints": [{"type": "primary", "column": "x"}, {"type": "unique", "columns": ["y", "name"]}]})),
    "missing table and column of a foreign key": dict(tables=_changed("referrers", lambda t: {"constraints": [
        {"type": "foreign", "table": "gone", "columns": [["name", "n"]]}, {"type": "foreign", "table": "session_events", "columns": [["z", "w"]]}]})),
    "missing source table": dict(facts=[q._fact("f", "nowhere", "dimtime created_at")]),
    "missing parent": dict(facts=[q._fact("f", "referrers", "dimtime id", parents=("nobody",))]),
    "missing source column": dict(facts=[q._fact("f", "session_events", "dimtime created_at", "factsum s spent")]),
    "missing target of a reference": dict(facts=[q._fact("f", "session_events", "dimtime created_at", "dimid publisher_id publishers")]),
    "no time": dict(facts=[q._fact("f", "session_events", "factcount n")]),
    "time that may be null": dict(facts=[q._fact("f", "page_view_events", "dimtime referrer_id")]),
    "no default for the type": dict(facts=[q._fact("f", "session_events", "dimtime created_at", "nodimid created_at")]),
    "everything twice": dict(tables=[*_GOLDEN_TABLES, _GOLDEN_TABLES[2] | {"columns": _GOLDEN_TABLES[2]["columns"] * 2}], facts=[q._fact("f", "session_events", "dimtime created_at")] * 2),
    "parents in a circle": dict(facts=[q._fact("a", "session_events", "dimtime created_at", parents=("b",)), q._fact("b", "session_events", "dimtime created_at", parents=("a",))]),
    "parent without a key": dict(tables=_changed("page_view_events", lambda t: {"constraints": _KEYED})),
    "distinct count without a key": dict(tables=_changed("session_events", lambda t: {"constraints": []}),
                                         facts=[q._fact("f", "session_events", "dimtime created_at", "factcountdistinct n")]),
    "nothing wrong": {},
}


@_constant(
    "validation_faults", "description string, position int, fault string",
    [("missing columns of keys", 0, "MissingColumn(referrers, x)"), ("missing columns of keys", 1, "MissingColumn(referrers, y)"),
     ("missing table and column of a foreign key", 0, "MissingTable(gone)"), ("missing table and column of a foreign key", 1, "MissingColumn(referrers, z)"),
     ("missing table and column of a foreign key", 2, "MissingColumn(session_events, w)"), ("missing source table", 0, "MissingTable(nowhere)"),
     ("missing parent", 0, "MissingFact(nobody)"), ("missing source column", 0, "MissingColumn(session_events, spent)"),
     ("missing target of a reference", 0, "MissingTable(publishers)"), ("no time", 0, "MissingTimeColumn(f)"),
     ("time that may be null", 0, "MissingNotNullConstraint(page_view_events, referrer_id)"), ("no default for the type", 0, "MissingTypeDefault(timestamp without time zone)"),
     ("everything twice", 0, "DuplicateTable(referrers)"), ("everything twice", 1, "DuplicateFact(f)"), ("everything twice", 2, "DuplicateColumn(id)"),
     ("everything twice", 3, "DuplicateColumn(publisher_id)"), ("everything twice", 4, "DuplicateColumn(name)"),
     ("parents in a circle", 0, "CyclicParents(a, b, a)"), ("parents in a circle", 1, "CyclicParents(b, a, b)"),
     ("parent without a key", 0, "MissingForeignKey(page_view_events, session_events)"), ("distinct count without a key", 0, "MissingPrimaryKey(f, n)")],
)
def _():
    for name, case in _CASES.items():
        parts = parse_spec({"tables": _GOLDEN_TABLES, "facts": [q._SESSION, q._PAGE_VIEW], "defaults": q._DEFAULTS} | case)
        defaults = {k: v for k, v in parts[2].items() if name != "no default for the type" or k != "timestamp"}
        try:
            make_env(parts[0], parts[1], None, defaults)
        except InvalidDescription as e:
            # the place of a repeated column is told by its name alone here: both tables of that name have it
            faults = dict.fromkeys(f"DuplicateColumn({f.subject[-1]})" if f.kind == "DuplicateColumn" else str(f) for f in e.faults)
            yield from ((name, i, f) for i, f in enumerate(faults))


# --- command line -----------------------------------------------------------------------------


@_constant(
    "settings_options", "option string, default_value string",
    [("--dim-prefix", "dim_"), ("--fact-prefix", "fact_"), ("--timeunit", "minute"), ("--avg-count-col-suffix", "_count"), ("--avg-sum-col-suffix", "_sum"),
     ("--dim-id-col-name", "id"), ("--dim-id-col-type", "serial"), ("--fact-count-col-type", "integer"), ("--fact-count-distinct-error-rate", "0.05"),
     ("--fact-infix", "_by_"), ("--dependencies-json-file", "dependencies.json"), ("--facts-json-file", "facts.json"), ("--dimensions-json-file", "dimensions.json"),
     ("--foreign-key-id-coalesce-val", "-1"), ("--tablename-suffix-template", "{{suff}}")],
)
def _():
    for action in cli.parser()._actions:
        option = action.option_strings[-1] if action.option_strings else ""
        if option == "--timeunit" or option in cli._OPTIONS:
            yield option, str(action.default)


_VISIT_JSON = [
    ("dependencies.json", '{"dim_place": ["visits"], "fact_visit_by_minute": ["visits", "dim_place"], "fact_hidden_by_minute": ["visits", "dim_place"]}'),
    ("dimensions.json", '["dim_place"]'),
    ("facts.json", '["fact_visit_by_minute"]'),
]


@_constant(
    "output_files", "path string, head string",
    [("create/dim_place.sql", "create table dim_place{{suff}} ("), ("create/fact_visit_by_minute.sql", "create table fact_visit_by_minute{{suff}} ("),
     ("fullrefresh/dim_place.sql", "insert into `dim_place{{suff}}` (`id`, `city`)"),
     ("fullrefresh/fact_visit_by_minute.sql", "insert into `fact_visit_by_minute{{suff}}` (`at_minute_id`, `s`, `place_id`)"),
     ("increfresh/dim_place.sql", "insert into `dim_place` (`id`, `city`)"),
     ("increfresh/fact_visit_by_minute.sql", "insert into `fact_visit_by_minute` (`at_minute_id`, `s`, `place_id`)"), *_VISIT_JSON],
)
def _():
    """The files of a description with a fact that is not persistent: it has no files, but its lineage is told."""
    text = _YAML.replace(", {type: foreign, table: towns, columns: [[city, name]]}", "")
    tables, facts, defaults = parse_text(text, "here")
    env = make_env(tables, facts, None, defaults)
    for path, content in cli.files_of(env).items():
        yield path, json.dumps(json.loads(content)) if path.endswith(".json") else content.split("\n")[0]


@_constant(
    "load_parameters", "statement string, position int, bound string",
    [("dimension full", 0, "end, exclusive"), ("dimension incremental", 0, "end, exclusive"), ("dimension incremental", 1, "start, inclusive"),
     ("fact full", 0, "end, exclusive"), ("fact incremental", 0, "end, exclusive"), ("fact incremental", 1, "start, inclusive")],
)
def _():
    env = _golden()
    fact = env.fact("session")
    for mode in m.Mode:
        for kind, text in (("dimension", sqltext.dimension_sql(env, fact, "geo", mode)), ("fact", sqltext.fact_sql(env, fact, mode))):
            for i, before in enumerate(text.split("?")[:-1]):
                sign = before.rsplit("`created_at` ", 1)[1].split()[0]
                yield f"{kind} {mode.value}", i, {"<": "end, exclusive", ">=": "start, inclusive"}[sign]


# --- loads ---------------------------------------------------------------------------------------


def _run_text(spark: SparkSession, folder: str, text: str, tables: list[str], columns: list[str], *bounds) -> DataFrame:
    """The rows that an emitted statement inserts."""
    for t in tables:
        q.table(spark, folder, t).createOrReplaceTempView(t)
    return spark.sql(text.split("\n", 1)[1].rstrip(";\n"), args=[str(b) for b in bounds]).toDF(*columns)


@q.query("sql_text_fact", q._session_sql())
def _(spark, folder):
    env = q.environment(q._SESSION, suffix_template="")
    fact = env.fact("session")
    columns = [c.name for c in derive.fact_table(env, fact).columns]
    return _run_text(spark, folder, sqltext.fact_sql(env, fact, m.Mode.FULL), ["session_events", "dim_geo", "dim_user_agent"], columns, q.END)


@q.query("sql_text_fact_window", q._session_sql(f"created_at >= timestamp '{q._CUT1}' and created_at < timestamp '{q._CUT2}'"))
def _(spark, folder):
    env = q.environment(q._SESSION)
    fact = env.fact("session")
    columns = [c.name for c in derive.fact_table(env, fact).columns]
    text = sqltext.fact_sql(env, fact, m.Mode.INCREMENTAL)
    return _run_text(spark, folder, text, ["session_events", "dim_geo", "dim_user_agent"], columns, q._CUT2, q._CUT1)


@q.query("sql_text_dimension", q._numbered("country_name, city_name, continent_name", q._GEO))
def _(spark, folder):
    env = q.environment(q._SESSION, suffix_template="")
    text = sqltext.dimension_sql(env, env.fact("session"), "geo", m.Mode.FULL)
    return _run_text(spark, folder, text, ["session_events"], ["id", "country_name", "city_name", "continent_name"], q.END)


@q.query(
    "fact_parent_not_needed",
    "select cast(floor(epoch(ts) / 86400) as bigint) as ts_day_id, cast(count(*) as integer) as n, cast(coalesce(d.id, -1) as integer) as kind_id"
    " from events e left join (select row_number() over (order by event_type) as id, event_type from (select distinct event_type from events"
    " where event_type is not null)) d on e.event_type = d.event_type group by 1, 3",
)
def _(spark, folder):
    """A parent whose dimensions the fact has itself is not joined: its table, every row twice, would double the counts."""
    facts = [q._fact("base", "events", "dimtime ts", "dimval event_type kind", "factcount n"),
             q._fact("own", "events", "dimtime ts", "dimval event_type kind", "factcount n", parents=("base",))]
    env = q.environment(*facts, time_unit=m.TimeUnit.DAY)
    events = q.table(spark, folder, "events")
    kind = api.dimension_full(env, env.fact("own"), "kind", events, q.END)
    return load_fact(env, env.fact("own"), q.resolver(spark, folder, dim_kind=kind), q.END)


# --- tables --------------------------------------------------------------------------------------


@q.query("insert_select", "select r_name, r_regionkey from region union all select r_name, r_regionkey + 100 from region")
def _(spark, folder):
    """Rows are appended by name, whatever the order of their columns."""
    store, region = TableStore(spark, q._scratch(spark, "insert")), q.table(spark, folder, "region").select("r_regionkey", "r_name")
    store.append("kept", region)
    more = region.select("r_name", (F.col("r_regionkey") + 100).cast(region.schema["r_regionkey"].dataType).alias("r_regionkey"), F.lit(1).alias("other"))
    store.append("kept", more, ["r_name", "r_regionkey"])
    return store.read("kept").select("r_name", "r_regionkey")


@q.query(
    "create_table",
    _values("position int, column_name string, column_type string",
            [(0, "created_at_minute_id", "bigint"), (1, "publisher_id", "int"), (2, "session_count", "int"), (3, "geo_id", "int"), (4, "user_agent_id", "int"), (5, "rows", "0")]),
)
def _(spark, folder):
    """A table that is created twice, and has no rows."""
    store, env = TableStore(spark, q._scratch(spark, "create")), _golden()
    schema = m.spark_schema(derive.fact_table(env, env.fact("session")))
    for _ in range(2):
        store.create("f", schema)
    made = store.read("f")
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(made.schema)]
    return spark.createDataFrame([*rows, (len(rows), "rows", str(made.count()))], "position int, column_name string, column_type string")


_EVENT = q._fact("event", "events", "dimtime ts", "nodimid user_id", "dimval event_type kind", "factcount n")
_EVENT_DAYS = (
    "select cast(floor(epoch(ts) / 86400) as bigint) as ts_day_id, user_id, event_type, cast(count(*) as bigint) as n, count(distinct 1) as n_rows from events"
    " where event_type is not null group by 1, 2, 3"
)


def _told(store: TableStore, table: str) -> DataFrame:
    """A fact's rows with their dimension values, put together: what is stored twice shows in ``n_rows`` and ``n``."""
    kinds = store.read("dim_kind").select(F.col("id").alias("kind_id"), "event_type")
    rows = store.read(table).join(kinds, "kind_id").groupBy("ts_day_id", "user_id", "event_type")
    return rows.agg(F.sum("n").cast("bigint").alias("n"), F.count(F.lit(1)).alias("n_rows"))


@q.query("refresh_repeated_window", _EVENT_DAYS)
def _(spark, folder):
    """Windows one after the other, each loaded twice: the second load changes nothing."""
    env = q.environment(_EVENT, time_unit=m.TimeUnit.DAY)
    store = TableStore(spark, q._scratch(spark, "refresh"), folder)
    for start, end in ((build.BEGINNING, q._CUT1), (q._CUT1, q._CUT2), (q._CUT2, q.END)):
        for _ in range(2):
            build.incremental_refresh(env, store, end, start)
    return _told(store, "fact_event_by_day")


@q.query("refresh_merged_windows", _EVENT_DAYS)
def _(spark, folder):
    """Windows that cut a day: its rows are put together, and no other file is written again."""
    env = q.environment(_EVENT, time_unit=m.TimeUnit.DAY)
    store = TableStore(spark, q._scratch(spark, "merge"), folder)
    for start, end in ((build.BEGINNING, q._UNALIGNED), (q._UNALIGNED, q.END)):
        build.incremental_refresh(env, store, end, start, merge=True)
    return _told(store, "fact_event_by_day")


@q.query("refresh_full", _EVENT_DAYS)
def _(spark, folder):
    """A full refresh over a table that an increment left: the new files replace the old ones in one commit."""
    env = q.environment(_EVENT, time_unit=m.TimeUnit.DAY)
    store = TableStore(spark, q._scratch(spark, "full"), folder)
    build.incremental_refresh(env, store, q._CUT1, build.BEGINNING)
    build.full_refresh(env, store, q.END)
    return _told(store, "fact_event_by_day")


@q.query(
    "tenant_layout",
    "select publisher_id, cast(count(*) as bigint) as n_sessions, true as files_in_order from session_events group by 1",
)
def _(spark, folder):
    """A fact with a tenant, written in ranges of (tenant, time): no file reaches into the range of another."""
    env = q.environment(q._fact("load", "session_events", "dimtime created_at", "tenantid publisher_id", "factcount n"))
    store = TableStore(spark, q._scratch(spark, "layout"), folder)
    build.full_refresh(env, store, q.END)
    name = derive.fact_table_name(env.settings, env.facts[0])
    key = F.struct("publisher_id", "created_at_minute_id")
    rows = spark.read.parquet(*[f"{store.path(name)}/{f}" for f in store.table(name).latest().files])
    ranges = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    ranges = sorted((tuple(r["lo"]), tuple(r["hi"])) for r in ranges.collect())  # a row for each file
    in_order = all(hi < lo for (_, hi), (lo, _) in zip(ranges, ranges[1:]))
    return store.read(name).groupBy("publisher_id").agg(F.sum("n").cast("bigint").alias("n_sessions"), F.lit(in_order).alias("files_in_order"))
