"""Loads as Spark SQL text, for runners that execute statements rather than Python.

The statements do what ``operators.dimension`` and ``operators.fact`` do. Parameters are positional:
the end of the window (exclusive), and for increments its start (inclusive) after it; pass times as
text, ``spark.sql(text, args=["2024-03-01 00:00:00"])``. Full loads name the table with its suffix.
"""

from __future__ import annotations

from starloom.functions.exprs import default_sql
from starloom.functions.sketch import bucket_count
from starloom.plans import derive
from starloom.plans import model as m
from starloom.plans.model import spark_type


def _name(identifier: str) -> str:
    return f"`{identifier}`"


def _cast(expression: str, type_text: str) -> str:
    return f"cast({expression} as {spark_type(type_text).simpleString()})"


def _value(env: m.Env, table: m.Table, column: str, alias: str) -> str:
    c = table.column(column)
    ref = f"{alias}.{_name(column)}"
    return f"coalesce({ref}, {default_sql(env.default_for(c.type), c.type)})" if c.nullable else ref


def _window(ref: str, mode: m.Mode) -> str:
    upper = f"{ref} < cast(? as timestamp_ntz)"
    return upper if mode is m.Mode.FULL else f"{upper}\n  and {ref} >= cast(? as timestamp_ntz)"


def _bucket(ref: str, unit: m.TimeUnit) -> str:
    seconds = f"cast(unix_date(cast({ref} as date)) as bigint) * 86400 + hour({ref}) * 3600 + minute({ref}) * 60 + second({ref})"
    return f"cast(floor(({seconds}) / {unit.value}) as bigint)"


def dimension_sql(env: m.Env, fact: m.Fact, dim: str, mode: m.Mode) -> str:
    """Statement that loads a derived dimension from one of the facts that feed it."""
    s, source = env.settings, env.table(fact.table)
    table = s.dim_prefix + dim
    columns = derive.new_dimension_columns(fact)[dim]
    named = {c: derive.dim_column_name(dim, c) for c in columns}
    order = ", ".join(_name(d) for d in named.values())
    values = ",\n    ".join(f"{_value(env, source, c, 's')} as {_name(d)}" for c, d in named.items())
    some = " or ".join(f"s.{_name(c)} is not null" for c in columns)
    number, anti = f"row_number() over (order by {order})", ""
    if mode is m.Mode.INCREMENTAL:
        number += f" + (select coalesce(max({_name(s.dim_id_column)}), 0) from {_name(table)})"
        same = " and ".join(f"d.{_name(d)} = x.{_name(d)}" for d in named.values())
        anti = f"\nleft anti join {_name(table)} d on {same}"
    return (
        f"insert into {_name(derive.suffixed(env, mode, table))} ({_name(s.dim_id_column)}, {order})\n"
        f"select {_cast(number, s.dim_id_type)}, {order}\n"
        f"from (\n  select distinct\n    {values}\n  from {_name(fact.table)} s\n"
        f"  where ({some})\n  and {_window('s.' + _name(fact.time_column()), mode)}\n) x{anti}\n;\n"
    )


def fact_sql(env: m.Env, fact: m.Fact, mode: m.Mode) -> str:
    """Statement that loads a fact table: keys and inputs row by row, then one aggregation. With distinct counts there are two:
    rows are grouped by register first, each sketch's registers under its own number, and their partial results
    per key after that, so that the sources are read once."""
    s, source = env.settings, env.table(fact.table)
    target = derive.fact_table(env, fact)
    dims = derive.all_dimension_tables(env, fact)
    alias = {fact.table: "s0"}
    for owner, _ in dims:
        alias.setdefault(owner.table, f"s{len(alias)}")

    keys: dict[str, str] = {}
    inputs: dict[str, str] = {}
    first: dict[str, str] = {}  # aggregates over rows
    again: dict[str, str] = {}  # over the results of the first
    sketches: dict[str, str] = {}
    for i, c in enumerate(fact.columns):
        at = _name(f"in{i}")
        match c:
            case m.DimTime():
                keys[derive.time_column_name(s, c.column)] = _bucket(f"s0.{_name(c.column)}", s.time_unit)
            case m.NoDimId() | m.TenantId():
                keys[c.column] = _value(env, source, c.column, "s0")
            case m.FactCountDistinct():
                inputs[f"in{i}"] = f"s0.{_name(c.source or source.primary_key())}"
                sketches[c.column] = at
            case m.Measure():
                if c.source is not None:
                    inputs[f"in{i}"] = f"s0.{_name(c.source)}"
                every = "count(case when r.s = 0 then 1 end)" if fact.of_kind(m.FactCountDistinct) else "count(*)"
                own = f"case when r.s = 0 then {at} end" if fact.of_kind(m.FactCountDistinct) else at
                match c:
                    case m.FactCount():
                        first[c.column], again[c.column] = every if c.source is None else f"count({own})", "sum"
                    case m.FactAverage():
                        first[c.column + s.avg_count_suffix], again[c.column + s.avg_count_suffix] = f"count({own})", "sum"
                        first[c.column + s.avg_sum_suffix], again[c.column + s.avg_sum_suffix] = f"sum({own})", "sum"
                    case _:
                        how = {m.FactSum: "sum", m.FactMax: "max", m.FactMin: "min"}[type(c)]
                        first[c.column], again[c.column] = f"{how}({own})", how
    for owner, table in dims:
        name = derive.reference_column(env, owner, table)
        a = alias[owner.table]
        if derive.is_existing(env, table):
            column = next(c.column for c in owner.of_kind(m.DimId) if c.table == table.name)
            keys[name] = f"coalesce({a}.{_name(column)}, {s.missing_id})"
            continue
        dim = table.name.removeprefix(s.dim_prefix)
        pairs = [(derive.dim_column_name(dim, c), _value(env, env.table(owner.table), c, a)) for c in derive.new_dimension_columns(owner)[dim]]
        same = " and ".join(f"d.{_name(d)} = {v}" for d, v in pairs)
        dim_table = _name(derive.suffixed(env, mode, table.name))
        keys[name] = f"coalesce((select d.{_name(s.dim_id_column)} from {dim_table} d where {same}), {s.missing_id})"

    joins = ""
    for name, a in list(alias.items())[1:]:
        key = next(k for k in source.foreign_keys() if k.table == name)
        on = " and ".join(f"s0.{_name(x)} = {a}.{_name(y)}" for x, y in key.columns)
        joins += f"\n  left join {_name(name)} {a} on {on}"
    items = ",\n    ".join(f"{e} as {_name(k)}" for k, e in (keys | inputs).items())
    by = ", ".join(_name(k) for k in keys)
    ctes = [f"keyed as (\n  select\n    {items}\n  from {_name(fact.table)} s0{joins}\n  where {_window('s0.' + _name(fact.time_column()), mode)}\n)"]
    measures = "".join(f", {v} as {_name(k)}" for k, v in first.items())
    rows = "keyed"
    if sketches:
        buckets = bucket_count(s.distinct_error_rate)
        entries = []
        for n, at in enumerate(sketches.values()):
            h = f"cast(conv(substr(md5(cast(cast({at} as string) as binary)), 1, 8), 16, 10) as bigint)"
            entries.append(f"named_struct('s', {n}, 'b', {h} & {buckets - 1}, 'low', {h} & 2147483647)")
        ctes.append(f"spread as (\n  select *, explode(array({(',' + chr(10) + '    ').join(entries)})) as r\n  from keyed\n)")
        rho = "cast(32 - length(bin(min(r.low))) as int) as rho"
        ctes.append(f"by_register as (\n  select {by}, r.s as s, r.b as b{measures}, {rho}\n  from spread group by {by}, r.s, r.b\n)")
        measures = "".join(f", {again[k]}({_name(k)}) as {_name(k)}" for k in first)
        for n, name in enumerate(sketches):
            own = f"case when s = {n} and b is not null then struct(cast(b as string) as k, rho as v) end"
            measures += f", to_json(map_from_entries(sort_array(collect_list({own})))) as {_name(name)}"
        rows = "by_register"
    ctes.append(f"grouped as (\n  select {by}{measures}\n  from {rows} group by {by}\n)")
    columns = ", ".join(_name(c.name) for c in target.columns)
    out = ", ".join(_cast(f"g.{_name(c.name)}", c.type) for c in target.columns)
    return (
        f"insert into {_name(derive.suffixed(env, mode, target.name))} ({columns})\nwith {(',' + chr(10)).join(ctes)}\n"
        f"select {out}\nfrom grouped g\n;\n"
    )
