"""Star schema derived from a description: dimension and fact tables, names, lineage."""

from __future__ import annotations

from starloom.plans import model as m


class DerivationError(ValueError):
    pass


# --- names --------------------------------------------------------------------------


def dim_column_name(dim: str, column: str) -> str:
    """Column name inside the dimension: ``geo_city`` of dimension ``geo`` is ``city``."""
    return column.removeprefix(f"{dim}_")


def time_column_name(settings: m.Settings, column: str) -> str:
    return f"{column}_{settings.time_unit.label}_{settings.dim_id_column}"


def fact_table_name(settings: m.Settings, fact: m.Fact) -> str:
    return f"{settings.fact_prefix}{fact.name}{settings.fact_infix}{settings.time_unit.label}"


def suffixed(env: m.Env, mode: m.Mode, name: str) -> str:
    """Physical table name: a full load goes to a staging table, an increment to the real one."""
    return name + env.settings.suffix_template if mode is m.Mode.FULL else name


def id_type_of_reference(type_text: str) -> str:
    """Type of a foreign key onto an id of this type."""
    plain = {"serial": "integer", "smallserial": "smallint", "bigserial": "bigint"}
    return plain.get(type_text.lower(), type_text)


# --- dimensions ---------------------------------------------------------------------


def new_dimension_columns(fact: m.Fact) -> dict[str, list[str]]:
    """Source columns of each derived dimension of this fact, dimensions in name order."""
    found: dict[str, list[str]] = {}
    for c in fact.of_kind(m.DimVal):
        columns = found.setdefault(c.table, [])
        if c.column not in columns:
            columns.append(c.column)
    return dict(sorted(found.items()))


def dimension_tables(env: m.Env, fact: m.Fact) -> list[m.Table]:
    """Existing tables the fact points at, then the dimensions derived from its own values."""
    s = env.settings
    out: list[m.Table] = []
    for c in fact.of_kind(m.DimId):
        table = env.table(c.table)
        if table not in out:
            out.append(table)
    source = env.table(fact.table)
    for dim, columns in new_dimension_columns(fact).items():
        named = [(dim_column_name(dim, c), source.column(c)) for c in columns]
        names = [s.dim_id_column, *(n for n, _ in named)]
        if len(set(names)) != len(names):
            raise DerivationError(f"dimension {dim}: column names clash once the prefix is removed: {names}")
        body = tuple(m.Column(n, c.type, False) for n, c in named)
        out.append(
            m.Table(
                s.dim_prefix + dim,
                (m.Column(s.dim_id_column, s.dim_id_type, False), *body),
                (m.PrimaryKey(s.dim_id_column), m.UniqueKey(tuple(c.name for c in body))),
            )
        )
    return out


def all_dimension_tables(env: m.Env, fact: m.Fact) -> list[tuple[m.Fact, m.Table]]:
    """Own dimensions, then those inherited from parents, each with the fact that owns it.

    Equal tables count once (first owner). Two different tables of one name are an error.
    """
    out: list[tuple[m.Fact, m.Table]] = [(fact, t) for t in dimension_tables(env, fact)]
    for parent in fact.parents:
        out += all_dimension_tables(env, env.fact(parent))
    kept: dict[str, tuple[m.Fact, m.Table]] = {}
    for owner, table in out:
        if table.name in kept and kept[table.name][1] != table:
            raise DerivationError(f"dimension {table.name} is derived twice, with different columns")
        kept.setdefault(table.name, (owner, table))
    return list(kept.values())


def is_existing(env: m.Env, table: m.Table) -> bool:
    return table in env.tables


def reference_column(env: m.Env, owner: m.Fact, table: m.Table) -> str:
    """Name of the fact column that refers to this dimension."""
    if is_existing(env, table):
        return next(c.column for c in owner.of_kind(m.DimId) if c.table == table.name)
    return f"{table.name.removeprefix(env.settings.dim_prefix)}_{env.settings.dim_id_column}"


# --- facts --------------------------------------------------------------------------


def fact_table(env: m.Env, fact: m.Fact) -> m.Table:
    """Columns in the order they are described, inherited references last; all NOT NULL."""
    s, source = env.settings, env.table(fact.table)
    columns: list[m.Column] = []
    key: list[str] = []

    def add(name: str, type_text: str, is_key: bool = False) -> None:
        columns.append(m.Column(name, type_text, False))
        if is_key:
            key.append(name)

    for c in fact.columns:
        match c:
            case m.DimTime():
                add(time_column_name(s, c.column), "bigint", True)
            case m.NoDimId() | m.TenantId():
                add(c.column, source.column(c.column).type, True)
            case m.FactCount():
                add(c.column, s.count_type)
            case m.FactCountDistinct():
                add(c.column, "json")
            case m.FactAverage():
                add(c.column + s.avg_count_suffix, s.count_type)
                add(c.column + s.avg_sum_suffix, source.column(c.source).type)
            case m.FactSum() | m.FactMax() | m.FactMin():
                add(c.column, source.column(c.source).type)
    for owner, table in all_dimension_tables(env, fact):
        id_name = table.primary_key() if is_existing(env, table) else s.dim_id_column
        id_column = table.column(id_name) if id_name else None
        id_type = id_column.type if id_column else s.dim_id_type
        add(reference_column(env, owner, table), id_type_of_reference(id_type), True)
    return m.Table(fact_table_name(s, fact), tuple(columns), (m.UniqueKey(tuple(key)),))


# --- lineage ------------------------------------------------------------------------


def ancestors(env: m.Env, fact: m.Fact) -> list[m.Fact]:
    """Parents and their parents, depth first."""
    out: list[m.Fact] = []
    for name in fact.parents:
        parent = env.fact(name)
        out += [parent, *ancestors(env, parent)]
    return out


def dependencies(env: m.Env, fact: m.Fact) -> dict[str, list[str]]:
    """Upstream tables of the fact table and of each dimension the fact derives."""
    s = env.settings
    family = [fact, *ancestors(env, fact)]
    upstream = [f.table for f in family]
    for f in family:
        for c in f.columns:
            if isinstance(c, m.DimVal):
                upstream.append(s.dim_prefix + c.table)
            elif isinstance(c, m.DimId):
                upstream.append(c.table)
    out = {s.dim_prefix + dim: [fact.table] for dim in new_dimension_columns(fact)}
    out[fact_table_name(s, fact)] = list(dict.fromkeys(upstream))
    return out


def all_dependencies(env: m.Env) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for fact in env.facts:
        for name, upstream in dependencies(env, fact).items():
            out.setdefault(name, upstream)
    return out


def build_order(env: m.Env) -> list[str]:
    """Derived tables, each after the derived tables it reads."""
    todo = all_dependencies(env)
    out: list[str] = []

    def visit(name: str) -> None:
        if name in todo and name not in out:
            for up in todo[name]:
                visit(up)
            out.append(name)

    for name in todo:
        visit(name)
    return out
