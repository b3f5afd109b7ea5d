"""DDL text of the derived tables, and queries that check what the text declares.

Plain parquet tables enforce nothing, so the constraints become DataFrames of offending
rows (``key_violations``, ``reference_violations``) and the indexes a layout proposal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.plans import derive
from starloom.plans import model as m


def _wrapped(head: str, items: list[str]) -> str:
    """Items on one line, or one a line below each other when the line would get long."""
    line = f"{head}({', '.join(items)})"
    if len(line) < 72:
        return line
    return f"{head}({(',' + chr(10) + ' ' * (len(head) + 1)).join(items)})"


def create_table(env: m.Env, table: m.Table) -> str:
    name = derive.suffixed(env, m.Mode.FULL, table.name)
    body = [f"  {c.name} {c.type} {'null' if c.nullable else 'not null'}" for c in table.columns]
    return f"create table {name} (\n" + ",\n".join(body) + "\n)\n;\n"


def add_constraints(env: m.Env, table: m.Table) -> list[str]:
    name = derive.suffixed(env, m.Mode.FULL, table.name)
    out = []
    for c in table.constraints:
        match c:
            case m.PrimaryKey(column):
                out.append(f"alter table {name} add primary key ({column});\n")
            case m.UniqueKey(columns):
                out.append(_wrapped(f"alter table {name} add unique ", list(columns)) + ";\n")
            case m.ForeignKey(target, pairs):
                local, remote = ", ".join(a for a, _ in pairs), ", ".join(b for _, b in pairs)
                out.append(
                    f"alter table {name} add foreign key ({local}) references {target} ({remote})"
                    " on update restrict on delete restrict;\n"
                )
    return out


def dimension_indexes(table: m.Table) -> list[tuple[str, ...]]:
    """One index for each column beside the id; none if there is only one, its unique key serves."""
    names = [(c.name,) for c in table.columns if c.name != table.primary_key()]
    return names if len(names) > 1 else []


def fact_indexes(env: m.Env, fact: m.Fact) -> list[tuple[str, ...]]:
    """Time and plain keys, then references, then (tenant, time) for the first tenant."""
    s = env.settings
    out: list[tuple[str, ...]] = []
    for c in fact.of_kind(m.DimTime, *m.KEY_KINDS):
        out.append((time_column_name(env, c),) if isinstance(c, m.DimTime) else (c.column,))
    out += [(derive.reference_column(env, o, t),) for o, t in derive.all_dimension_tables(env, fact)]
    if tenants := fact.of_kind(m.TenantId):
        out.append((tenants[0].column, derive.time_column_name(s, fact.time_column())))
    return out


def time_column_name(env: m.Env, column: m.FactColumn) -> str:
    return derive.time_column_name(env.settings, column.column)


def _index_text(env: m.Env, table: m.Table, indexes: list[tuple[str, ...]]) -> list[str]:
    name = derive.suffixed(env, m.Mode.FULL, table.name)
    return [f"create index  on {name} ({', '.join(i)})\n;\n" for i in indexes]


def dimension_ddl(env: m.Env, table: m.Table) -> list[str]:
    return [create_table(env, table), *add_constraints(env, table), *_index_text(env, table, dimension_indexes(table))]


def fact_ddl(env: m.Env, fact: m.Fact) -> list[str]:
    table = derive.fact_table(env, fact)
    return [create_table(env, table), *add_constraints(env, table), *_index_text(env, table, fact_indexes(env, fact))]


def write_layout(env: m.Env, fact: m.Fact) -> dict[str, list[str]]:
    """Layout that serves the same reads as the indexes: tenant first, then time."""
    tenants = [c.column for c in fact.of_kind(m.TenantId)][:1]
    return {"partition_by": tenants, "sort_by": [derive.time_column_name(env.settings, fact.time_column())]}


# --- checks -------------------------------------------------------------------------


def key_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once, with ``n_rows``. Rows with a null in the key never clash."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(complete).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def reference_violations(df: DataFrame, target: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``df`` whose complete reference has no row in ``target``."""
    complete = reduce(lambda a, b: a & b, [F.col(a).isNotNull() for a, _ in pairs])
    keys = target.select(*[F.col(b).alias(f"__ref_{i}") for i, (_, b) in enumerate(pairs)])
    condition = reduce(lambda a, b: a & b, [F.col(a) == F.col(f"__ref_{i}") for i, (a, _) in enumerate(pairs)])
    return df.filter(complete).join(keys, condition, "left_anti")
