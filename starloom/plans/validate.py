"""Checks on a description. All faults are collected before anything is raised."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from starloom.plans import derive
from starloom.plans import model as m


@dataclass(frozen=True)
class Fault:
    """``kind`` is one of the names used below; ``subject`` says where."""

    kind: str
    subject: tuple[str, ...]

    def __str__(self) -> str:
        return f"{self.kind}({', '.join(self.subject)})"


class InvalidDescription(ValueError):
    def __init__(self, faults: list[Fault]):
        super().__init__("; ".join(map(str, faults)))
        self.faults = faults


class _Checker:
    def __init__(self, tables: list[m.Table], facts: list[m.Fact], defaults: dict[str, str]):
        self.tables = {t.name: t for t in reversed(tables)}
        self.facts = {f.name: f for f in reversed(facts)}
        self.defaults = defaults

    def missing_columns(self, table: m.Table, names: Iterable[str]) -> list[Fault]:
        return [Fault("MissingColumn", (table.name, n)) for n in names if table.column(n) is None]

    def table_faults(self, table: m.Table) -> list[Fault]:
        out: list[Fault] = []
        for c in table.constraints:
            match c:
                case m.PrimaryKey(column):
                    out += self.missing_columns(table, [column])
                case m.UniqueKey(columns):
                    out += self.missing_columns(table, columns)
                case m.ForeignKey(target, pairs):
                    out += self.missing_columns(table, [a for a, _ in pairs])
                    if target in self.tables:
                        out += self.missing_columns(self.tables[target], [b for _, b in pairs])
                    else:
                        out.append(Fault("MissingTable", (target,)))
        return out

    def fact_faults(self, fact: m.Fact, path: tuple[str, ...] = ()) -> list[Fault]:
        if fact.name in path:
            return [Fault("CyclicParents", (*path, fact.name))]
        source = self.tables.get(fact.table)
        if source is None:
            return [Fault("MissingTable", (fact.table,))]
        out = self.table_faults(source)
        for name in fact.parents:
            if name in self.facts:
                out += self.fact_faults(self.facts[name], (*path, fact.name))
            else:
                out.append(Fault("MissingFact", (name,)))
        for c in fact.columns:
            if c.source is not None:
                out += self.missing_columns(source, [c.source])
            if isinstance(c, m.DimId) and c.table not in self.tables:
                out.append(Fault("MissingTable", (c.table,)))
            if isinstance(c, m.FactCountDistinct) and c.source is None and source.primary_key() is None:
                out.append(Fault("MissingPrimaryKey", (fact.name, c.column)))
        times = fact.of_kind(m.DimTime)
        if not times:
            out.append(Fault("MissingTimeColumn", (fact.name,)))
        for c in times:
            if (column := source.column(c.column)) and column.nullable:
                out.append(Fault("MissingNotNullConstraint", (fact.table, c.column)))
        for c in fact.of_kind(m.DimVal, m.NoDimId, m.TenantId, m.DimId):
            column = source.column(c.column)
            if column and m.default_for(self.defaults, column.type) is None:
                out.append(Fault("MissingTypeDefault", (column.type,)))
        return out

    def parent_join_faults(self, env: m.Env, fact: m.Fact) -> list[Fault]:
        """A parent whose dimensions are inherited must be reachable by a key of the fact itself."""
        try:
            owners = [owner for owner, _ in derive.all_dimension_tables(env, fact)]
        except derive.DerivationError as e:
            return [Fault("NameClash", (fact.name, str(e)))]
        reachable = {k.table for k in self.tables[fact.table].foreign_keys()}
        joined = dict.fromkeys(o.table for o in owners if o.table != fact.table)
        return [Fault("MissingForeignKey", (fact.table, t)) for t in joined if t not in reachable]


def _repeated(kind: str, names: Iterable[tuple[str, ...]]) -> list[Fault]:
    return [Fault(kind, n) for n, k in Counter(names).items() if k > 1]


def make_env(
    tables: Iterable[m.Table],
    facts: Iterable[m.Fact],
    settings: m.Settings | None = None,
    defaults: dict[str, str] | None = None,
) -> m.Env:
    """A validated description, or InvalidDescription with every fault found, each once."""
    tables, facts, defaults = list(tables), list(facts), dict(defaults or {})
    check = _Checker(tables, facts, defaults)
    faults = [x for t in tables for x in check.table_faults(t)]
    faults += [x for f in facts for x in check.fact_faults(f)]
    faults += _repeated("DuplicateTable", ((t.name,) for t in tables))
    faults += _repeated("DuplicateFact", ((f.name,) for f in facts))
    for t in tables:
        faults += _repeated("DuplicateColumn", ((t.name, c.name) for c in t.columns))
    env = m.Env(tuple(tables), tuple(facts), settings or m.Settings(), tuple(defaults.items()))
    if not faults:
        faults = [x for f in facts for x in check.parent_join_faults(env, f)]
    if faults:
        raise InvalidDescription(list(dict.fromkeys(faults)))
    return env
