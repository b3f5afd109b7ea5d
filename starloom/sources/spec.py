"""Reading of descriptions: YAML files or plain dictionaries."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from starloom.plans import model as m


class SpecError(ValueError):
    pass


def _need(node: dict, key: str, where: str) -> Any:
    if not isinstance(node, dict) or key not in node:
        raise SpecError(f"{where}: '{key}' is missing")
    return node[key]


def _column(node: Any, where: str) -> m.Column:
    if not isinstance(node, list) or len(node) < 2:
        raise SpecError(f"{where}: a column is a list [name, type, null|notnull], got {node!r}")
    flag = node[2] if len(node) > 2 else "null"
    if flag not in ("null", "notnull"):
        raise SpecError(f"{where}: invalid value for nullable: {flag!r}")
    return m.Column(str(node[0]), str(node[1]), flag == "null")


def _constraint(node: Any, where: str) -> m.Constraint:
    kind = _need(node, "type", where)
    if kind == "primary":
        return m.PrimaryKey(_need(node, "column", where))
    if kind == "unique":
        return m.UniqueKey(tuple(_need(node, "columns", where)))
    if kind == "foreign":
        return m.ForeignKey(_need(node, "table", where), tuple((a, b) for a, b in _need(node, "columns", where)))
    raise SpecError(f"{where}: invalid constraint type: {kind!r}")


_PLAIN = {"dimtime": m.DimTime, "nodimid": m.NoDimId, "tenantid": m.TenantId}
_TARGETED = {"dimid": m.DimId, "dimval": m.DimVal}
_COUNTS = {"factcount": m.FactCount, "factcountdistinct": m.FactCountDistinct}
_VALUES = {"factsum": m.FactSum, "factaverage": m.FactAverage, "factmax": m.FactMax, "factmin": m.FactMin}


def _fact_column(node: Any, where: str) -> m.FactColumn:
    kind, column = _need(node, "type", where), _need(node, "column", where)
    if kind in _PLAIN:
        return _PLAIN[kind](column)
    if kind in _TARGETED:
        return _TARGETED[kind](column, _need(node, "table", where))
    if kind in _COUNTS:
        return _COUNTS[kind](column, node.get("sourcecolumn"))
    if kind in _VALUES:
        return _VALUES[kind](column, _need(node, "sourcecolumn", where))
    raise SpecError(f"{where}: invalid fact column type: {kind!r}")


def parse_spec(root: dict) -> tuple[list[m.Table], list[m.Fact], dict[str, str]]:
    tables, facts = [], []
    for node in _need(root, "tables", "description"):
        name = _need(node, "name", "table")
        tables.append(
            m.Table(
                name,
                tuple(_column(c, f"table {name}") for c in _need(node, "columns", f"table {name}")),
                tuple(_constraint(c, f"table {name}") for c in _need(node, "constraints", f"table {name}")),
            )
        )
    for node in _need(root, "facts", "description"):
        name = _need(node, "name", "fact")
        where = f"fact {name}"
        facts.append(
            m.Fact(
                name,
                _need(node, "tablename", where),
                tuple(_fact_column(c, where) for c in _need(node, "columns", where)),
                bool(node.get("persistent", True)),
                tuple(node.get("parentfacts") or ()),
            )
        )
    defaults = _need(root, "defaults", "description")
    if not isinstance(defaults, dict) or any(not isinstance(v, str) for v in defaults.values()):
        raise SpecError("description: 'defaults' maps type names to text")
    return tables, facts, dict(defaults)


def parse_text(text: str, where: str) -> tuple[list[m.Table], list[m.Fact], dict[str, str]]:
    """A description in YAML; ``where`` names it in errors."""
    import yaml

    try:
        root = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SpecError(f"{where}: {e}") from e
    return parse_spec(root)


def read_spec(path: str | Path) -> tuple[list[m.Table], list[m.Fact], dict[str, str]]:
    return parse_text(Path(path).read_text(), str(path))
