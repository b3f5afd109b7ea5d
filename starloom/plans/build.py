"""Loads of a whole description in dependency order."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.dimension import ONE_TASK, dimension_increment, dimension_values, with_ids
from starloom.operators.fact import aligned, bucket_of, load_fact, merge_facts
from starloom.plans import ddl, derive
from starloom.plans import model as m
from starloom.sources.store import TableStore

BEGINNING = datetime(1, 1, 1)


class UnalignedWindow(ValueError):
    pass


class OverlappingWindow(ValueError):
    pass


def owners(env: m.Env) -> dict[str, list[tuple[m.Fact, str]]]:
    """Derived dimension tables and the (fact, dimension) pairs that feed each."""
    out: dict[str, list[tuple[m.Fact, str]]] = {}
    for fact in env.facts:
        for dim in derive.new_dimension_columns(fact):
            out.setdefault(env.settings.dim_prefix + dim, []).append((fact, dim))
    return out


def full_dimension(env: m.Env, store: TableStore, name: str, end) -> DataFrame:
    """All facts that feed a dimension contribute their values; ids are given once to their union."""
    parts = [dimension_values(env, f, d, store.read(f.table), end) for f, d in owners(env)[name]]
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    return with_ids(values.distinct() if len(parts) > 1 else values, env.settings.dim_id_column, one_task=ONE_TASK)


def laid_out(env: m.Env, fact: m.Fact, rows: DataFrame) -> DataFrame:
    """Rows sorted by tenant and time within each file, so that readers of a window skip row groups. With a
    tenant the files are ranges of (tenant, time) as well: readers of one tenant skip the other files, and a large
    tenant fills several. Else rows are sorted where they lie: no shuffle."""
    layout = ddl.write_layout(env, fact)
    if layout["partition_by"]:
        rows = rows.repartitionByRange(*layout["partition_by"], *layout["sort_by"])
    return rows.sortWithinPartitions(*layout["partition_by"], *layout["sort_by"])


# --- loaded windows ----------------------------------------------------------------------


def loaded_windows(properties: dict[str, str]) -> list[tuple[datetime, datetime]]:
    return [(datetime.fromisoformat(a), datetime.fromisoformat(b)) for a, b in json.loads(properties.get("windows", "[]"))]


def _with_window(windows: list[tuple[datetime, datetime]], start: datetime, end: datetime) -> dict[str, str]:
    """The property that says what was loaded, windows that touch joined."""
    out: list[tuple[datetime, datetime]] = []
    for a, b in sorted([*windows, (start, end)]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return {"windows": json.dumps([(a.isoformat(), b.isoformat()) for a, b in out])}


def full_refresh(env: m.Env, store: TableStore, end) -> list[str]:
    """Dimensions, then persistent facts. Each is written beside the present table and put in its place by
    one commit, which for facts also says how far they were loaded."""
    feeds, done = owners(env), []
    facts = {derive.fact_table_name(env.settings, f): f for f in env.facts}
    for name in derive.build_order(env):
        if name in feeds:
            store.replace(name, full_dimension(env, store, name, end))
        elif facts[name].persistent:
            store.replace(name, laid_out(env, facts[name], load_fact(env, facts[name], store.read, end)), _with_window([], BEGINNING, end))
        else:
            continue
        done.append(name)
    return done


def incremental_refresh(env: m.Env, store: TableStore, end: datetime, start: datetime, merge: bool = False) -> list[str]:
    """Adds the window ``[start, end)``: new dimension values first, then fact rows. Gives the tables it changed.

    Facts that share a dimension load it one after the other. Windows must lie on bucket borders;
    with ``merge`` any window will do: rows of a bucket that it cuts are put together with what is
    stored of that bucket, and no other stored row is touched.

    A fact's rows and the window they come from become visible in one commit. A window that lies in
    what was loaded changes nothing, so a run that died may be repeated as it is; one that lies in it in part is
    an error. Of two writers at once one fails with CommitConflict. Rows that arrive after
    their window was loaded aren't seen until the next full refresh.
    """
    s = env.settings
    if not merge and not (aligned(start, s.time_unit) and aligned(end, s.time_unit)):
        raise UnalignedWindow(f"[{start}, {end}) cuts a {s.time_unit.label} bucket")
    feeds, done = owners(env), []
    facts = {derive.fact_table_name(s, f): f for f in env.facts}
    for name in derive.build_order(env):
        changed = False
        if name in feeds:
            for fact, dim in feeds[name]:
                version = store.table(name).latest()
                if version.version:
                    new = dimension_increment(env, fact, dim, store.read(fact.table), store.read(name, version), end, start)
                else:
                    new = with_ids(dimension_values(env, fact, dim, store.read(fact.table), end, start), s.dim_id_column)
                if not version.version or not new.isEmpty():
                    store.append(name, new, base=version)
                    changed = True
        elif facts[name].persistent:
            changed = _load_window(env, facts[name], store, name, end, start)
        if changed:
            done.append(name)
    return done


def _load_window(env: m.Env, fact: m.Fact, store: TableStore, name: str, end: datetime, start: datetime) -> bool:
    unit, version = env.settings.time_unit, store.table(name).latest()
    windows = loaded_windows(version.properties)
    if any(a <= start and end <= b for a, b in windows):
        return False
    if any(a < end and start < b for a, b in windows):
        raise OverlappingWindow(f"[{start}, {end}) was loaded into {name} in part")
    rows = load_fact(env, fact, store.read, end, start)
    cut = [bucket_of(x, unit) for x in (start, end) if not aligned(x, unit)]
    inside = F.col(derive.time_column_name(env.settings, fact.time_column())).isin(cut)
    if cut and version.version:
        rows = merge_facts(env, fact, store.read(name, version).filter(inside), rows)
    store.table(name).write(laid_out(env, fact, rows), inside if cut else None, _with_window(windows, start, end), version)
    return True


def lineage(env: m.Env, spark) -> DataFrame:
    """``table_name, position, depends_on``: the lineage of every derived table as rows."""
    rows = [(n, i, up) for n, ups in derive.all_dependencies(env).items() for i, up in enumerate(ups)]
    return spark.createDataFrame(rows, "table_name string, position int, depends_on string").select(
        "table_name", F.col("position").cast("int").alias("position"), "depends_on"
    )
