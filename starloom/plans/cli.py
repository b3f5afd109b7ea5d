"""Command line: a YAML description in, DDL and lineage files out, or a refresh of a table folder.

    python -m starloom.plans.cli INPUT OUTPUT [settings]
    python -m starloom.plans.cli INPUT OUTPUT --refresh full --sources DIR --end '2024-03-01 00:00:00'

Without --refresh, OUTPUT gets <table>.sql in create, fullrefresh and increfresh, and dependencies.json,
dimensions.json and facts.json. A dimension fed by several facts gets a file for each in the refresh folders.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime
from pathlib import Path

import starloom
from starloom.plans import ddl, derive, sqltext
from starloom.plans import model as m
from starloom.plans.validate import InvalidDescription, make_env
from starloom.sources.spec import SpecError, read_spec

# Option -> (settings field, type).
_OPTIONS = {
    "--dim-prefix": ("dim_prefix", str),
    "--fact-prefix": ("fact_prefix", str),
    "--avg-count-col-suffix": ("avg_count_suffix", str),
    "--avg-sum-col-suffix": ("avg_sum_suffix", str),
    "--dim-id-col-name": ("dim_id_column", str),
    "--dim-id-col-type": ("dim_id_type", str),
    "--fact-count-col-type": ("count_type", str),
    "--fact-count-distinct-error-rate": ("distinct_error_rate", float),
    "--fact-infix": ("fact_infix", str),
    "--dependencies-json-file": ("dependencies_file", str),
    "--facts-json-file": ("facts_file", str),
    "--dimensions-json-file": ("dimensions_file", str),
    "--foreign-key-id-coalesce-val": ("missing_id", int),
    "--tablename-suffix-template": ("suffix_template", str),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="starloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("input", metavar="INPUT")
    p.add_argument("output", metavar="OUTPUT")
    p.add_argument("--version", action="version", version=f"starloom {starloom.__version__}")
    p.add_argument("-t", "--timeunit", choices=[u.label for u in m.TimeUnit], default="minute")
    base = m.Settings()
    for option, (name, kind) in _OPTIONS.items():
        short = {"--dim-prefix": ["-d"], "--fact-prefix": ["-f"]}.get(option, [])
        p.add_argument(*short, option, dest=name, type=kind, default=getattr(base, name))
    p.add_argument("--refresh", choices=["full", "incremental"])
    p.add_argument("--sources", help="folder of the source tables")
    p.add_argument("--start", type=datetime.fromisoformat)
    p.add_argument("--end", type=datetime.fromisoformat)
    p.add_argument("--merge", action="store_true", help="incremental windows may cut buckets")
    return p


def parsed(argv: list[str] | None) -> argparse.Namespace:
    p = parser()
    args = p.parse_args(argv)
    if args.refresh and args.end is None:
        p.error("--refresh needs --end")
    if args.refresh == "incremental" and args.start is None:
        p.error("--refresh incremental needs --start")
    if args.merge and args.refresh != "incremental":
        p.error("--merge goes with --refresh incremental")
    return args


def settings_of(args: argparse.Namespace) -> m.Settings:
    fields = {name: getattr(args, name) for name, _ in _OPTIONS.values()}
    return m.Settings(time_unit=m.TimeUnit[args.timeunit.upper()], **fields)


def files_of(env: m.Env) -> dict[str, str]:
    """What goes into each file, by its path in the output folder."""
    s = env.settings
    folders = {m.Mode.FULL: "fullrefresh", m.Mode.INCREMENTAL: "increfresh"}
    out: dict[str, str] = {}
    new: list[str] = []
    for fact in env.facts:
        for table in derive.dimension_tables(env, fact):
            if derive.is_existing(env, table):
                continue
            name = table.name if table.name not in new else f"{table.name}.{fact.name}"
            new.append(table.name)
            out[f"create/{table.name}.sql"] = "\n".join(ddl.dimension_ddl(env, table))
            for mode, folder in folders.items():
                out[f"{folder}/{name}.sql"] = sqltext.dimension_sql(env, fact, table.name.removeprefix(s.dim_prefix), mode)
        if fact.persistent:
            name = derive.fact_table_name(s, fact)
            out[f"create/{name}.sql"] = "\n".join(ddl.fact_ddl(env, fact))
            for mode, folder in folders.items():
                out[f"{folder}/{name}.sql"] = sqltext.fact_sql(env, fact, mode)
    facts = [derive.fact_table_name(s, f) for f in env.facts if f.persistent]
    out[s.dependencies_file] = json.dumps(derive.all_dependencies(env), indent=1)
    out[s.dimensions_file] = json.dumps(list(dict.fromkeys(new)))
    out[s.facts_file] = json.dumps(facts)
    return out


def write_files(env: m.Env, output: Path) -> None:
    for path, text in files_of(env).items():
        (output / path).parent.mkdir(parents=True, exist_ok=True)
        (output / path).write_text(text)


def main(argv: list[str] | None = None) -> int:
    args = parsed(argv)
    try:
        tables, facts, defaults = read_spec(args.input)
        env = make_env(tables, facts, settings_of(args), defaults)
    except (SpecError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    except InvalidDescription as e:
        for fault in e.faults:
            print(fault, file=sys.stderr)
        return 1
    output = Path(args.output)
    if not args.refresh:
        write_files(env, output)
        return 0
    from pyspark.sql import SparkSession

    from starloom.plans.build import OverlappingWindow, UnalignedWindow, full_refresh, incremental_refresh
    from starloom.sources.store import TableStore

    store = TableStore(SparkSession.builder.getOrCreate(), str(output), args.sources)
    if args.refresh == "full":
        full_refresh(env, store, args.end)
        return 0
    try:
        incremental_refresh(env, store, args.end, args.start, args.merge)
    except (UnalignedWindow, OverlappingWindow) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
