"""The engine's functions in one place: describe, derive, write out, load."""

from starloom.operators.dimension import dimension_full, dimension_increment, dimension_values
from starloom.operators.fact import load_fact, merge_facts
from starloom.plans.build import full_refresh, incremental_refresh, lineage
from starloom.plans.ddl import dimension_ddl, fact_ddl, key_violations, reference_violations
from starloom.plans.derive import all_dependencies, build_order, dependencies, dimension_tables, fact_table
from starloom.plans.model import Mode, Settings, TimeUnit
from starloom.plans.sqltext import dimension_sql, fact_sql
from starloom.plans.validate import InvalidDescription, make_env
from starloom.sources.spec import parse_spec, read_spec
from starloom.sources.store import TableStore

__all__ = [
    "InvalidDescription", "Mode", "Settings", "TableStore", "TimeUnit", "all_dependencies", "build_order", "dependencies",
    "dimension_ddl", "dimension_full", "dimension_increment", "dimension_sql", "dimension_tables", "dimension_values", "fact_ddl",
    "fact_sql", "fact_table", "full_refresh", "incremental_refresh", "key_violations", "lineage", "load_fact", "make_env",
    "merge_facts", "parse_spec", "read_spec", "reference_violations",
]
