"""Registered queries of the core, each with the SQL that gives the same rows.

Every query takes (spark, folder of parquet tables) and reads its tables whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import suppress
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import sketch as sk
from starloom.functions.exprs import time_bucket, time_literal
from starloom.operators.balance import balanced_join, key_loads, plan_placement, split_keys
from starloom.operators.changes import VersionedTable, pending_sessions, process_new, process_sessions
from starloom.operators.dimension import dimension_full, dimension_increment
from starloom.operators.fact import load_fact, merge_facts
from starloom.operators.orphans import dimension_orphans, orphan_counts, orphan_references
from starloom.operators.rolling import idle_days, rolling_totals
from starloom.plans import build, ddl, derive
from starloom.plans import model as m
from starloom.plans.validate import make_env
from starloom.sources.shared import removed_at_end, shared_folder
from starloom.sources.spec import parse_spec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: No row of the tables lies behind it: a full load takes all rows.
END = datetime(2100, 1, 1)
UNKNOWN = "__UNKNOWN_VAL__"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- descriptions -------------------------------------------------------------------

_TEXT = "character varying(100)"
_TIME = "timestamp without time zone"
_DEFAULTS = {
    "integer": "-1",
    "bigint": "-1",
    "timestamp": "'00-00-00 00:00:00'",
    "character": f"'{UNKNOWN}'",
    "text": f"'{UNKNOWN}'",
    "uuid": "'00000000-0000-0000-0000-000000000000'::uuid",
    "boolean": "false",
    "json": "'{}'::json",
    "numeric": "-1",
    "double": "-1",
}


def _t(name: str, constraints: list, *columns: str) -> dict:
    """``columns``: 'name type' texts, a leading '!' for NOT NULL."""
    rows = [[*c.lstrip("!").split(" ", 1), "notnull" if c[0] == "!" else "null"] for c in columns]
    return {"name": name, "columns": rows, "constraints": constraints}


_TABLES = [
    _t("session_events", [{"type": "primary", "column": "id"}], "!id uuid", f"!created_at {_TIME}", "member_id integer",
       "!publisher_id integer", "user_agent character varying(1024)", f"browser_name {_TEXT}", f"os {_TEXT}",
       f"geo_country_name {_TEXT}", f"geo_city_name {_TEXT}", f"geo_continent_name {_TEXT}",
       "geo_longitude numeric(9,6)", "geo_latitude numeric(9,6)", f"user_agent_name {_TEXT}", f"user_agent_version {_TEXT}"),
    _t("page_view_events",
       [{"type": "primary", "column": "id"},
        {"type": "foreign", "table": "session_events", "columns": [["session_event_id", "id"], ["publisher_id", "publisher_id"]]},
        {"type": "foreign", "table": "referrers", "columns": [["referrer_id", "id"], ["publisher_id", "publisher_id"]]}],
       "!id uuid", f"!created_at {_TIME}", "member_id integer", "!publisher_id integer", "session_event_id uuid",
       "!page_type character varying(20)", "referrer_id integer"),
    _t("referrers", [{"type": "primary", "column": "id"}, {"type": "unique", "columns": ["publisher_id", "name"]}],
       "!id integer", "!publisher_id integer", f"!name {_TEXT}"),
    _t("events", [{"type": "primary", "column": "event_id"}], "!event_id bigint", f"!ts {_TIME}", "!user_id bigint",
       "event_type text", "value double precision"),
    _t("orders", [{"type": "primary", "column": "o_orderkey"},
                  {"type": "foreign", "table": "customer", "columns": [["o_custkey", "c_custkey"]]}],
       "!o_orderkey bigint", "o_custkey bigint", "o_orderstatus text", f"!o_orderdate {_TIME}", "o_orderpriority text"),
    _t("lineitem", [{"type": "foreign", "table": "orders", "columns": [["l_orderkey", "o_orderkey"]]},
                    {"type": "foreign", "table": "customer", "columns": [["l_custkey", "c_custkey"]]}],
       "!l_orderkey bigint", "!l_linenumber integer", "l_custkey bigint", "l_quantity numeric(12,2)", "l_extendedprice numeric(12,2)",
       "l_returnflag text", f"!l_shipdate {_TIME}", f"!l_orderdate {_TIME}"),
    _t("customer", [{"type": "primary", "column": "c_custkey"}], "!c_custkey bigint", "c_mktsegment text", "c_nationkey integer",
       f"!c_since {_TIME}"),
]


def _fact(name: str, table_name: str, *columns: str, parents: tuple[str, ...] = ()) -> dict:
    """``columns``: 'kind column [table or source column]' texts."""
    out = []
    for c in columns:
        kind, column, *more = c.split()
        extra = {("table" if kind in ("dimid", "dimval") else "sourcecolumn"): more[0]} if more else {}
        out.append({"type": kind, "column": column, **extra})
    return {"name": name, "tablename": table_name, "columns": out, "parentfacts": list(parents)}


_SESSION = _fact(
    "session", "session_events", "dimtime created_at", "nodimid publisher_id", "dimval browser_name user_agent",
    "dimval os user_agent", "dimval user_agent_name user_agent", "dimval geo_country_name geo", "dimval geo_city_name geo",
    "dimval geo_continent_name geo", "factcount session_count",
)
_PAGE_VIEW = _fact(
    "page_view", "page_view_events", "dimtime created_at", "nodimid publisher_id", "dimval page_type page_type",
    "dimid referrer_id referrers", "factcount view_count", parents=("session",),
)


def environment(*facts: dict, **settings) -> m.Env:
    tables, parsed, defaults = parse_spec({"tables": _TABLES, "facts": list(facts), "defaults": _DEFAULTS})
    return make_env(tables, parsed, m.Settings(**settings), defaults)


def resolver(spark: SparkSession, folder: str, **views: DataFrame) -> Callable[[str], DataFrame]:
    return lambda name: views[name] if name in views else table(spark, folder, name)


# --- time buckets -------------------------------------------------------------------


def _bucket_query(unit: m.TimeUnit):
    @query(
        f"time_bucket_{unit.label}",
        f"select cast(floor(epoch(ts) / {unit.value}) as bigint) as ts_bucket, count(*) as n_rows from events group by 1",
    )
    def run(spark, folder):
        bucket = time_bucket(F.col("ts"), unit).alias("ts_bucket")
        return table(spark, folder, "events").groupBy(bucket).agg(F.count(F.lit(1)).alias("n_rows"))


for _unit in m.TimeUnit:
    _bucket_query(_unit)


# --- views with nulls ---------------------------------------------------------------


def orders_with_nulls(spark, folder) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.withColumns(
        {
            "o_orderpriority": F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")),
            "o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("F")),
            "o_custkey": F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")),
        }
    )


_ORDERS_SQL = """orders_n as (select o_orderkey, o_orderdate, case when o_custkey % 7 <> 0 then o_custkey end as o_custkey,
 nullif(o_orderpriority, '1-URGENT') as o_orderpriority, nullif(o_orderstatus, 'F') as o_orderstatus from orders)"""


def _lineitem(spark, folder, with_orders: bool = False) -> DataFrame:
    """Line items with decimals, whose sums don't depend on their order, and order columns beside them if asked for."""
    rows = table(spark, folder, "lineitem").withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("l_quantity", "l_extendedprice")})
    if not with_orders:
        return rows
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("l_orderdate"), F.col("o_custkey").alias("l_custkey"))
    return rows.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey")


_LINEITEM_SQL = """li as (select l.* exclude (l_quantity, l_extendedprice), cast(l_quantity as decimal(12,2)) as l_quantity,
 cast(l_extendedprice as decimal(12,2)) as l_extendedprice, o_orderdate as l_orderdate, o_custkey as l_custkey
 from lineitem l left join orders on l_orderkey = o_orderkey)"""


def _day(column: str) -> str:
    return f"cast(floor(epoch({column}) / 86400) as bigint)"


# --- plain keys ---------------------------------------------------------------------


def _orders_fact(spark, folder, *columns: str, views: dict | None = None, **settings) -> DataFrame:
    env = environment(_fact("order", "orders", "dimtime o_orderdate", *columns), time_unit=m.TimeUnit.DAY, **settings)
    views = {"orders": orders_with_nulls(spark, folder)} | (views or {})
    return load_fact(env, env.fact("order"), resolver(spark, folder, **views), END)


@query(
    "coalesce_default_key",
    f"with {_ORDERS_SQL} select {_day('o_orderdate')} as o_orderdate_day_id, coalesce(o_orderpriority, '{UNKNOWN}') as o_orderpriority,"
    " cast(count(*) as integer) as n_orders from orders_n group by 1, 2",
)
def _(spark, folder):
    return _orders_fact(spark, folder, "nodimid o_orderpriority", "factcount n_orders")


@query(
    "tenant_key",
    f"with {_ORDERS_SQL} select {_day('o_orderdate')} as o_orderdate_day_id, coalesce(o_custkey, -1) as o_custkey,"
    " cast(count(*) as integer) as n_orders from orders_n group by 1, 2",
)
def _(spark, folder):
    return _orders_fact(spark, folder, "tenantid o_custkey", "factcount n_orders")


# --- dimensions ---------------------------------------------------------------------

_GEO = f"""select distinct coalesce(geo_country_name, '{UNKNOWN}') as country_name, coalesce(geo_city_name, '{UNKNOWN}') as city_name,
 coalesce(geo_continent_name, '{UNKNOWN}') as continent_name from session_events
 where (geo_country_name is not null or geo_city_name is not null or geo_continent_name is not null)"""
_AGENT = f"""select distinct coalesce(browser_name, '{UNKNOWN}') as browser_name, coalesce(os, '{UNKNOWN}') as os,
 coalesce(user_agent_name, '{UNKNOWN}') as name from session_events
 where (browser_name is not null or os is not null or user_agent_name is not null)"""


def _numbered(columns: str, rows: str) -> str:
    return f"select cast(row_number() over (order by {columns}) as integer) as id, * from ({rows})"


@query("dim_full", _numbered("country_name, city_name, continent_name", _GEO))
def _(spark, folder):
    env = environment(_SESSION)
    return dimension_full(env, env.fact("session"), "geo", table(spark, folder, "session_events"), END)


@query("dim_full_prefix_strip", _numbered("browser_name, os, name", _AGENT))
def _(spark, folder):
    env = environment(_SESSION)
    return dimension_full(env, env.fact("session"), "user_agent", table(spark, folder, "session_events"), END)


@query("dim_full_not_null", _numbered("page_type", "select distinct page_type from page_view_events where page_type is not null"))
def _(spark, folder):
    env = environment(_SESSION, _PAGE_VIEW)
    return dimension_full(env, env.fact("page_view"), "page_type", table(spark, folder, "page_view_events"), END)


_CUT1, _CUT2 = datetime(2024, 1, 16), datetime(2024, 2, 1)


@query(
    "dim_incremental",
    f"""with old as (select row_number() over (order by country_name, city_name, continent_name) as id, * from ({_GEO} and created_at < timestamp '{_CUT1}')),
 new as ({_GEO} and created_at >= timestamp '{_CUT1}' and created_at < timestamp '{_CUT2}')
 select cast(row_number() over (order by country_name, city_name, continent_name) + (select max(id) from old) as integer) as id, *
 from (select * from new except select country_name, city_name, continent_name from old)""",
)
def _(spark, folder):
    env = environment(_SESSION)
    fact, source = env.fact("session"), table(spark, folder, "session_events")
    old = dimension_full(env, fact, "geo", source, _CUT1)
    return dimension_increment(env, fact, "geo", source, old, _CUT2, _CUT1)


@query(
    "dim_incremental_existing_ids",
    f"""select cast(row_number() over (order by browser_name, os, name) + (select max(id) from dim_user_agent) as integer) as id, *
 from ({_AGENT} except select browser_name, os, name from dim_user_agent)""",
)
def _(spark, folder):
    env = environment(_SESSION)
    args = table(spark, folder, "session_events"), table(spark, folder, "dim_user_agent")
    return dimension_increment(env, env.fact("session"), "user_agent", *args, END, datetime(1900, 1, 1))


_ORDER_DIM = ["dimval o_orderstatus kind", "dimval o_orderpriority kind", "factcount n_orders"]
_KIND_SQL = f"""kind as (select row_number() over (order by o_orderstatus, o_orderpriority) as id, * from (
 select distinct coalesce(o_orderstatus, '{UNKNOWN}') as o_orderstatus, coalesce(o_orderpriority, '{UNKNOWN}') as o_orderpriority
 from orders_n where o_orderstatus is not null or o_orderpriority is not null))"""


def _kind_dimension(spark, folder, end=END) -> tuple[m.Env, DataFrame]:
    env = environment(_fact("order", "orders", "dimtime o_orderdate", *_ORDER_DIM), time_unit=m.TimeUnit.DAY)
    return env, dimension_full(env, env.fact("order"), "kind", orders_with_nulls(spark, folder), end)


@query(
    "dim_all_null_rows",
    f"""with {_ORDERS_SQL}, {_KIND_SQL} select {_day('o_orderdate')} as o_orderdate_day_id, cast(count(*) as integer) as n_orders,
 cast(coalesce(k.id, -1) as integer) as kind_id from orders_n o left join kind k
 on coalesce(o.o_orderstatus, '{UNKNOWN}') = k.o_orderstatus and coalesce(o.o_orderpriority, '{UNKNOWN}') = k.o_orderpriority
 group by 1, 3""",
)
def _(spark, folder):
    env, kind = _kind_dimension(spark, folder)
    views = {"orders": orders_with_nulls(spark, folder), "dim_kind": kind}
    return load_fact(env, env.fact("order"), resolver(spark, folder, **views), END)


# --- measures -----------------------------------------------------------------------


def _line_fact(spark, folder, *columns: str, with_orders: bool = False) -> DataFrame:
    env = environment(_fact("line", "lineitem", "dimtime l_shipdate", *columns), time_unit=m.TimeUnit.DAY)
    return load_fact(env, env.fact("line"), resolver(spark, folder, lineitem=_lineitem(spark, folder, with_orders)), END)


def _line_sql(measures: str) -> str:
    return (
        f"with {_LINEITEM_SQL} select {_day('l_shipdate')} as l_shipdate_day_id, coalesce(l_returnflag, '{UNKNOWN}') as l_returnflag,"
        f" {measures} from li group by 1, 2"
    )


@query(
    "fact_count_star",
    "select cast(floor(epoch(ts) / 60) as bigint) as ts_minute_id, user_id, cast(count(*) as integer) as n from events group by 1, 2",
)
def _(spark, folder):
    env = environment(_fact("event", "events", "dimtime ts", "nodimid user_id", "factcount n"))
    return load_fact(env, env.fact("event"), resolver(spark, folder), END)


@query(
    "fact_count_col",
    f"with {_ORDERS_SQL} select {_day('o_orderdate')} as o_orderdate_day_id, cast(count(o_orderpriority) as integer) as n_known,"
    " cast(count(*) as integer) as n_all from orders_n group by 1",
)
def _(spark, folder):
    return _orders_fact(spark, folder, "factcount n_known o_orderpriority", "factcount n_all")


@query("fact_sum", _line_sql("cast(sum(l_extendedprice) as decimal(12,2)) as price"))
def _(spark, folder):
    return _line_fact(spark, folder, "nodimid l_returnflag", "factsum price l_extendedprice")


@query("fact_max", _line_sql("max(l_quantity) as top"))
def _(spark, folder):
    return _line_fact(spark, folder, "nodimid l_returnflag", "factmax top l_quantity")


@query("fact_min", _line_sql("min(l_quantity) as low"))
def _(spark, folder):
    return _line_fact(spark, folder, "nodimid l_returnflag", "factmin low l_quantity")


@query("fact_avg_split", _line_sql("cast(count(l_quantity) as integer) as q_count, cast(sum(l_quantity) as decimal(12,2)) as q_sum"))
def _(spark, folder):
    return _line_fact(spark, folder, "nodimid l_returnflag", "factaverage q l_quantity")


@query(
    "fact_multi_time",
    f"with {_LINEITEM_SQL} select {_day('l_shipdate')} as l_shipdate_day_id, {_day('l_orderdate')} as l_orderdate_day_id,"
    " cast(count(*) as integer) as n from li group by 1, 2",
)
def _(spark, folder):
    return _line_fact(spark, folder, "dimtime l_orderdate", "factcount n", with_orders=True)


# --- lookups and parents ------------------------------------------------------------

_SESSION_ROWS = f"""s as (select *, coalesce(geo_country_name, '{UNKNOWN}') as g1, coalesce(geo_city_name, '{UNKNOWN}') as g2,
 coalesce(geo_continent_name, '{UNKNOWN}') as g3, coalesce(browser_name, '{UNKNOWN}') as a1, coalesce(os, '{UNKNOWN}') as a2,
 coalesce(user_agent_name, '{UNKNOWN}') as a3 from session_events)"""


def _session_sql(where: str = "true") -> str:
    return f"""with {_SESSION_ROWS} select cast(floor(epoch(created_at) / 60) as bigint) as created_at_minute_id, publisher_id,
 cast(count(*) as integer) as session_count, coalesce(g.id, -1) as geo_id, coalesce(u.id, -1) as user_agent_id
 from s left join dim_geo g on g1 = country_name and g2 = city_name and g3 = continent_name
 left join dim_user_agent u on a1 = u.browser_name and a2 = u.os and a3 = u.name where {where} group by 1, 2, 4, 5"""


@query("fact_dim_lookup", _session_sql())
def _(spark, folder):
    env = environment(_SESSION)
    return load_fact(env, env.fact("session"), resolver(spark, folder), END)


@query("fact_incremental_window", _session_sql(f"created_at >= timestamp '{_CUT1}' and created_at < timestamp '{_CUT2}'"))
def _(spark, folder):
    env = environment(_SESSION)
    return load_fact(env, env.fact("session"), resolver(spark, folder), _CUT2, _CUT1)


@query("full_equals_incremental", _session_sql())
def _(spark, folder):
    env = environment(_SESSION)
    fact, tables = env.fact("session"), resolver(spark, folder)
    parts = [load_fact(env, fact, tables, _CUT1), load_fact(env, fact, tables, _CUT2, _CUT1), load_fact(env, fact, tables, END, _CUT2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_UNALIGNED = datetime(2024, 1, 16, 12, 30, 20)


@query("merge_unaligned_increments", _session_sql())
def _(spark, folder):
    env = environment(_SESSION)
    fact, tables = env.fact("session"), resolver(spark, folder)
    return merge_facts(env, fact, load_fact(env, fact, tables, _UNALIGNED), load_fact(env, fact, tables, END, _UNALIGNED))




@query(
    "fact_lookup_missing_is_minus_one",
    f"""with {_ORDERS_SQL}, kind as (select row_number() over (order by o_orderstatus, o_orderpriority) as id, * from (
 select distinct coalesce(o_orderstatus, '{UNKNOWN}') as o_orderstatus, coalesce(o_orderpriority, '{UNKNOWN}') as o_orderpriority
 from orders_n where o_orderdate < timestamp '1995-01-01' and (o_orderstatus is not null or o_orderpriority is not null)
 and o_orderpriority is distinct from '5-LOW'))
 select {_day('o_orderdate')} as o_orderdate_day_id, cast(count(*) as integer) as n_orders,
 cast(coalesce(k.id, -1) as integer) as kind_id from orders_n o left join kind k
 on coalesce(o.o_orderstatus, '{UNKNOWN}') = k.o_orderstatus and coalesce(o.o_orderpriority, '{UNKNOWN}') = k.o_orderpriority
 group by 1, 3""",
)
def _(spark, folder):
    env, _ = _kind_dimension(spark, folder)
    fact, orders = env.fact("order"), orders_with_nulls(spark, folder)
    some = orders.filter(~F.col("o_orderpriority").eqNullSafe("5-LOW"))
    kind = dimension_full(env, fact, "kind", some, datetime(1995, 1, 1))
    return load_fact(env, fact, resolver(spark, folder, orders=orders, dim_kind=kind), END)


@query(
    "fact_dimid_existing",
    f"select {_day('o_orderdate')} as o_orderdate_day_id, cast(count(*) as integer) as n_orders, o_custkey from orders group by 1, 3",
)
def _(spark, folder):
    return _orders_fact(spark, folder, "dimid o_custkey customer", "factcount n_orders", views={"orders": table(spark, folder, "orders")})


@query(
    "fact_dimid_nullable",
    f"with {_ORDERS_SQL} select {_day('o_orderdate')} as o_orderdate_day_id, cast(count(*) as integer) as n_orders,"
    " coalesce(o_custkey, -1) as o_custkey from orders_n group by 1, 3",
)
def _(spark, folder):
    return _orders_fact(spark, folder, "dimid o_custkey customer", "factcount n_orders")


def _page_view_sql() -> str:
    return f"""with {_SESSION_ROWS}, page_type as (
 select row_number() over (order by page_type) as id, page_type from (select distinct page_type from page_view_events))
 select cast(floor(epoch(v.created_at) / 60) as bigint) as created_at_minute_id, v.publisher_id, cast(count(*) as integer) as view_count,
 coalesce(v.referrer_id, -1) as referrer_id, cast(coalesce(p.id, -1) as integer) as page_type_id, coalesce(g.id, -1) as geo_id,
 coalesce(u.id, -1) as user_agent_id
 from page_view_events v left join s on v.session_event_id = s.id and v.publisher_id = s.publisher_id
 left join page_type p on v.page_type = p.page_type
 left join dim_geo g on coalesce(s.g1, '{UNKNOWN}') = country_name and coalesce(s.g2, '{UNKNOWN}') = city_name and coalesce(s.g3, '{UNKNOWN}') = continent_name
 left join dim_user_agent u on coalesce(s.a1, '{UNKNOWN}') = u.browser_name and coalesce(s.a2, '{UNKNOWN}') = u.os and coalesce(s.a3, '{UNKNOWN}') = u.name
 group by 1, 2, 4, 5, 6, 7"""


def _page_views(spark, folder, **views) -> DataFrame:
    env = environment(_SESSION, _PAGE_VIEW)
    fact = env.fact("page_view")
    page_type = dimension_full(env, fact, "page_type", table(spark, folder, "page_view_events"), END)
    return load_fact(env, fact, resolver(spark, folder, dim_page_type=page_type, **views), END)


@query("fact_parent_join", _page_view_sql())
def _(spark, folder):
    return _page_views(spark, folder)


@query("fact_parent_unmatched", f"select * from ({_page_view_sql()}) where geo_id = -1 and user_agent_id = -1")
def _(spark, folder):
    """What has neither a place nor an agent: page views whose session is missing or unknown, among others."""
    return _page_views(spark, folder).filter("geo_id = -1 and user_agent_id = -1")


_GRAND = [
    _fact("cust", "customer", "dimtime c_since", "dimval c_mktsegment segment", "factcount n"),
    _fact("order", "orders", "dimtime o_orderdate", "dimval o_orderpriority priority", "factcount n", parents=("cust",)),
    _fact("line", "lineitem", "dimtime l_shipdate", "factcount n", "factsum q l_quantity", parents=("order",)),
]


@query(
    "fact_grandparent_dims",
    f"""with {_LINEITEM_SQL}, {_ORDERS_SQL},
 priority as (select row_number() over (order by o_orderpriority) as id, * from (select distinct o_orderpriority from orders_n where o_orderpriority is not null)),
 segment as (select row_number() over (order by c_mktsegment) as id, * from (select distinct c_mktsegment from customer where c_mktsegment is not null))
 select {_day('l_shipdate')} as l_shipdate_day_id, cast(count(*) as integer) as n, cast(sum(l_quantity) as decimal(12,2)) as q,
 cast(coalesce(p.id, -1) as integer) as priority_id, cast(coalesce(s.id, -1) as integer) as segment_id
 from li left join orders_n o on l_orderkey = o_orderkey left join customer c on l_custkey = c_custkey
 left join priority p on o.o_orderpriority = p.o_orderpriority left join segment s on c.c_mktsegment = s.c_mktsegment group by 1, 4, 5""",
)
def _(spark, folder):
    env = environment(*_GRAND, time_unit=m.TimeUnit.DAY)
    orders = orders_with_nulls(spark, folder)
    since = F.lit("1990-01-01").cast("timestamp_ntz")
    customer = table(spark, folder, "customer").withColumn("c_since", since)
    views = {"orders": orders, "customer": customer, "lineitem": _lineitem(spark, folder, True)}
    views["dim_priority"] = dimension_full(env, env.fact("order"), "priority", orders, END)
    views["dim_segment"] = dimension_full(env, env.fact("cust"), "segment", customer, END)
    return load_fact(env, env.fact("line"), resolver(spark, folder, **views), END)


# --- distinct-count sketches --------------------------------------------------------

_ERROR = 0.05
_M = sk.bucket_count(_ERROR)


def _h32(x: str) -> str:
    return f"cast('0x' || substr(md5(cast({x} as varchar)), 1, 8) as bigint)"


def _registers(keys: str, value: str, source: str) -> str:
    n = len(keys.split(","))
    groups = ", ".join(str(i + 1) for i in range(n + 1))
    return (
        f"select {keys}, {_h32(value)} & {_M - 1} as bnum, cast(32 - length(bin(min({_h32(value)} & 2147483647))) as integer) as rho"
        f" from {source} where {value} is not null group by {groups}"
    )


def _json(rows: str, key: str) -> str:
    return (
        f"select {key}, '{{' || string_agg('\"' || bnum || '\":' || rho, ',' order by cast(bnum as varchar)) || '}}' as sketch"
        f" from ({rows}) group by {key}"
    )


@query("fact_distinct_sketch_rows", _registers(f"{_day('ts')} as day_id", "user_id", "events"))
def _(spark, folder):
    day = time_bucket(F.col("ts"), m.TimeUnit.DAY).alias("day_id")
    return sk.sketch_rows(table(spark, folder, "events").select(day, "user_id"), ["day_id"], "user_id", _ERROR)


@query(
    "fact_distinct_sketch_json",
    f"""select d.day_id as ts_day_id, cast(n as integer) as n, users, types from
 (select {_day('ts')} as day_id, count(*) as n from events group by 1) d
 join (select day_id, sketch as users from ({_json(_registers(f"{_day('ts')} as day_id", "user_id", "events"), "day_id")})) a using (day_id)
 join (select day_id, sketch as types from ({_json(_registers(f"{_day('ts')} as day_id", "event_type", "events"), "day_id")})) b using (day_id)""",
)
def _(spark, folder):
    columns = ["dimtime ts", "factcount n", "factcountdistinct users user_id", "factcountdistinct types event_type"]
    env = environment(_fact("event", "events", *columns), time_unit=m.TimeUnit.DAY)
    return load_fact(env, env.fact("event"), resolver(spark, folder), END)


@query(
    "fact_distinct_default_pk",
    f"select day_id as ts_day_id, sketch as n_events from ({_json(_registers(f'{_day("ts")} as day_id', 'event_id', 'events'), 'day_id')})",
)
def _(spark, folder):
    env = environment(_fact("event", "events", "dimtime ts", "factcountdistinct n_events"), time_unit=m.TimeUnit.DAY)
    return load_fact(env, env.fact("event"), resolver(spark, folder), END)


@query(
    "fact_distinct_empty_group",
    f"""with {_ORDERS_SQL}, o as (select {_day('o_orderdate')} as day_id, case when o_orderstatus is null then o_custkey end as v,
 coalesce(o_orderpriority, '{UNKNOWN}') as p from orders_n)
 select k.day_id as o_orderdate_day_id, k.p as o_orderpriority, coalesce(sketch, '{{}}') as customers from (select distinct day_id, p from o) k
 left join (select day_id, p, '{{' || string_agg('\"' || bnum || '\":' || rho, ',' order by cast(bnum as varchar)) || '}}' as sketch
 from ({_registers('day_id, p', 'v', 'o')}) group by day_id, p) s on k.day_id = s.day_id and k.p = s.p""",
)
def _(spark, folder):
    orders = orders_with_nulls(spark, folder)
    orders = orders.withColumn("o_custkey", F.when(F.col("o_orderstatus").isNull(), F.col("o_custkey")))
    return _orders_fact(spark, folder, "nodimid o_orderpriority", "factcountdistinct customers o_custkey", views={"orders": orders})


@query(
    "sketch_merge",
    f"select week_id, sketch from ({_json(_registers('cast(floor(epoch(ts) / 604800) as bigint) as week_id', 'user_id', 'events'), 'week_id')})",
)
def _(spark, folder):
    day = time_bucket(F.col("ts"), m.TimeUnit.DAY).alias("day_id")
    rows = sk.sketch_rows(table(spark, folder, "events").select(day, "user_id"), ["day_id"], "user_id", _ERROR)
    daily = rows.groupBy("day_id").agg(sk.registers_json(F.col("bnum"), F.col("rho")).alias("sketch"))
    return sk.merge_sketches(daily.withColumn("week_id", F.floor(F.col("day_id") / 7).cast("bigint")), ["week_id"], "sketch")


# --- constraints and lineage --------------------------------------------------------


@query(
    "key_uniqueness_check",
    "select created_at_minute_id, publisher_id, geo_id, user_agent_id, count(*) as n_rows from fact_session_by_minute"
    " where created_at_minute_id is not null and publisher_id is not null and geo_id is not null and user_agent_id is not null"
    " group by all having count(*) > 1",
)
def _(spark, folder):
    env = environment(_SESSION)
    key = derive.fact_table(env, env.fact("session")).constraints[0].columns
    return ddl.key_violations(table(spark, folder, "fact_session_by_minute"), list(key))


@query(
    "fk_check",
    "select id, publisher_id, session_event_id from page_view_events v where session_event_id is not null and not exists"
    " (select 1 from session_events s where s.id = v.session_event_id and s.publisher_id = v.publisher_id)",
)
def _(spark, folder):
    views = table(spark, folder, "page_view_events").select("id", "publisher_id", "session_event_id")
    pairs = [("session_event_id", "id"), ("publisher_id", "publisher_id")]
    return ddl.reference_violations(views, table(spark, folder, "session_events"), pairs)


_LINEAGE = [
    ("dim_geo", 0, "session_events"), ("dim_page_type", 0, "page_view_events"), ("dim_user_agent", 0, "session_events"),
    ("fact_session_by_minute", 0, "session_events"), ("fact_session_by_minute", 1, "dim_user_agent"),
    ("fact_session_by_minute", 2, "dim_geo"), ("fact_page_view_by_minute", 0, "page_view_events"),
    ("fact_page_view_by_minute", 1, "session_events"), ("fact_page_view_by_minute", 2, "dim_page_type"),
    ("fact_page_view_by_minute", 3, "referrers"), ("fact_page_view_by_minute", 4, "dim_user_agent"),
    ("fact_page_view_by_minute", 5, "dim_geo"),
]


@query("dependencies_table", f"select * from (values {', '.join(map(str, _LINEAGE))}) t(table_name, position, depends_on)")
def _(spark, folder):
    return build.lineage(environment(_SESSION, _PAGE_VIEW), spark)


# --- 1: new or changed records ------------------------------------------------------

_CONTENT = (
    "id, created_at, member_id, publisher_id, user_agent, browser_name, os, geo_country_name, geo_city_name, geo_continent_name,"
    " geo_most_specific_subdivision_name, geo_longitude, geo_latitude, geo_time_zone, geo_postal_code, user_agent_name,"
    " user_agent_type, user_agent_version, user_agent_device"
)
_PENDING = f"""held as (select distinct shard, read_from, read_upto from (
 select *, row_number() over (partition by run_id order by logged_at desc, (lower(trim(status)) = 'committed')::int) as n from load_runs)
 where n = 1 and lower(trim(status)) = 'committed'),
 d as (select *, exists (select 1 from held h where h.shard = publisher_id % 4 and arrived_at >= read_from and arrived_at < read_upto) as was_read
 from session_events),
 v as (select {_CONTENT}, max(arrived_at) as arrived, bool_or(was_read) as was_read from d group by {_CONTENT}),
 pending as (select id as session_id, publisher_id, cast(floor(epoch(created_at) / 60) as bigint) as created_at_minute_id
 from (select *, row_number() over (partition by id order by arrived desc) as n from v) where n = 1 and not was_read)"""


def _scratch(spark, name: str) -> str:
    """A folder of its own in the shared folder, removed when the session ends."""
    return removed_at_end(spark, f"{shared_folder(spark).rstrip('/')}/starloom/{name}-{uuid.uuid4().hex}")


def _pending(spark, folder) -> DataFrame:
    sink = process_sessions(table(spark, folder, "session_events"), table(spark, folder, "load_runs"), _scratch(spark, "sessions"))
    return pending_sessions(sink)


@query("p1_found", f"with {_PENDING} select * from pending")
def _(spark, folder):
    return _pending(spark, folder)


@query(
    "p1_pending_by_day",
    f"with {_PENDING} select publisher_id, cast(floor(created_at_minute_id / 1440) as bigint) as day_id, count(*) as n_sessions from pending group by 1, 2",
)
def _(spark, folder):
    day = F.floor(F.col("created_at_minute_id") / F.lit(1440)).cast("bigint").alias("day_id")
    return _pending(spark, folder).groupBy("publisher_id", day).agg(F.count(F.lit(1)).alias("n_sessions"))


_V1, _V2 = "2024-01-20 00:00:00", "2024-01-25 00:00:00"


@query(
    "p1_version_delta",
    f"""with e as (select publisher_id, arrived_at >= timestamp '{_V1}' as later, publisher_id % 10 = 3 and arrived_at < timestamp '{_V2}' as gone
 from session_events) select case when later then 'insert' else 'delete' end as change, publisher_id, count(*) as n_rows from e
 where later <> gone group by 1, 2""",
)
def _(spark, folder):
    """Deliveries as a versioned table: one load, a second one, a deletion, a rewrite; what changed since the first."""
    events = table(spark, folder, "session_events").select("id", "publisher_id", "arrived_at")
    versions = VersionedTable(spark, _scratch(spark, "versions"))
    first = versions.append(events.filter(~(F.col("arrived_at") >= time_literal(_V1))))
    versions.append(events.filter(F.col("arrived_at") >= time_literal(_V1)))
    versions.delete_where((F.col("publisher_id") % 10 == 3) & (F.col("arrived_at") < time_literal(_V2)))
    last = versions.compact()
    delta = versions.delta(first, last)
    return delta.groupBy(F.col("_change").alias("change"), "publisher_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "p1_process_new",
    f"select publisher_id, count(*) as n_rows from session_events where arrived_at < timestamp '{_V2}' group by 1",
)
def _(spark, folder):
    """A job over a growing table that is run after each load, dies once before its commit and is run again too often:
    every record of both loads once."""
    events = table(spark, folder, "session_events").select("publisher_id", "arrived_at")
    source, sink = VersionedTable(spark, _scratch(spark, "in")), VersionedTable(spark, _scratch(spark, "out"))
    inserted = lambda delta: delta.filter("_change = 'insert'").select("publisher_id")
    source.append(events.filter(~(F.col("arrived_at") >= time_literal(_V1))))
    process_new(source, sink, "job", inserted)
    source.append(events.filter((F.col("arrived_at") >= time_literal(_V1)) & (F.col("arrived_at") < time_literal(_V2))))

    def lost(delta: DataFrame) -> DataFrame:
        inserted(delta).write.parquet(_scratch(spark, "died"))  # output that no commit names
        raise InterruptedError

    with suppress(InterruptedError):
        process_new(source, sink, "job", lost)
    source.compact()
    for _ in range(2):
        process_new(source, sink, "job", inserted)
    return sink.read().groupBy("publisher_id").agg(F.count(F.lit(1)).alias("n_rows"))


# --- 4: rolling totals --------------------------------------------------------------


def _rolled(spark, folder, quiet: bool) -> DataFrame:
    facts = table(spark, folder, "fact_session_by_minute").distinct()
    day = F.floor(F.col("created_at_minute_id") / F.lit(1440))
    return rolling_totals(facts, "publisher_id", day, F.col("session_count"), quiet=quiet)


_DAILY = """daily as (select publisher_id, cast(floor(created_at_minute_id / 1440) as bigint) as d, sum(coalesce(session_count, 0)) as a
 from (select distinct * from fact_session_by_minute) where created_at_minute_id is not null group by 1, 2),
 days as (select publisher_id, unnest(range(min(d), max(d) + 30)) as day_id from daily group by 1),
 rolled as (select k.publisher_id, k.day_id, cast(coalesce(sum(a) filter (d = day_id), 0) as bigint) as day_total,
 cast(coalesce(sum(a) filter (d > day_id - 7), 0) as bigint) as total_7, cast(coalesce(sum(a) filter (d > day_id - 30), 0) as bigint) as total_30
 from days k left join daily on daily.publisher_id = k.publisher_id and d <= day_id and d > day_id - 30 group by 1, 2)"""


@query(
    "p4_found",
    f"""with {_DAILY} select publisher_id, day_id, 7 as period_days from rolled where day_total = 0 and total_7 > 0
 union all select publisher_id, day_id, 30 from rolled where day_total = 0 and total_30 > 0""",
)
def _(spark, folder):
    return idle_days(_rolled(spark, folder, quiet=False), "publisher_id")


@query("p4_rolling", f"with {_DAILY} select *, total_7 / 7.0::double as average_7, total_30 / 30.0::double as average_30 from rolled")
def _(spark, folder):
    return _rolled(spark, folder, quiet=True)


# --- 5: references to records that do not exist ------------------------------------


def _fact_orphans(spark, folder) -> DataFrame:
    dims = {"dim_geo": ("geo_id", table(spark, folder, "dim_geo")), "dim_user_agent": ("user_agent_id", table(spark, folder, "dim_user_agent"))}
    return dimension_orphans(table(spark, folder, "fact_session_by_minute"), dims, ["created_at_minute_id", "publisher_id"])


_ORPHANS = """orphans as (select distinct 'dim_geo' as dim_table, geo_id as missing_id, created_at_minute_id, publisher_id from fact_session_by_minute
 where geo_id <> -1 and geo_id not in (select id from dim_geo) union all
 select distinct 'dim_user_agent', user_agent_id, created_at_minute_id, publisher_id from fact_session_by_minute
 where user_agent_id <> -1 and user_agent_id not in (select id from dim_user_agent))"""


@query("p5_found", f"with {_ORPHANS} select * from orphans")
def _(spark, folder):
    return _fact_orphans(spark, folder)


@query(
    "p5_counts",
    f"""with {_ORPHANS}, notes as (select dim_table, dim_id, change from (select *, row_number() over
 (partition by dim_table, dim_id order by noted_at desc, change desc) as n from dim_changes) where n = 1)
 select o.dim_table, cast(floor(created_at_minute_id / 1440) as bigint) as period_id, coalesce(change, 'unknown') as known_as,
 count(*) as n_references, count(distinct missing_id) as n_missing_ids
 from orphans o left join notes c on o.dim_table = c.dim_table and missing_id = dim_id group by 1, 2, 3""",
)
def _(spark, folder):
    day = F.floor(F.col("created_at_minute_id") / F.lit(1440)).cast("bigint")
    return orphan_counts(_fact_orphans(spark, folder), day, table(spark, folder, "dim_changes"))


def _composite_sql(rule: str) -> str:
    exists = "exists (select 1 from referrers r where {})"
    both, one, two = exists.format("r.id = referrer_id and r.publisher_id = pub"), exists.format("r.id = referrer_id"), exists.format("r.publisher_id = pub")
    broken = {
        "simple": f"referrer_id is not null and pub is not null and not {both}",
        "partial": f"(referrer_id is not null and pub is not null and not {both}) or (referrer_id is not null and pub is null and not {one})"
        f" or (referrer_id is null and pub is not null and not {two})",
        "full": f"(referrer_id is not null and pub is not null and not {both}) or ((referrer_id is null) <> (pub is null))",
    }[rule]
    return (
        "with v as (select id, referrer_id, nullif(publisher_id, publisher_id // 5 * 5) as pub from page_view_events)"
        f" select id, referrer_id, pub from v where {broken}"
    )


def _composite_query(rule: str):
    @query(f"p5_composite_{rule}", _composite_sql(rule))
    def run(spark, folder):
        pub = F.when(F.col("publisher_id") % 5 != 0, F.col("publisher_id")).alias("pub")
        views = table(spark, folder, "page_view_events").select("id", "referrer_id", pub)
        pairs = [("referrer_id", "id"), ("pub", "publisher_id")]
        return orphan_references(views, table(spark, folder, "referrers"), pairs, rule)


for _rule in ("simple", "partial", "full"):
    _composite_query(_rule)


# --- 6: a few keys holding most records --------------------------------------------


@query(
    "p6_found",
    " union all ".join(
        f"select '{t}' as table_name, publisher_id from {t} where publisher_id is not null group by publisher_id"
        f" having count(*) >= 0.05 * (select count(*) from {t})"
        for t in ("session_events", "fact_session_by_minute")
    ),
)
def _(spark, folder):
    """The publishers that a placement onto the session's tasks splits for holding that much."""
    parts, tasks = [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("session_events", "fact_session_by_minute"):
        placement = plan_placement(key_loads(table(spark, folder, name), "publisher_id"), "publisher_id", tasks, share=0.05)
        heavy = split_keys(spark, placement, "publisher_id", 0.05).filter("publisher_id is not null")
        parts.append(heavy.select(F.lit(name).alias("table_name"), "publisher_id"))
    return parts[0].unionByName(parts[1])


@query(
    "p6_per_publisher",
    """with stored as (select publisher_id, cast(floor(created_at_minute_id / 1440) as bigint) as day_id, sum(greatest(coalesce(session_count, 0), 0)) as stored
 from fact_session_by_minute group by 1, 2)
 select e.publisher_id, count(*) as n_deliveries, count(e.member_id) as n_members_known, count(s.stored) as n_on_stored_days,
 cast(sum(s.stored) as bigint) as stored_sum, max(s.stored)::bigint as busiest, min(e.created_at) as first_at, max(e.created_at) as last_at
 from session_events e left join stored s on e.publisher_id = s.publisher_id and s.day_id = cast(floor(epoch(e.created_at) / 86400) as bigint)
 group by 1""",
)
def _(spark, folder):
    """Deliveries joined with what is stored of their publisher and day: the same rows as a plain join."""
    events = table(spark, folder, "session_events").select("id", "publisher_id", "member_id", "created_at")
    events = events.withColumn("day_id", time_bucket(F.col("created_at"), m.TimeUnit.DAY))
    day = F.floor(F.col("created_at_minute_id") / F.lit(1440)).cast("bigint").alias("day_id")
    count = F.greatest(F.coalesce(F.col("session_count"), F.lit(0)), F.lit(0)).alias("n")
    stored = table(spark, folder, "fact_session_by_minute").select("publisher_id", day, count)
    stored = stored.groupBy("publisher_id", "day_id").agg(F.sum("n").alias("stored"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = balanced_join(events, stored, ["publisher_id", "day_id"], tasks, spread=F.xxhash64("id", "created_at"))
    # shards of a publisher are finished where they lie; one row for each shard is put together
    measures = {
        "n_deliveries": (F.count(F.lit(1)), F.sum), "n_members_known": (F.count("member_id"), F.sum),
        "n_on_stored_days": (F.count("stored"), F.sum), "stored_sum": (F.sum("stored"), F.sum), "busiest": (F.max("stored"), F.max),
        "first_at": (F.min("created_at"), F.min), "last_at": (F.max("created_at"), F.max),
    }
    shards = joined.groupBy("__task", "publisher_id").agg(*[e.alias(n) for n, (e, _) in measures.items()])
    return shards.groupBy("publisher_id").agg(*[again(n).alias(n) for n, (_, again) in measures.items()])


from starloom import plan_queries  # noqa: E402, F401 - registers its queries
