"""Registered queries of this subpackage, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.exprs import epoch_seconds
from starloom.llm import bitmaps as bm
from starloom.llm import bpe, frequent, leaks, subjects
from starloom.sources.shared import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- 2: distinct counts -------------------------------------------------------------


def _bits_sql(period: int) -> str:
    one = "cast('0x' || substr(md5(cast({0} as varchar)), 1, 15) as bigint)"
    rows = " union all ".join(
        f"select cast(floor(epoch(created_at) / {period}) as bigint) as p, publisher_id, '{f}' as field, {one.format(f)} as h"
        f" from session_events where {f} is not null"
        for f in ("member_id", "id")
    )
    return f"""x as ({rows}), y as (select p, publisher_id, field, h & {bm.BITS - 1} as bit,
 least(bit_count((~(h >> 24) & ((h >> 24) + 1)) - 1), {bm.LEVELS - 1}) as level from x)"""


_COUNT_SQL = f"""z as (select *, {bm.BITS}.0::double * ln({bm.BITS}.0::double / greatest({bm.BITS} - ones, 1)) as n,
 case when ones > {int(bm.FULL * bm.BITS)} and level < {bm.LEVELS - 1} then level + 1 else 0 end as base from s),
 b as (select *, max(base) over (partition by grouping_name, p, publisher_id, field) as first from z),
 counts as (select grouping_name, p, publisher_id, field, cast(round(list_sum(list(n order by level) filter (level >= first)) * pow(2, max(first))) as bigint) as n_distinct
 from b group by 1, 2, 3, 4)"""


def _events(spark, folder) -> DataFrame:
    day = F.floor(epoch_seconds(F.col("created_at")) / F.lit(86400)).cast("bigint").alias("day_id")
    return table(spark, folder, "session_events").select(day, "publisher_id", "member_id", "id")


@query(
    "p2_distinct_cube",
    f"""with {_bits_sql(86400)}, s as (select case grouping(p, publisher_id) when 0 then 'day_id+publisher_id' when 1 then 'day_id'
 when 2 then 'publisher_id' else 'all' end as grouping_name, p, publisher_id, field, level, count(distinct bit) as ones from y
 group by grouping sets ((p, publisher_id, field, level), (p, field, level), (publisher_id, field, level), (field, level))), {_COUNT_SQL}
 select grouping_name as "grouping", p as day_id, publisher_id, field, n_distinct from counts""",
)
def _(spark, folder):
    return bm.distinct_cube(_events(spark, folder), ["day_id", "publisher_id"], ["member_id", "id"])


@query(
    "p2_weekly_from_daily",
    f"""with {_bits_sql(604800)}, s as (select '' as grouping_name, p, publisher_id, field, level, count(distinct bit) as ones from y
 group by p, publisher_id, field, level), {_COUNT_SQL} select p as week_id, publisher_id, field, n_distinct from counts""",
)
def _(spark, folder):
    daily = bm.bitmap_rows(_events(spark, folder), ["day_id", "publisher_id"], ["member_id", "id"])
    keys = ["week_id", "publisher_id"]
    weekly = daily.withColumn("week_id", F.floor(F.col("day_id") / F.lit(7)).cast("bigint"))
    return bm.estimates(bm.merge_bitmaps(weekly, keys), keys)


# --- 3: most frequent items ---------------------------------------------------------

_FIELDS = ["user_agent", "geo_city_name"]
SHARE = 0.005


@query(
    "p3_found",
    " union all ".join(
        f"select '{f}' as field, {f} as item from session_events where regexp_matches({f}, '[^\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]') group by {f}"
        f" having count(*) >= {SHARE} * (select count(*) from session_events where regexp_matches({f}, '[^\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]'))"
        for f in _FIELDS
    ),
)
def _(spark, folder):
    return frequent.found_items(table(spark, folder, "session_events"), _FIELDS, SHARE)


TOP = 100


def _top(spark, folder) -> DataFrame:
    parts = staged(frequent.sketch_parts(table(spark, folder, "session_events"), _FIELDS), "frequent")
    return frequent.top_items(parts, TOP)


@query("p3_top")
def _(spark, folder):
    return _top(spark, folder)


@query(
    "p3_top_bounds",
    " union all ".join(
        f"select '{f}' as field, least({TOP}, count(distinct {f})) as n_items, least({TOP}, count(distinct {f})) as n_within_bounds from session_events"
        f" where regexp_matches({f}, '[^\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]')"
        for f in _FIELDS
    ),
)
def _(spark, folder):
    """The bounds of the report against exact counts of all rows: how many of its values lie within them."""
    top = _top(spark, folder)
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in _FIELDS]
    rows = table(spark, folder, "session_events").select(F.explode(F.array(*one)).alias("v")).select("v.*")
    exact = rows.filter("item is not null").groupBy("field", "item").agg(F.count(F.lit(1)).alias("exact"))
    within = F.sum(F.col("exact").between(F.col("low"), F.col("high")).cast("bigint"))
    return top.join(exact, ["field", "item"]).groupBy("field").agg(F.count(F.lit(1)).alias("n_items"), within.alias("n_within_bounds"))


# --- 7: token ids -------------------------------------------------------------------


@query("p7_ids")
def _(spark, folder):
    return bpe.encode_corpus(table(spark, folder, "documents"))


@query("p7_lengths_by_source")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    ids = bpe.encode_corpus(docs.select("doc_id", "text", "source"), carry=["source"])
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"))


# --- 8: evaluation texts in training text -------------------------------------------


def _windows_sql(name: str, key: str, text: str) -> str:
    return (
        f"{name}w as (select {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') as w from {name} where {text} is not null),"
        f" {name}i as (select {key}, w, unnest(range(1, len(w) - {leaks.WINDOW - 2})) as i from {name}w where len(w) >= {leaks.WINDOW}),"
        f" {name}k as (select distinct {key}, array_to_string(w[i:i + {leaks.WINDOW - 1}], ' ') as k from {name}i)"
    )


def _matches(spark, folder, reworded: bool) -> DataFrame:
    return leaks.document_matches(table(spark, folder, "documents"), table(spark, folder, "eval_items"), reworded=reworded)


@query(
    "p8_found",
    f"with {_windows_sql('documents', 'doc_id', 'text')}, {_windows_sql('eval_items', 'item_id', 'passage')}"
    " select distinct doc_id, item_id from documentsk join eval_itemsk using (k)",
)
def _(spark, folder):
    return leaks.shared_passages(_matches(spark, folder, reworded=False))


@query("p8_templates")
def _(spark, folder):
    return leaks.template_leaks(_matches(spark, folder, reworded=True))


# --- 9: subject areas ---------------------------------------------------------------


def _subjects(spark, folder) -> DataFrame:
    return subjects.assign_subjects(*[table(spark, folder, t) for t in ("documents", "subject_labels", "subjects")])


@query("p9_found")
def _(spark, folder):
    return _subjects(spark, folder)


@query("p9_composition")
def _(spark, folder):
    """Documents of each subject and source, a document of several subjects counting in shares."""
    found = _subjects(spark, folder)
    share = found.groupBy("doc_id").agg((1 / F.count(F.lit(1))).alias("share"), F.collect_list("subject").alias("s"))
    rows = share.join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id").select("source", F.explode("s").alias("subject"), "share")
    return rows.groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("share"), 6).alias("weight"))
