"""Loading of fact tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import sketch as sk
from starloom.functions.exprs import all_equal, in_window, time_bucket
from starloom.operators.dimension import Tables, defaulted
from starloom.plans import derive
from starloom.plans import model as m
from starloom.plans.model import spark_type


class _Sources:
    """The fact's source joined with its parents' sources, columns renamed so that none clash."""

    def __init__(self, env: m.Env, fact: m.Fact, tables: Tables, end, start):
        self.env, self.fact, self.number = env, fact, {fact.table: 0}
        owners = [o for o, _ in derive.all_dimension_tables(env, fact)]
        for owner in owners:
            self.number.setdefault(owner.table, len(self.number))
        time = F.col(fact.time_column())
        df = self._read(fact.table, tables(fact.table).filter(in_window(time, end, start)))
        spread = env.table(fact.table).primary_key() or fact.time_column()
        for name in list(self.number)[1:]:
            key = next(k for k in env.table(fact.table).foreign_keys() if k.table == name)
            pairs = [(self.ref(fact.table, a), self.ref(name, b)) for a, b in key.columns]
            on = all_equal([*pairs, _spread_nulls(self.ref(fact.table, spread), *zip(*pairs))])
            df = df.join(self._read(name, tables(name)), on, "left")
        self.df = df

    def _read(self, name: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        described = [c.name for c in self.env.table(name).columns if c.name in have]
        return df.select(*[F.col(c).alias(f"s{self.number[name]}__{c}") for c in described])

    def ref(self, table: str, column: str) -> Column:
        return F.col(f"s{self.number[table]}__{column}")

    def value(self, table: str, column: str) -> Column:
        return defaulted(self.env, self.env.table(table), column, self.ref(table, column))


#: Partitions over which rows without a parent are spread in a parent join.
NULL_SHARDS = 1024


def _spread_nulls(by: Column, left: tuple[Column, ...], right: tuple[Column, ...]) -> tuple[Column, Column]:
    """A further pair of join columns, equal wherever keys are. Rows whose key has a null match nothing
    anyway; this keeps them from gathering in the one task that the null hashes to."""
    some_null = reduce(lambda a, b: a | b, [c.isNull() for c in left])
    shard = F.when(some_null, F.pmod(F.xxhash64(by), F.lit(NULL_SHARDS)) + 1).otherwise(F.lit(0))
    return shard, F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in right]), F.lit(0).cast("bigint"))


def _unique_ids(dim: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """One row for each value; a value with several ids makes the query fail, not fan out."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a dimension value has more than one id"))).otherwise(F.min(id_column))
    named = dim.select(F.col(id_column), *[F.col(c).alias(f"__d_{c}") for c in columns])
    return named.groupBy(*[f"__d_{c}" for c in columns]).agg(one.alias("__d_id"))


def _lookups(src: _Sources, tables: Tables) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """The sources with the ids of derived dimensions beside them; (name, id expression) of every reference."""
    env, df, out = src.env, src.df, []
    missing = F.lit(env.settings.missing_id)
    for n, (owner, table) in enumerate(derive.all_dimension_tables(env, src.fact)):
        name = derive.reference_column(env, owner, table)
        if derive.is_existing(env, table):
            column = next(c.column for c in owner.of_kind(m.DimId) if c.table == table.name)
            value, nullable = src.ref(owner.table, column), env.table(owner.table).column(column).nullable
            inherited = owner.table != src.fact.table  # an unmatched parent leaves even a NOT NULL key empty
            out.append((name, F.coalesce(value, missing) if nullable or inherited else value))
            continue
        dim = table.name.removeprefix(env.settings.dim_prefix)
        columns = derive.new_dimension_columns(owner)[dim]
        named = {c: derive.dim_column_name(dim, c) for c in columns}
        ids = _unique_ids(tables(table.name), list(named.values()), env.settings.dim_id_column)
        ids = ids.select(*[F.col(f"__d_{d}").alias(f"__d{n}_{d}") for d in named.values()], F.col("__d_id").alias(f"__d{n}_id"))
        df = df.join(ids, all_equal([(src.value(owner.table, c), F.col(f"__d{n}_{d}")) for c, d in named.items()]), "left")
        out.append((name, F.coalesce(F.col(f"__d{n}_id"), missing)))
    return df, out


def load_fact(env: m.Env, fact: m.Fact, tables: Tables, end, start=None) -> DataFrame:
    """Rows of the fact table for source rows with ``start <= time < end`` (no start: all before ``end``).

    ``tables`` gives source and dimension tables by name. The result has the columns of
    ``derive.fact_table`` in their order and types. Groups are formed on bucket numbers, plain
    keys and dimension ids. A null time falls out of every window.
    """
    s = env.settings
    src = _Sources(env, fact, tables, end, start)
    df, references = _lookups(src, tables)
    target = derive.fact_table(env, fact)
    types = {c.name: spark_type(c.type) for c in target.columns}

    keys: dict[str, Column] = {}
    inputs: dict[str, Column] = {}
    first: dict[str, Column] = {}  # aggregates over rows
    again: dict[str, Column] = {}  # aggregates over the results of the first
    sketches: dict[str, str] = {}
    n_sketches = len(fact.of_kind(m.FactCountDistinct))

    def measure(name: str, one: Column, two) -> None:
        first[name] = one.alias(name)
        again[name] = two(F.col(name)).alias(name)

    for i, c in enumerate(fact.columns):
        ref = src.ref(fact.table, c.source) if c.source is not None else None
        x = F.col(f"__in{i}")
        if isinstance(c, m.DimTime):
            kind = df.schema[f"s0__{c.column}"].dataType
            keys[derive.time_column_name(s, c.column)] = time_bucket(ref, s.time_unit, kind)
        elif isinstance(c, m.KEY_KINDS):
            keys[c.column] = src.value(fact.table, c.column)
        elif isinstance(c, m.FactCountDistinct):
            inputs[f"__in{i}"] = src.ref(fact.table, c.source or env.table(fact.table).primary_key())
            sketches[c.column] = f"__in{i}"
        elif isinstance(c, m.Measure):
            if ref is not None:
                inputs[f"__in{i}"] = ref
            match c:
                case m.FactCount():
                    every = F.col("__row") if n_sketches > 1 else F.lit(1)
                    measure(c.column, F.count(every if ref is None else x), F.sum)
                case m.FactSum():
                    measure(c.column, F.sum(x), F.sum)
                case m.FactMax():
                    measure(c.column, F.max(x), F.max)
                case m.FactMin():
                    measure(c.column, F.min(x), F.min)
                case m.FactAverage():
                    measure(c.column + s.avg_count_suffix, F.count(x), F.sum)
                    measure(c.column + s.avg_sum_suffix, F.sum(x), F.sum)
    keys.update(references)
    keyed = df.select(*[e.alias(k) for k, e in keys.items()], *[e.alias(k) for k, e in inputs.items()])

    if not sketches:
        out = keyed.groupBy(*keys).agg(*first.values()) if first else keyed.select(*keys).distinct()
    else:
        # sketches share the pass of the other measures: rows are grouped by register first (each
        # sketch's registers under its own number), and the groups' partial results per key after that
        buckets = sk.bucket_count(s.distinct_error_rate)
        registers = [
            F.struct(F.lit(i).alias("sketch"), sk.bucket_of(F.col(v), buckets).alias("bucket"), sk.low_bits(F.col(v)).alias("low"))
            for i, v in enumerate(sketches.values())
        ]
        if len(registers) == 1:
            rows = keyed.withColumn("__r", registers[0])
        else:  # one row for each sketch; measures are taken from the first only
            rows = keyed.withColumn("__r", F.explode(F.array(*registers)))
            others = F.col("__r.sketch") > 0
            measured = [k for k in inputs if k not in sketches.values()]
            rows = rows.withColumns({k: F.when(~others, F.col(k)) for k in measured} | {"__row": F.when(~others, F.lit(1))})
        by_register = rows.groupBy(*keys, "__r.sketch", "__r.bucket").agg(*first.values(), sk.rank_of(F.min("__r.low")).alias("__rho"))
        own = [F.when(F.col("sketch") == i, F.col("bucket")) for i in range(len(sketches))]
        jsons = [sk.registers_json(b, F.col("__rho")).alias(n) for b, n in zip(own, sketches)]
        out = by_register.groupBy(*keys).agg(*again.values(), *jsons)
    return out.select(*[F.col(c.name).cast(types[c.name]).alias(c.name) for c in target.columns])


def merge_facts(env: m.Env, fact: m.Fact, *parts: DataFrame) -> DataFrame:
    """Parts loaded for different windows as one table, rows of equal keys put together.

    Repairs increments whose windows weren't aligned to buckets: counts and sums add up, extremes
    are taken again, sketches keep the larger rank of each register.
    """
    s, target = env.settings, derive.fact_table(env, fact)
    keys = list(target.constraints[0].columns)
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    how: dict[str, Callable[[str], Column]] = {}
    for c in fact.columns:
        match c:
            case m.FactCount() | m.FactSum():
                how[c.column] = F.sum
            case m.FactAverage():
                how |= dict.fromkeys((c.column + s.avg_count_suffix, c.column + s.avg_sum_suffix), F.sum)
            case m.FactMax():
                how[c.column] = F.max
            case m.FactMin():
                how[c.column] = F.min
    sketches = [c.column for c in fact.of_kind(m.FactCountDistinct)]
    if sketches:
        # one pass for all: the registers of each sketch under its number, the measures under -1
        registers = [
            F.transform(
                F.map_entries(F.coalesce(sk.parse_registers(F.col(n)), F.create_map().cast("map<string,int>"))),
                lambda e, i=i: F.struct(F.lit(i).alias("sketch"), e["key"].alias("bucket"), e["value"].alias("rho")),
            )
            for i, n in enumerate(sketches)
        ]
        none = F.struct(F.lit(-1).alias("sketch"), F.lit(None).cast("string").alias("bucket"), F.lit(None).cast("int").alias("rho"))
        rows = rows.select(*keys, *how, F.explode(F.concat(F.array(none), *registers)).alias("__r"))
        rows = rows.withColumns({n: F.when(F.col("__r.sketch") < 0, F.col(n)) for n in how})
        rows = rows.groupBy(*keys, "__r.sketch", "__r.bucket").agg(*[f(n).alias(n) for n, f in how.items()], F.max("__r.rho").alias("__rho"))
    own = [F.when(F.col("sketch") == i, F.col("bucket")) for i in range(len(sketches))]
    jsons = [sk.registers_json(b, F.col("__rho")).alias(n) for b, n in zip(own, sketches)]
    measures = [f(n).alias(n) for n, f in how.items()] + jsons
    out = rows.groupBy(*keys).agg(*measures) if measures else rows.select(*keys).distinct()
    types = {c.name: spark_type(c.type) for c in target.columns}
    return out.select(*[F.col(c.name).cast(types[c.name]).alias(c.name) for c in target.columns])


def bucket_of(bound: datetime, unit: m.TimeUnit) -> int:
    """Number of the bucket that a bound (datetime without zone) lies in."""
    return int((bound - datetime(1970, 1, 1)).total_seconds() // unit.value)


def aligned(bound, unit: m.TimeUnit) -> bool:
    """Whether a bound (datetime without zone) lies on a bucket border of the unit."""
    return (bound - datetime(1970, 1, 1)).total_seconds() % unit.value == 0
