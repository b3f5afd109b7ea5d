"""Even work over keys of very uneven size.

Loads are counted per key (partial counts first, so a hot key sends one row from each task). Light
keys share bins by hash; keys above a bin's worth are heavy. Bins and heavy keys are packed onto
tasks by their loads, largest first, each onto the least loaded task; a heavy key is split into
shards in proportion to its load, and each shard is packed on its own. The matching side of a join
is replicated to the tasks that hold shards of its key, and to those only.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.sources.shared import staged

#: Bins of light keys for each task. More bins pack more evenly.
BINS_PER_TASK = 16
#: A key is heavy if it holds more than this share of a task's even load.
HEAVY_SHARE = 0.25
TASK = "__task"


def key_loads(df: DataFrame, key: str) -> DataFrame:
    """``<key>, n_rows``. A null key is counted like any other."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(loads: DataFrame, share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows; no more than 1 / share of them exist."""
    total = loads.agg(F.sum("n_rows"))
    return loads.filter(F.col("n_rows") >= total.scalar() * F.lit(share))


@dataclass(frozen=True)
class Placement:
    """Where rows go. ``bins`` gives the task of each bin of light keys; ``shards`` maps each heavy key, null may
    be one, to the tasks of its shards, in order; ``loads`` has the rows of each heavy key, ``planned`` those that each task
    gets. ``key_type`` is the key's type."""

    tasks: int
    bins: list[int]
    shards: dict
    loads: dict
    planned: list[int]
    key_type: T.DataType

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """``__bin, __bin_task`` and ``__heavy, __shards``: tasks x BINS_PER_TASK rows and at most tasks / HEAVY_SHARE or so.
        As tables the placement doesn't make the plan grow with the tasks."""
        bins = spark.createDataFrame(pa.table({"__bin": pa.array(range(len(self.bins)), pa.int32()), "__bin_task": pa.array(self.bins, pa.int32())}))
        schema = T.StructType([T.StructField("__heavy", self.key_type), T.StructField("__shards", T.ArrayType(T.IntegerType()))])
        return bins, spark.createDataFrame(list(self.shards.items()), schema)

    def _beside(self, df: DataFrame, key: Column) -> DataFrame:
        bins, heavy = self.tables(df.sparkSession)
        out = df.join(F.broadcast(heavy), key.eqNullSafe(F.col("__heavy")), "left") if self.shards else df.withColumn("__shards", F.lit(None).cast("array<int>"))
        return out.join(F.broadcast(bins), bin_of(key, len(self.bins)) == F.col("__bin"))

    def placed(self, df: DataFrame, key: str, spread: Column) -> DataFrame:
        """Adds the task of each row; ``spread`` is a hash that differs between rows of one key."""
        shard = F.element_at("__shards", (F.pmod(spread, F.size("__shards")) + 1).cast("int"))
        task = F.when(F.col("__shards").isNotNull(), shard).otherwise(F.col("__bin_task")).cast("int")
        return self._beside(df, F.col(key)).withColumn(TASK, task).drop("__heavy", "__shards", "__bin", "__bin_task")

    def replicated(self, df: DataFrame, key: str, task: str) -> DataFrame:
        """Each row once for every task that may hold rows of its key, in a column ``task``."""
        tasks = F.when(F.col("__shards").isNotNull(), F.array_distinct("__shards")).otherwise(F.array("__bin_task"))
        return self._beside(df, F.col(key)).withColumn(task, F.explode(tasks)).drop("__heavy", "__shards", "__bin", "__bin_task")


def bin_of(key: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bins)).cast("int")


def plan_placement(loads: DataFrame, key: str, tasks: int, share: float = 1.0) -> Placement:
    """Packs keys onto tasks. What reaches the driver doesn't grow with the keys: a sum for each of
    tasks x BINS_PER_TASK bins and at most tasks / HEAVY_SHARE heavy keys (1 / ``share`` of them if that is
    more, since keys of that share of all rows count as heavy in any case). A null key is split like any other."""
    bins = tasks * BINS_PER_TASK
    binned = staged(loads.select(F.col(key), "n_rows", bin_of(F.col(key), bins).alias("__bin")), "loads")
    by_bin = {r["__bin"]: r["n"] for r in binned.groupBy("__bin").agg(F.sum("n_rows").alias("n")).collect()}
    total = sum(by_bin.values())
    limit = max(1, min(math.ceil(HEAVY_SHARE * total / tasks), math.ceil(share * total)))
    heavy = {}
    for r in binned.filter(F.col("n_rows") >= limit).collect():
        heavy[r[key]] = r["n_rows"]
        by_bin[r["__bin"]] -= r["n_rows"]

    items = [(n, ("bin", b)) for b, n in by_bin.items()]
    for k, n in heavy.items():
        parts = max(1, math.ceil(n / limit))
        items += [(n // parts + (i < n % parts), ("key", k)) for i in range(parts)]
    items.sort(key=lambda x: (-x[0], str(x[1])))
    queue = [(0, t) for t in range(tasks)]
    where, shards = {b: b % tasks for b in range(bins)}, {}
    planned = [0] * tasks
    for n, (kind, name) in items:
        load, t = heapq.heappop(queue)
        heapq.heappush(queue, (load + n, t))
        planned[t] += n
        if kind == "bin":
            where[name] = t
        else:
            shards.setdefault(name, []).append(t)
    return Placement(tasks, [where[b] for b in range(bins)], shards, heavy, planned, loads.schema[key].dataType)


def split_keys(spark: SparkSession, placement: Placement, key: str, share: float) -> DataFrame:
    """``<key>, n_rows, n_tasks``: the keys that the placement splits and that hold at least ``share`` of all rows, with
    the tasks they are split over. The placement must have been planned with that share or a smaller one."""
    total = sum(placement.planned)
    rows = [(k, n, len(set(placement.shards[k]))) for k, n in placement.loads.items() if n >= share * total]
    schema = T.StructType([T.StructField(key, placement.key_type), T.StructField("n_rows", T.LongType()), T.StructField("n_tasks", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def spread_of(df: DataFrame) -> Column:
    """Hash over all columns: the same row goes to the same shard whenever a lost task is run again."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def balanced(df: DataFrame, key: str, tasks: int, placement: Placement | None = None, spread: Column | None = None) -> DataFrame:
    """``df`` in ``tasks`` partitions of even size, light keys whole, heavy keys in shards; adds ``__task``.
    Columns named ``__task``, ``__bin``, ``__bin_task``, ``__heavy`` or ``__shards`` are the operator's own."""
    placement = placement or plan_placement(key_loads(df, key), key, tasks)
    return placement.placed(df, key, spread_of(df) if spread is None else spread).repartitionById(placement.tasks, TASK)


def balanced_join(big: DataFrame, small: DataFrame, keys: list[str], tasks: int, how: str = "left", spread: Column | None = None) -> DataFrame:
    """Join on equal ``keys``, the first of which is the uneven one in ``big``; inner or left.

    Both sides lie on their tasks by ``__task`` before the join, which therefore adds no exchange.
    A column of ``small`` whose name ``big`` has too comes out as ``right_<name>``. Null keys match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    uneven = keys[0]
    placement = plan_placement(key_loads(big, uneven), uneven, tasks)
    left = balanced(big, uneven, tasks, placement, spread)
    taken = {c.lower() for c in big.columns}
    new = {c: f"__r_{c}" if c in keys else f"right_{c}" if c.lower() in taken else c for c in small.columns}
    named = small.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()])
    named = named.filter(" and ".join(f"`__r_{k}` is not null" for k in keys))
    right = placement.replicated(named, f"__r_{uneven}", "__r_task").repartitionById(tasks, "__r_task")
    on = F.col(TASK) == F.col("__r_task")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    return left.join(right, on, how).drop("__r_task", *[f"__r_{k}" for k in keys])
