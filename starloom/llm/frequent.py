"""Most frequent items among billions: a heavy-light sketch.

Values hash to buckets of a few slots. A value that owns a slot is counted there exactly. A value
that finds its bucket full votes against the bucket's smallest slot; once the votes outweigh that
slot's count by EVICT, the slot's count moves into the light part, a small array of counters, and
the newcomer takes the slot. A newcomer that doesn't win is counted in the light part itself.
Memory is fixed: BUCKETS x SLOTS slots and LIGHT counters a task, however many values there are.

Partitions merge by recombining buckets: counts of one value add up, the SLOTS largest of a bucket stay, and
the counts of the others fall into the counters they hash to, which add up by position. So the merged
sketch is as large as that of one task, however many tasks there were. A value's estimate is its slot's
count, up to that plus the counter it hashes to: ``low <= count <= high`` always holds (a counter takes in
every occurrence that no slot counted). ``found_items`` turns this into an exact answer: candidates are the
values whose ``high`` reaches the threshold, and any counter that reaches it by itself could hide a value
that never kept a slot, so the values of such counters are counted exactly too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.sources.shared import staged

BUCKETS = 1024
SLOTS = 4
LIGHT = 4096
EVICT = 8


class HeavyLight:
    """The sketch of one column in one task."""

    def __init__(self, buckets: int = BUCKETS, slots: int = SLOTS, light: int = LIGHT, evict: int = EVICT):
        self.buckets, self.slots, self.evict = buckets, slots, evict
        self.rows = [{} for _ in range(buckets)]
        self.votes = [0] * buckets
        self.light = [0] * light

    def add(self, values: list[str], hashes: list[int], counts: list[int]) -> None:
        """Distinct values with their 64-bit hashes and how often each occurred in a batch."""
        n_buckets, n_light, slots, evict = self.buckets, len(self.light), self.slots, self.evict
        rows, votes, light = self.rows, self.votes, self.light
        for value, h, n in zip(values, hashes, counts):
            b = h % n_buckets
            row = rows[b]
            if value in row:
                row[value][0] += n
            elif len(row) < slots:
                row[value] = [n, h]
            else:
                votes[b] += n
                least = min(row, key=lambda v: row[v][0])
                if votes[b] >= evict * row[least][0]:
                    gone, at = row.pop(least)
                    light[(at >> 16) % n_light] += gone
                    row[value] = [n, h]
                    votes[b] = 0
                else:
                    light[(h >> 16) % n_light] += n

    def slots_held(self) -> Iterator[tuple[int, str, int]]:
        for b, row in enumerate(self.rows):
            for value, (n, _) in row.items():
                yield b, value, n


_SCHEMA = pa.schema([("field", pa.string()), ("part", pa.string()), ("at", pa.int32()), ("item", pa.string()), ("n", pa.int64())])
_DDL = "field string, part string, at int, item string, n bigint"


def _sketch_task(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {f: HeavyLight() for f in fields}
        for batch in batches:
            for f in fields:
                # the hash comes from the JVM; each distinct value of the batch is looked at once
                table = pa.table({"v": batch.column(f), "h": batch.column(f"__h_{f}")}).filter(pc.field("v").is_valid())
                if not table.num_rows:
                    continue
                groups = table.group_by("v").aggregate([("h", "min"), ("v", "count")])
                hashes = groups.column("h_min").to_numpy().view(np.uint64)
                sketches[f].add(groups.column("v").to_pylist(), hashes.tolist(), groups.column("v_count").to_pylist())
        for f, s in sketches.items():
            held = list(s.slots_held())
            if held:
                at, items, n = zip(*held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(n)), pa.array(["heavy"] * len(n)), pa.array(at, pa.int32()), pa.array(items), pa.array(n, pa.int64())],
                    schema=_SCHEMA,
                )
            filled = [(i, c) for i, c in enumerate(s.light) if c]
            if filled:
                at, n = zip(*filled)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(n)), pa.array(["light"] * len(n)), pa.array(at, pa.int32()), pa.nulls(len(n), pa.string()), pa.array(n, pa.int64())],
                    schema=_SCHEMA,
                )

    return run


def countable(value: Column) -> Column:
    """Null for values that are null or blank, else the value exactly as stored."""
    return F.when(value.rlike(r"(?U)\S"), value)


def _hashed(df: DataFrame, fields: list[str]) -> DataFrame:
    rows = df.select(*[countable(F.col(f)).alias(f) for f in fields])
    return rows.select("*", *[F.xxhash64(f).alias(f"__h_{f}") for f in fields])


def sketch_parts(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, part, at, item, n``: slots ('heavy', bucket, value, count) and counters ('light',
    position, null, count), the tasks' sketches merged."""
    return merged(_hashed(df, fields).mapInArrow(_sketch_task(fields), _DDL))


def merged(parts: DataFrame) -> DataFrame:
    """Sketches of any number of tasks or tables as one: at most SLOTS values a bucket and LIGHT counters a field."""
    sums = parts.groupBy("field", "part", "at", "item").agg(F.sum("n").alias("n"))  # one pass for slots and counters
    sums = sums.withColumn("__rank", F.row_number().over(W.partitionBy("field", "part", "at").orderBy(F.desc("n"), "item")))
    stays = (F.col("part") == "light") | (F.col("__rank") <= SLOTS)
    recombined = sums.select(
        "field", F.when(stays, F.col("part")).otherwise("light").alias("part"), F.when(stays, F.col("at")).otherwise(_light_position(F.col("item"))).alias("at"),
        F.when(stays, F.col("item")).alias("item"), "n",
    )
    return recombined.groupBy("field", "part", "at", "item").agg(F.sum("n").alias("n"))


def _light_position(item: Column) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(item), 16)
    return F.pmod(h, F.lit(LIGHT)).cast("int")


def frequent_items(parts: DataFrame) -> DataFrame:
    """``field, item, low, high``: every value that holds a slot with the bounds of its count."""
    heavy = parts.filter("part = 'heavy'").select("field", "item", F.col("n").alias("low"), _light_position(F.col("item")).alias("__at"))
    light = parts.filter("part = 'light'").select(F.col("field").alias("__f"), F.col("at").alias("__a"), F.col("n").alias("__n"))
    light = F.broadcast(light)  # at most LIGHT counters a field
    joined = heavy.join(light, (F.col("field") == F.col("__f")) & (F.col("__at") == F.col("__a")), "left")
    return joined.select("field", "item", "low", (F.col("low") + F.coalesce(F.col("__n"), F.lit(0))).alias("high"))


def top_items(parts: DataFrame, k: int) -> DataFrame:
    """``field, item, low, high`` of the k values of each field with the largest ``low``; ties by value."""
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.desc("low"), "item"))
    return frequent_items(parts).withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def found_items(df: DataFrame, fields: list[str], share: float, parts: DataFrame | None = None) -> DataFrame:
    """``field, item``: exactly the values that at least ``share`` of the rows hold, counted among the
    rows whose value is neither null nor blank. Values are compared as stored. No row, no item."""
    parts = staged(sketch_parts(df, fields), "frequent") if parts is None else parts
    totals = parts.groupBy("field").agg((F.sum("n") * F.lit(share)).alias("__least"))  # one row a field
    reach = F.broadcast(totals.withColumnRenamed("field", "__tf"))
    reaches = (F.col("high") >= F.col("__least")) & (F.col("high") - F.col("low") < F.col("__least"))
    items = frequent_items(parts).join(reach, (F.col("field") == F.col("__tf")) & reaches)
    counters = parts.filter("part = 'light'").join(reach, (F.col("field") == F.col("__tf")) & (F.col("n") >= F.col("__least")))
    # at most BUCKETS x SLOTS items a field and 1 / share counters; the values of both are counted exactly
    wanted = F.broadcast(items.select(F.col("field").alias("__wf"), F.col("item").alias("__wi")))
    cells = [(r["field"], r["at"]) for r in counters.select("field", "at").collect()]
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields]
    rows = df.select(F.explode(F.array(*one)).alias("v")).select("v.field", countable(F.col("v.item")).alias("item")).filter("item is not null")
    hidden = F.lit(False)
    for f in fields:
        mine = sorted(at for field, at in cells if field == f)
        if mine:
            hidden = hidden | ((F.col("field") == f) & _light_position(F.col("item")).isin(mine))
    rows = rows.join(wanted, (F.col("field") == F.col("__wf")) & (F.col("item") == F.col("__wi")), "left")
    counts = rows.filter(F.col("__wi").isNotNull() | hidden).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.join(reach, (F.col("field") == F.col("__tf")) & (F.col("n") >= F.col("__least")))
    return enough.select("field", "item")
