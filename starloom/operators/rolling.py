"""Rolling totals over trailing periods of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_totals(
    df: DataFrame, key: str, day: Column, amount: Column, periods: tuple[int, ...] = (7, 30), quiet: bool = True
) -> DataFrame:
    """``<key>, day_id, day_total, total_<p>, average_<p>`` for every day from a key's first one on.

    Each daily amount is an event that adds at its day and, for each period p, subtracts p days
    later; the running sum of the events is the total of the p days ending with a day. Between two
    events nothing changes, so the days in between are filled in from the event before them. Rows
    are added up per key and day first; a key then has at most (1 + periods) events a day, however
    many rows it owns. Days run on until the last amount has left the longest period. With
    ``quiet=False`` stretches in which all totals are zero because no row falls into any period
    are left out; days whose own rows add up to zero stay.

    A null amount counts as 0, a null day is no day, a null key is a key of its own. The average
    divides by the length of the period, days without rows included.
    """
    daily = df.select(F.col(key).alias("__k"), day.cast("bigint").alias("__d"), F.coalesce(amount, F.lit(0)).cast("bigint").alias("__a"))
    daily = daily.filter("__d is not null").groupBy("__k", "__d").agg(F.sum("__a").alias("__a"))

    zero = F.lit(0).cast("bigint")
    a, one = F.col("__a"), F.lit(1).cast("bigint")

    def event(shift: int, own: Column, totals: list[Column], live: Column) -> Column:
        fields = [(F.col("__d") + shift).alias("d"), own.alias("own"), live.alias("live")]
        return F.struct(*fields, *[t.alias(f"t{p}") for t, p in zip(totals, periods)])

    longest = max(periods)
    events = [event(0, a, [a for _ in periods], one)]
    for p in periods:
        events.append(event(p, zero, [-a if q == p else zero for q in periods], -one if p == longest else zero))
    rows = daily.select("__k", F.explode(F.array(*events)).alias("e"))
    columns = ["own", "live", *[f"t{p}" for p in periods]]
    points = rows.groupBy("__k", F.col("e.d").alias("d")).agg(*[F.sum(f"e.{c}").alias(c) for c in columns])

    order = W.partitionBy("__k").orderBy("d")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    points = points.select(
        "__k", "d", "own", *[F.sum(c).over(running).alias(c) for c in columns[1:]], F.lead("d").over(order).alias("next")
    )
    # the event that empties the longest period is not a day of its own
    points = points.filter(F.col("next").isNotNull())
    if not quiet:
        points = points.filter("live > 0")
    days = points.withColumn("day_id", F.explode(F.sequence(F.col("d"), F.col("next") - 1)))
    own = F.when(F.col("day_id") == F.col("d"), F.col("own")).otherwise(zero)
    totals = [F.col(f"t{p}").alias(f"total_{p}") for p in periods]
    averages = [(F.col(f"t{p}") / F.lit(float(p))).alias(f"average_{p}") for p in periods]
    return days.select(F.col("__k").alias(key), "day_id", own.alias("day_total"), *totals, *averages)


def idle_days(rolled: DataFrame, key: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """``<key>, day_id, period_days``: days whose own total is 0 inside a period with a total above 0."""
    hit = [F.when((F.col("day_total") == 0) & (F.col(f"total_{p}") > 0), F.lit(p)) for p in periods]
    rows = rolled.select(key, "day_id", F.explode(F.array(*hit)).alias("period_days"))
    return rows.filter("period_days is not null")
