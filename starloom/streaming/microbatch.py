"""Streams of source rows into fact tables.

An extension: the batch loads take a window of event time, a stream takes what arrives. Each
micro-batch is loaded with ``load_fact`` and stored under its batch number; a batch that is
repeated after a failure overwrites its own rows, so none count twice. ``current`` puts the
batches together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.fact import load_fact, merge_facts
from starloom.plans import derive
from starloom.plans import model as m
from starloom.sources.store import TableStore

FOREVER = "9999-12-31 00:00:00"


def stream_fact(env: m.Env, fact: m.Fact, store: TableStore, stream: DataFrame, checkpoint: str):
    """Starts a query that loads every micro-batch of ``stream`` (rows of the fact's source table)."""
    name = derive.fact_table_name(env.settings, fact)

    def load(batch: DataFrame, number: int) -> None:
        rows = load_fact(env, fact, lambda t: batch if t == fact.table else store.read(t), FOREVER)
        rows.write.mode("overwrite").parquet(f"{store.path(name)}.batches/batch={number}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(env: m.Env, fact: m.Fact, store: TableStore) -> DataFrame:
    """The fact table told by all batches so far."""
    name = derive.fact_table_name(env.settings, fact)
    batches = store.spark.read.parquet(f"{store.path(name)}.batches")
    return merge_facts(env, fact, batches.drop("batch"))


def windowed_counts(stream: DataFrame, time: str, unit: m.TimeUnit, keys: list[str], lateness: str) -> DataFrame:
    """Running counts per bucket and key with a watermark; rows later than ``lateness`` are dropped by Spark.

    ``time`` is a TIMESTAMP. Buckets of every unit, weeks too, start at 1970-01-01 00:00:00 UTC.
    """
    window = F.window(F.col(time), f"{unit.value} seconds")
    counts = stream.withWatermark(time, lateness).groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    number = F.floor(F.unix_micros(F.col("window.start")) / F.lit(unit.value * 1_000_000)).cast("bigint")
    return counts.select(number.alias(f"{time}_{unit.label}_id"), *keys, "n_rows")
