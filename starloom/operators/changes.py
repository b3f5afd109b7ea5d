"""Processing only new or changed records.

A table is a series of immutable versions (``starloom.sources.versions``), and the difference of two
manifests is a record delta. A consumer stores, in the very commit that publishes its output, which
version it processed (``process_new``). A run that dies before the commit leaves neither output nor
version behind, so the next run processes the same delta again; a run that dies after it has nothing
left to do.

Where a log of load runs tells what was processed (``process_sessions``), the log is turned into a
version: the data files as they are, with deletion vectors that hide what no run that held has read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starloom.functions.exprs import epoch_seconds, row_hash
from starloom.sources.shared import staged
from starloom.sources.versions import CommitConflict, Difference, Manifest, VersionedTable, difference, process_new

__all__ = [
    "CommitConflict", "Difference", "Manifest", "VersionedTable", "difference", "held_runs", "mark_covered", "merged_ranges", "micros",
    "pending_sessions", "process_new", "process_sessions", "unprocessed_sessions",
]

#: Most merged ranges that are broadcast (some 100 bytes each in a hash table, so about 10 MB); more
#: go through a shuffle.
BROADCAST_RANGES = 100_000


# --- ranges: deletion vectors over any position column --------------------------------


def merged_ranges(ranges: DataFrame, unit: str, lo: str, hi: str, slice_width: int) -> DataFrame:
    """Disjoint ranges ``unit, slice, lo, hi`` (hi exclusive) that cover what the given ones cover.

    Ranges are cut at multiples of ``slice_width``, so that each piece lies in one slice and a
    position finds its range by equality of (unit, slice). No unit's ranges gather in one task:
    slices are merged on their own. Ranges with a null or an empty extent cover nothing.
    """
    width = F.lit(slice_width)
    rows = ranges.select(F.col(unit).alias("unit"), F.col(lo).cast("bigint").alias("lo"), F.col(hi).cast("bigint").alias("hi"))
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)
    rows = rows.filter("unit is not null and lo < hi").distinct().withColumn("slice", F.explode(F.sequence(first, last)))
    start = F.col("slice") * width
    rows = rows.select("unit", "slice", F.greatest("lo", start).alias("lo"), F.least("hi", start + width).alias("hi")).distinct()
    order = W.partitionBy("unit", "slice").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("unit", "slice", "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__island")


def mark_covered(
    df: DataFrame, unit: Column, position: Column, ranges: DataFrame, slice_width: int, flag: str = "covered"
) -> DataFrame:
    """``df`` with a boolean: whether ``position`` lies in a range of its ``unit``.

    ``ranges`` come from ``merged_ranges`` with the same ``slice_width``. They are broadcast if their
    counted number is within BROADCAST_RANGES, else joined by a shuffle on (unit, slice). A null
    unit or position is covered by nothing.
    """
    small = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    side = ranges.select(F.col("unit").alias("__ru"), F.col("slice").alias("__rs"), F.col("lo").alias("__rlo"), F.col("hi").alias("__rhi"))
    rows = df.withColumns({"__unit": unit, "__pos": position.cast("bigint")})
    rows = rows.withColumn("__slice", F.floor(F.col("__pos") / F.lit(slice_width)))
    inside = (F.col("__unit") == F.col("__ru")) & (F.col("__slice") == F.col("__rs"))
    inside = inside & (F.col("__pos") >= F.col("__rlo")) & (F.col("__pos") < F.col("__rhi"))
    joined = rows.join(F.broadcast(side) if small else side, inside, "left")
    return joined.withColumn(flag, F.col("__rlo").isNotNull()).drop("__unit", "__pos", "__slice", "__ru", "__rs", "__rlo", "__rhi")


# --- a log of load runs as the processed version ---------------------------------------


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, whatever the session's time zone."""
    fraction = F.date_part(F.lit("SECOND"), ts) * 1_000_000  # of the minute, a decimal
    return F.floor(epoch_seconds(ts) / F.lit(60)).cast("bigint") * 60_000_000 + fraction.cast("bigint")


def held_runs(log: DataFrame) -> DataFrame:
    """``unit, lo, hi``: the windows of runs whose last line says committed, in any letter case.

    Lines may be repeated and out of order. Of lines logged at the same instant one that doesn't
    say committed is the last: rather read again than never. Windows are those of the last line.
    """
    said = F.lower(F.trim(F.coalesce(F.col("status"), F.lit("")))) == "committed"
    line = F.struct(F.col("logged_at"), (~said).alias("failed"), F.col("shard"), F.col("read_from"), F.col("read_upto"))
    last = log.filter(F.col("logged_at").isNotNull()).groupBy("run_id").agg(F.max(line).alias("last"))
    kept = last.filter(~F.col("last.failed"))
    return kept.select(
        F.col("last.shard").alias("unit"), micros(F.col("last.read_from")).alias("lo"), micros(F.col("last.read_upto")).alias("hi")
    )


HOUR_MICROS = 3_600_000_000


def _deliveries(events: DataFrame) -> DataFrame:
    """``session_id, publisher_id, minute, arrived, h1, h2`` of deliveries that have an id and an arrival."""
    content = [F.col(f"`{c}`") for c in events.columns if c != "arrived_at"]
    return events.filter(F.col("id").isNotNull() & F.col("arrived_at").isNotNull()).select(
        F.col("id").alias("session_id"),
        F.col("publisher_id"),
        F.floor(epoch_seconds(F.col("created_at")) / F.lit(60)).cast("bigint").alias("minute"),
        micros(F.col("arrived_at")).alias("arrived"),
        row_hash(content, 1).alias("h1"),
        row_hash(content, 2).alias("h2"),
    )


def _covered_by_runs(df: DataFrame, log: DataFrame, shards: int, publisher: str, arrived: Column, flag: str) -> DataFrame:
    processed = staged(merged_ranges(held_runs(log), "unit", "lo", "hi", HOUR_MICROS), "runs")
    return mark_covered(df, F.pmod(F.col(publisher), F.lit(shards)), arrived, processed, HOUR_MICROS, flag)


def _left_to_process(deliveries: DataFrame) -> DataFrame:
    """Sessions whose newest delivery is one that no delivery that ``was_read`` equals."""
    # one row for each content of a session: repeats disappear before the shuffle
    contents = deliveries.groupBy("session_id", "h1", "h2").agg(
        F.max("arrived").alias("arrived"),
        F.max(F.col("was_read").cast("int")).alias("was_read"),
        F.max("publisher_id").alias("publisher_id"),
        F.max("minute").alias("minute"),
    )
    newest = contents.groupBy("session_id").agg(
        F.max(F.struct("arrived", (1 - F.col("was_read")).alias("unread"), "h1", "h2", "publisher_id", "minute")).alias("n")
    )
    return newest.filter("n.unread = 1").select(
        "session_id", F.col("n.publisher_id").alias("publisher_id"), F.col("n.minute").alias("created_at_minute_id")
    )


def unprocessed_sessions(events: DataFrame, log: DataFrame, shards: int = 4) -> DataFrame:
    """``session_id, publisher_id, created_at_minute_id``: every session still to be processed, once.

    A delivery was read if it arrived in the window of a run that held, of its publisher's shard.
    A session is left to process if no delivery that was read equals its newest one in all columns
    but the arrival (which says that the newest itself wasn't read). Publisher and minute are those
    of the newest delivery; of several newest ones at one instant an unread one counts, then the
    larger by content hash. Deliveries without id or arrival are no sessions. Equality is that of
    two 64-bit hashes over all columns. Extra columns count as content.

    For rows that are no files; ``process_sessions`` gives the same for files, by their versions.
    """
    return _left_to_process(_covered_by_runs(_deliveries(events), log, shards, "publisher_id", F.col("arrived"), "was_read"))


#: Most sessions with unread deliveries that are broadcast (as 64-bit hashes, some 40 bytes each, so
#: 40 MB) to find the deliveries of theirs that were read; more go through a shuffle.
BROADCAST_SESSIONS = 1_000_000


def process_sessions(events: DataFrame, log: DataFrame, root: str, shards: int = 4) -> VersionedTable:
    """The rows of ``unprocessed_sessions`` as a table with versions under ``root``, whose commit says how far
    the deliveries were processed. ``events`` are parquet files, which stay where they are.

    Version 1 of the deliveries is what the runs that held have read: the files, with deletion vectors that
    hide the other rows. Version 2 has all rows. The delta between them are the unread deliveries; only
    files that hold any are read for it. Of the deliveries that were read only those of the same sessions are looked at.
    A second call for the same ``root`` finds the commit and does nothing.
    """
    spark = events.sparkSession
    source, sink = VersionedTable(spark, f"{root}/deliveries"), VersionedTable(spark, f"{root}/pending")
    if not source.latest().version:
        unread = lambda rows: _covered_by_runs(rows, log, shards, "publisher_id", micros(F.col("arrived_at")), "__read").filter("not __read")
        source.adopt(events.inputFiles(), unread)
    if not sink.latest().version:
        sink.write(properties={"processed.sessions": "1"})
    if source.latest().version == 1:
        source.restore()
    read = source.read(source.at(1))

    def pending(delta: DataFrame) -> DataFrame:
        unread = staged(_deliveries(delta.filter("_change = 'insert'").drop("_change")), "unread")
        sessions = unread.select(F.xxhash64("session_id").alias("__session")).distinct()
        small = sessions.limit(BROADCAST_SESSIONS + 1).count() <= BROADCAST_SESSIONS
        known = read.join(F.broadcast(sessions) if small else sessions, F.xxhash64("id") == F.col("__session"), "left_semi")
        rows = unread.withColumn("was_read", F.lit(False)).unionByName(_deliveries(known).withColumn("was_read", F.lit(True)))
        return _left_to_process(rows)

    process_new(source, sink, "sessions", pending)
    return sink


_PENDING = "session_id string, publisher_id int, created_at_minute_id bigint"


def pending_sessions(sink: VersionedTable) -> DataFrame:
    """What ``process_sessions`` has committed; empty if nothing was left to process."""
    rows = sink.read()
    return sink.spark.createDataFrame([], _PENDING) if rows is None else rows
