"""Session settings for large inputs. Nothing in the package needs them; they are what it was planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def settings(input_gb: float, executors: int, cores: int) -> dict[str, str]:
    """Settings for one run over ``input_gb`` of columnar input on ``executors`` of ``cores`` each.

    Shuffle partitions: three waves of tasks at least, and few enough rows in each that a task sorts
    in memory (about 128 MB of shuffled data, taken as equal to the input). AQE merges what is too
    small and splits what is skewed. Python batches are bounded by bytes, since texts vary in length.
    """
    slots = max(1, executors * cores)
    partitions = max(3 * slots, round(input_gb * 1024 / 128))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.shuffle.partitions": str(min(partitions, 100_000)),
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
        "spark.sql.session.timeZone": "UTC",
    }


def tuned(builder: SparkSession.Builder, input_gb: float, executors: int, cores: int) -> SparkSession.Builder:
    return builder.config(map=settings(input_gb, executors, cores))
