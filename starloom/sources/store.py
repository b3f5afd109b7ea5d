"""A folder of tables with versions: reads, appends, and full loads that are swapped in by one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from starloom.sources.versions import Manifest, VersionedTable


class TableStore:
    """Derived tables are ``VersionedTable``s in ``root/<name><extension>``. Sources are plain parquet and may
    live elsewhere: pass ``sources``. A name without a version is read from the sources.

    Constraints aren't enforced on write; ``starloom.plans.ddl`` has the checks.
    """

    def __init__(self, spark: SparkSession, root: str, sources: str | None = None, extension: str = ".parquet"):
        self.spark, self.root, self.extension = spark, root.rstrip("/"), extension
        self.sources = (sources or root).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}{self.extension}"

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path(name))

    def exists(self, name: str) -> bool:
        return self.table(name).latest().version > 0

    def read(self, name: str, version: Manifest | None = None) -> DataFrame:
        table = self.table(name)
        version = version or table.latest()
        return table.read(version) if version.version else self.spark.read.parquet(f"{self.sources}/{name}{self.extension}")

    def create(self, name: str, schema: T.StructType) -> None:
        """An empty table; one that exists stays as it is."""
        if not self.exists(name):
            self.table(name).write(properties={"schema": schema.json()})

    def append(self, name: str, df: DataFrame, columns: list[str] | None = None, properties: dict | None = None, base: Manifest | None = None) -> Manifest:
        """INSERT ... SELECT by name. ``properties`` become part of the same commit; a commit by someone else
        since ``base`` makes it fail."""
        return self.table(name).append(df.select(*columns) if columns else df, properties, base)

    def replace(self, name: str, df: DataFrame, properties: dict | None = None) -> Manifest:
        """Full load: written beside the present files, which leave in the commit that brings the new ones in.
        Readers see either; none sees neither."""
        table = self.table(name)
        return table.replace_files(list(table.latest().files), df, properties)
