"""Tables as series of immutable versions.

A version's manifest lists its data files and, for each file that rows have left, the folder of its
deletion vector. The difference of two manifests is a record delta, told file by file:

* files only in the newer version: their rows are inserts,
* files only in the older one: their rows are deletes,
* files in both with another deletion vector: rows in just one of the two vectors.

Files that are the same in both, vector included, are not read. A rewrite that leaves the rows as they
are (``compact``) is no change: its commit notes which files stand for which.

Deletion vectors are words of 64 row positions, a bit for each row. Columns named ``__file``, ``__row``
and ``__gone`` are the table's own.

A commit is a file that must not exist yet, put in place by a rename that refuses to replace. That is
atomic on HDFS and on local and network file systems; object stores need a committer or a lock of
their own, as their renames are copies.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most words of deletion vectors that are broadcast (some 200 bytes each, so 40 MB); more go through a shuffle.
BROADCAST_WORDS = 200_000
_ABSENT = object()


class CommitConflict(RuntimeError):
    pass


@dataclass(frozen=True)
class Manifest:
    """One immutable version. ``files`` maps each data file to the folder of its deletion vector or to
    None; ``rewrote`` tells of a rewrite: the files that were ``gone`` with their vectors, and those ``made`` of them."""

    version: int
    files: dict[str, str | None] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    rewrote: dict | None = None


@dataclass(frozen=True)
class Difference:
    """Files to read, with their deletion vectors: ``added`` at the end, ``removed`` at the start, ``changed`` at both."""

    added: dict[str, str | None]
    removed: dict[str, str | None]
    changed: dict[str, tuple[str | None, str | None]]

    def files(self) -> list[str]:
        return [*self.added, *self.removed, *self.changed]


def difference(old: Manifest, new: Manifest, rewrites: list[dict] = ()) -> Difference:
    """What became of each file. A file that was rewritten counts as it stood then, a file that was made of
    others as if all its rows had been there before."""
    start, end = dict(old.files), dict(new.files)
    for r in rewrites:
        end |= r["gone"]
        start |= dict.fromkeys(r["made"])
    was = {f: start.get(f, _ABSENT) for f in end | start}
    now = {f: end.get(f, _ABSENT) for f in end | start}
    moved = [f for f in was if was[f] != now[f]]
    return Difference(
        {f: now[f] for f in moved if was[f] is _ABSENT},
        {f: was[f] for f in moved if now[f] is _ABSENT},
        {f: (was[f], now[f]) for f in moved if _ABSENT not in (was[f], now[f])},
    )


class VersionedTable:
    """Parquet files under ``root/data`` with manifests ``root/versions/<n>.json``.

    A commit creates the next manifest, which exactly one writer can do; whoever comes second gets
    CommitConflict and starts over from the new version. Files without a manifest are never read. The
    driver holds one version's list of files; everything about rows stays in the executors.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- manifests

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> Manifest:
        """The newest version; version 0 is the empty table."""
        fs, folder = self._fs(), self._path("versions")
        if not fs.exists(folder):
            return Manifest(0)
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return self.at(max(numbers, default=0))

    def at(self, version: int) -> Manifest:
        if version == 0:
            return Manifest(0)
        stream = self._fs().open(self._path(f"versions/{version}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def _commit(self, manifest: Manifest) -> Manifest:
        fs, target = self._fs(), self._path(f"versions/{manifest.version}.json")
        part = self._path(f"versions/_{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        # written whole under another name first: a reader never sees half a manifest. This rename
        # refuses to replace a file, so of two writers one fails
        sc = self.spark.sparkContext
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
        refuse = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, target, refuse)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise CommitConflict(f"version {manifest.version} of {self.root} exists already") from None
        finally:
            if fs.exists(part):
                fs.delete(part, False)
        return manifest

    # --- commits

    def _write(self, df: DataFrame) -> dict[str, None]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(folder))]
        return {f"{folder}/{n}": None for n in names if n.endswith(".parquet")}

    def write(
        self, add: DataFrame | None = None, delete: Column | Callable[[DataFrame], DataFrame] | None = None,
        properties: dict[str, str] | None = None, base: Manifest | None = None,
    ) -> Manifest:
        """One commit: rows that meet ``delete`` (a condition, or a function that keeps those rows) leave,
        rows of ``add`` enter, ``properties`` are set. ``add`` may read this very table."""
        base = base or self.latest()
        files = dict(base.files)
        if delete is not None:
            files |= self._vectors_without(files, delete)
        properties = dict(properties or {})
        if add is not None:
            files |= self._write(add)
            properties.setdefault("schema", add.schema.json())
        return self._commit(Manifest(base.version + 1, files, base.properties | properties))

    def append(self, df: DataFrame, properties: dict[str, str] | None = None, base: Manifest | None = None) -> Manifest:
        return self.write(df, None, properties, base)

    def delete_where(self, condition: Column) -> Manifest:
        """Marks rows as gone in deletion vectors; data files stay as they are."""
        return self.write(delete=condition)

    def replace_files(self, gone: list[str], df: DataFrame | None = None, properties: dict[str, str] | None = None) -> Manifest:
        """``gone`` leave the table with their rows, the rows of ``df`` enter it."""
        base, left = self.latest(), set(gone)
        files = {f: v for f, v in base.files.items() if f not in left}
        schema = {} if df is None else {"schema": df.schema.json()}
        return self._commit(Manifest(base.version + 1, files | (self._write(df) if df is not None else {}), base.properties | schema | (properties or {})))

    def compact(self, files: list[str] | None = None) -> Manifest:
        """Rewrites files (all of them if none are named) without the rows that left. The rows stay what they
        are: a delta over this commit doesn't show them."""
        base = self.latest()
        gone = {f: base.files[f] for f in (base.files if files is None else files)}
        if not gone:
            return base
        made = self._write(self._live(gone).drop("__file", "__row"))
        kept = {f: v for f, v in base.files.items() if f not in gone}
        return self._commit(Manifest(base.version + 1, kept | made, base.properties, {"gone": gone, "made": list(made)}))

    def adopt(self, files: list[str], hide: Callable[[DataFrame], DataFrame] | None = None) -> Manifest:
        """Takes over files that lie elsewhere (as ``DataFrame.inputFiles`` names them), without copying them;
        rows that ``hide`` keeps are marked as gone."""
        base, named = self.latest(), dict.fromkeys(re.sub("^file:/+", "file:/", f) for f in files)
        if hide is not None and named:
            named |= self._vectors_without(named, hide)
        return self._commit(Manifest(base.version + 1, base.files | named, base.properties))

    def restore(self) -> Manifest:
        """All rows of the present files are there again."""
        base = self.latest()
        return self._commit(Manifest(base.version + 1, dict.fromkeys(base.files), base.properties))

    # --- rows

    def _rows(self, files: list[str]) -> DataFrame:
        """Rows of data files with ``__file`` and their position ``__row``."""
        paths = [f"{self.root}/{f}" if f.startswith("data/") else unquote(f) for f in files]
        path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
        own = F.concat(F.lit("data/"), F.element_at(F.split(path, "/data/"), -1))
        ours = [f.startswith("data/") for f in files]
        if all(ours):
            name = own
        elif any(ours):
            name = F.when(path.rlike("/data/[0-9a-f]{32}/[^/]+$"), own).otherwise(path)
        else:
            name = path
        return self.spark.read.parquet(*paths).select("*", name.alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def _words(self, vectors: dict[str, str | None]) -> DataFrame | None:
        """``__file, __word, __bits`` of the given files' deletion vectors; None if there are none."""
        pairs = [(f, v) for f, v in vectors.items() if v]
        if not pairs:
            return None
        stored = self.spark.read.parquet(*[f"{self.root}/{v}" for v in dict.fromkeys(v for _, v in pairs)])
        wanted = self.spark.createDataFrame(pa.table({"__file": [f for f, _ in pairs], "__vector": [v for _, v in pairs]}))
        return stored.join(wanted, ["__file", "__vector"]).select("__file", "__word", "__bits")

    def _gone(self, rows: DataFrame, vectors: dict[str, str | None], flag: str) -> DataFrame:
        """``rows`` with a boolean: whether the row is marked in its file's vector."""
        words = self._words(vectors)
        if words is None:
            return rows.withColumn(flag, F.lit(False))
        small = words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
        words = words.select(F.col("__file").alias("__vf"), F.col("__word").alias("__vw"), "__bits")
        words = F.broadcast(words) if small else words
        on = (F.col("__file") == F.col("__vf")) & (F.shiftright("__row", 6) == F.col("__vw"))
        marked = F.coalesce(F.expr("getbit(__bits, cast(__row & 63 as int)) = 1"), F.lit(False))
        return rows.join(words, on, "left").withColumn(flag, marked).drop("__vf", "__vw", "__bits")

    def _live(self, vectors: dict[str, str | None]) -> DataFrame:
        return self._gone(self._rows(list(vectors)), vectors, "__gone").filter("not __gone").drop("__gone")

    def _vectors_without(self, files: dict[str, str | None], leaving: Column | Callable[[DataFrame], DataFrame]) -> dict[str, str]:
        """Writes vectors that also hold the rows that are ``leaving``; which vector each file concerned has now."""
        if not files:
            return {}
        live = self._live(files)
        rows = live.filter(leaving) if isinstance(leaving, Column) else leaving(live)
        word = F.shiftright("__row", 6).alias("__word")
        bit = F.bit_or(F.expr("shiftleft(1L, cast(__row & 63 as int))")).alias("__bits")
        fresh = f"vectors/{uuid.uuid4().hex}"
        words = rows.groupBy("__file", word).agg(bit)
        words.withColumn("__vector", F.lit(fresh)).write.parquet(f"{self.root}/{fresh}")
        concerned = [r[0] for r in self.spark.read.parquet(f"{self.root}/{fresh}").select("__file").distinct().collect()]  # files of the manifest
        before = self._words({f: files[f] for f in concerned})
        if before is None:
            return dict.fromkeys(concerned, fresh)
        name = f"vectors/{uuid.uuid4().hex}"
        both = self._words(dict.fromkeys(concerned, fresh)).unionByName(before).groupBy("__file", "__word").agg(F.bit_or("__bits").alias("__bits"))
        both.withColumn("__vector", F.lit(name)).write.parquet(f"{self.root}/{name}")
        return dict.fromkeys(concerned, name)

    def schema(self, manifest: Manifest | None = None) -> T.StructType | None:
        text = (manifest or self.latest()).properties.get("schema")
        return T.StructType.fromJson(json.loads(text)) if text else None

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """The table as of a version; None if it never had a file."""
        manifest = manifest or self.latest()
        if manifest.files:
            return self._live(manifest.files).drop("__file", "__row")
        schema = self.schema(manifest)
        return None if schema is None else self.spark.createDataFrame([], schema)

    def difference(self, old: Manifest, new: Manifest) -> Difference:
        rewrites = [r for v in range(old.version + 1, new.version + 1) if (r := self.at(v).rewrote)]
        return difference(old, new, rewrites)

    def delta(self, old: Manifest, new: Manifest) -> DataFrame | None:
        """Rows that differ between two versions, ``_change`` saying insert or delete; None if no file differs.
        Only files that differ are read. Rows that came and went again between the two don't show."""
        if old.version > new.version:
            back = self.delta(new, old)
            return None if back is None else back.withColumn("_change", F.when(F.col("_change") == "insert", "delete").otherwise("insert"))
        d = self.difference(old, new)
        parts = []
        for vectors, change in ((d.added, "insert"), (d.removed, "delete")):
            if vectors:
                parts.append(self._live(vectors).withColumn("_change", F.lit(change)))
        if d.changed:
            rows = self._gone(self._rows(list(d.changed)), {f: v for f, (v, _) in d.changed.items()}, "__gone_old")
            rows = self._gone(rows, {f: v for f, (_, v) in d.changed.items()}, "__gone_new").filter("__gone_old <> __gone_new")
            parts.append(rows.withColumn("_change", F.when(F.col("__gone_old"), "insert").otherwise("delete")).drop("__gone_old", "__gone_new"))
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.drop("__file", "__row")
        if d.added and d.changed and any(f not in old.files for f in d.changed):
            # rows that were added, rewritten and deleted: an insert of one file and a delete of another
            columns = [F.col(f"`{c}`") for c in out.columns if c != "_change"]
            net = out.groupBy(*columns).agg(F.sum(F.when(F.col("_change") == "insert", 1).otherwise(-1)).alias("__net")).filter("__net <> 0")
            change = F.when(F.col("__net") > 0, "insert").otherwise("delete").alias("_change")
            out = net.withColumn("__n", F.explode(F.sequence(F.lit(1), F.abs("__net")))).select(*columns, change)
        return out


def process_new(source: VersionedTable, sink: VersionedTable, name: str, transform: Callable[[DataFrame], DataFrame]) -> Manifest:
    """Runs ``transform`` over the source's record delta since the last successful run called ``name``
    and appends its result. Output and processed version become visible in one commit."""
    base = sink.latest()
    done = int(base.properties.get(f"processed.{name}", 0))
    target = source.latest()
    if target.version == done:
        return base
    delta = source.delta(source.at(done), target)
    return sink.write(None if delta is None else transform(delta), properties={f"processed.{name}": str(target.version)}, base=base)
